"""Tables with a key, changed in place bucket by bucket.

::

    <path>/bucket=7/version=3f2a91c0/part-*.parquet
    <path>/_manifest/0000000042          JSON: the live version of each bucket

A row lies in the bucket that its key's hash names.  A change reads and rewrites the buckets
that its own keys fall in, and no other; which version of a bucket is live is decided
by one commit (``sinks.commits``) for all of them, so readers see the whole change or nothing
of it.  Old and new rows of a bucket meet on the key, with both sides dealt by bucket and
key.  Counts of what happened come from the writing pass (``DataFrame.observe``).

The number of buckets is fixed with the first write.  Keys compare null-safe: null is a key
like any other.  Two rows of one change with the same key are an error.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.sinks.commits import Commits

BUCKETS = 64


@dataclass(frozen=True)
class Changed:
    """Rows inserted, updated, deleted and left as they were in the buckets that were rewritten."""

    inserted: int
    updated: int
    deleted: int
    buckets: list[int]


class KeyedTable:
    """The table in ``path``, a folder that driver and executors share; ``keys`` name its rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), list(keys), buckets
        self.commits = Commits(spark, path)

    def _known(self) -> tuple[int, dict[int, str], T.StructType | None]:
        _, d = self.commits.newest()
        if not d:
            return self._buckets, {}, None
        return d["buckets"], {int(b): v for b, v in d["live"].items()}, T.StructType.fromJson(d["schema"])

    def _scan(self, live: dict[int, str], schema: T.StructType) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/bucket={b}/version={v}" for b, v in live.items()])

    def read(self) -> DataFrame | None:
        """All rows; None before the first write."""
        _, live, schema = self._known()
        return None if schema is None else self._scan(live, schema)

    def _with_bucket(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int"))

    def replace(self, df: DataFrame) -> Changed:
        """The table is ``df`` from now on."""
        return self._change(df, "replace")

    def upsert(self, df: DataFrame, removed: str | None = None) -> Changed:
        """Insert new keys, replace all columns of known ones; rows flagged in column ``removed`` delete theirs."""
        return self._change(df, "upsert", removed)

    def insert_if_absent(self, df: DataFrame) -> Changed:
        """Insert rows whose key is unknown; known ones stay as they are."""
        return self._change(df, "seed")

    def _change(self, df: DataFrame, how: str, removed: str | None = None) -> Changed:
        df = df.persist()  # read for its buckets and for its rows
        try:
            return self._apply(df, how, removed)
        finally:
            df.unpersist()

    def _apply(self, df: DataFrame, how: str, removed: str | None) -> Changed:
        done: dict = {}

        def apply(document: dict) -> dict | None:
            buckets, live, schema = self._known()
            old_schema, gone = schema, F.col(removed) if removed else F.lit(False)
            new = self._with_bucket(df.withColumn("_gone", F.coalesce(gone, F.lit(False))).drop(*([removed] if removed else [])), buckets)
            # nullability isn't kept in files
            columns = T.StructType([T.StructField(f.name, f.dataType) for f in new.schema if f.name not in ("bucket", "_gone")])
            schema = old_schema or columns
            if [f.name for f in schema] != [f.name for f in columns]:
                if {f.name for f in schema} != {f.name for f in columns}:
                    raise ValueError(f"{self.path}: columns {columns.fieldNames()} instead of {schema.fieldNames()}")
                new = new.select(*schema.fieldNames(), "bucket", "_gone")
            touched = sorted(live) if how == "replace" else []
            touched = sorted({*touched, *(r["bucket"] for r in new.select("bucket").distinct().collect())})
            old = self._scan({b: live[b] for b in touched if b in live}, schema)
            names = schema.fieldNames()
            a = self._with_bucket(old, buckets).select(F.struct(*names).alias("o"), "bucket", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
            b = new.select(F.struct(*names).alias("n"), "bucket", "_gone", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
            on = [F.col("a.bucket") == F.col("b.bucket"), *[F.col(f"a._k{i}").eqNullSafe(F.col(f"b._k{i}")) for i in range(len(self.keys))]]
            both = a.alias("a").join(b.alias("b"), on, "full_outer")
            is_old, is_new = F.col("o").isNotNull(), F.col("n").isNotNull()
            seen = Observation()
            stays = {"upsert": is_old & ~is_new, "seed": is_old, "replace": F.lit(False)}[how]
            enters = is_new & ~F.col("_gone") if how != "seed" else is_new & ~is_old
            both = both.select(
                F.when(stays, F.col("o")).otherwise(F.col("n")).alias("row"), F.coalesce("a.bucket", "b.bucket").alias("bucket"),
                F.coalesce(stays, F.lit(False)).alias("stays"), F.coalesce(enters, F.lit(False)).alias("enters"), is_old.alias("was"), is_new.alias("is"), F.coalesce("_gone", F.lit(False)).alias("_gone"))
            kinds = [F.count_if(F.col("enters") & ~F.col("was")).alias("inserted"), F.count_if(F.col("enters") & F.col("was")).alias("updated"),
                     F.count_if(F.col("was") & ~F.col("stays") & ~F.col("enters")).alias("deleted")]
            counted, both = both, both.observe(seen, *kinds)
            version = uuid.uuid4().hex[:8]
            out = both.where("stays OR enters").select("row.*", "bucket").withColumn("version", F.lit(version))
            if touched:
                (out.hint("rebalance", F.col("bucket")).write.mode("append").partitionBy("bucket", "version").parquet(self.path))
                try:
                    counts = seen.get
                except Py4JJavaError:  # no row came out, and Spark dropped the part of the plan that counts
                    counts = counted.agg(*kinds).first().asDict()
            else:
                counts = {"inserted": 0, "updated": 0, "deleted": 0}
            made = {b for b in touched if f"version={version}" in self.commits.names(f"bucket={b}")}
            fresh = self._scan(dict.fromkeys(made, version), schema)
            if made and not fresh.groupBy(*self.keys).count().where("count > 1").isEmpty():
                self.commits.delete([f"bucket={b}/version={version}" for b in made])
                raise ValueError(f"{self.path}: a key stands twice in one change")
            dead = [f"bucket={b}/version={live[b]}" for b in touched if b in live]
            if how == "seed" and not counts["inserted"] and old_schema is not None:
                self.commits.delete([f"bucket={b}/version={version}" for b in made])
                done.update(counts, dead=[], buckets=[])
                return None
            live = {b: v for b, v in live.items() if b not in touched} | dict.fromkeys(made, version)
            done.update(counts, dead=dead, buckets=touched)
            return {"buckets": buckets, "live": {str(b): v for b, v in live.items()}, "schema": schema.jsonValue()}

        self.commits.commit(apply)
        self.commits.delete(done["dead"])
        return Changed(done["inserted"], done["updated"], done["deleted"], done["buckets"])
