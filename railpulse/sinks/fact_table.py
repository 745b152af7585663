"""One fact table from ingest to retention: day folders and a manifest of the live ones.

::

    <path>/ingest_date=2024-01-31/batch_id=<source>-17/part-*.parquet
    <path>/_manifest/0000000042          JSON: what is live after commit 42

* **Append** writes a batch with dynamic partition overwrite, so a batch that is tried
  again replaces what its first try left, and then commits it. A batch that has been
  committed is not written twice, whatever the stream does after a failure.
* **Read** takes the live folders of the newest manifest; ``since`` leaves out folders that
  hold nothing so young before any file is opened. The newest timestamp is in the manifest.
* **Prune** drops folders (so, whole days) that lie before the cutoff without reading them,
  rewrites only folders that the cutoff runs through and commits both at once.
* **Compact** merges the batch folders of a day once there are many, so a day with a batch
  every ten seconds keeps a bounded number of folders, and the manifest stays small.

Commits are ``sinks.commits``; folders that are no longer live are deleted after the commit.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.operators.latest import latest_positions
from railpulse.schemas import TRAIN_POSITIONS
from railpulse.sinks.commits import TRIES, Commits

#: A day with more batch folders than this is merged by ``compact``.
MANY_FOLDERS = 64

PARTITIONS = ["ingest_date", "batch_id"]


@dataclass(frozen=True)
class Folder:
    """A live folder: its day and batch, how many rows, their least and greatest timestamp (ISO text)."""

    day: str
    batch: str
    rows: int
    least: str
    most: str

    @property
    def place(self) -> str:
        return f"ingest_date={self.day}/batch_id={self.batch}"


@dataclass
class Manifest:
    """``last``: newest committed batch of each source; ``next_id``: what the next row's id starts from."""

    next_id: int = 1
    last: dict[str, int] = field(default_factory=dict)
    live: list[Folder] = field(default_factory=list)

    @classmethod
    def of(cls, document: dict) -> Manifest:
        return cls(document["next_id"], document["last"], [Folder(**f) for f in document["live"]]) if document else cls()

    def document(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Swept:
    """What a sweep did: rows deleted and kept, folders dropped unread and folders rewritten."""

    deleted: int
    kept: int
    dropped: list[Folder]
    rewritten: list[Folder]


def as_fact(predictions: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Flat prediction rows -> columns of the fact table but ``id``; columns that ingest doesn't know are null.

    In a streaming plan the default timestamp is the batch's, which the stream records with
    the batch's offsets: a batch that is run again has the same one.
    """
    ts = F.current_timestamp().cast("timestamp_ntz") if timestamp is None else timestamp
    known = set(predictions.columns)
    out = []
    for f in TRAIN_POSITIONS.fields:
        if f.name == "id":
            continue
        c = ts if f.name == "timestamp" else F.col(f.name) if f.name in known else F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return predictions.select(*out)


class FactTable:
    """``train_positions`` as a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, path)

    def manifest(self) -> Manifest:
        """The newest manifest; an empty one before the first commit."""
        return Manifest.of(self.commits.newest()[1])

    def _commit(self, change) -> bool:
        """``change`` alters a manifest and says whether there is something to commit."""

        def apply(document: dict) -> dict | None:
            m = Manifest.of(document)
            return m.document() if change(m) else None

        return self.commits.commit(apply)

    def _delete(self, folders: list[Folder]) -> None:
        self.commits.delete([f.place for f in folders])

    # ------------------------------------------------------------------ rows
    def _write(self, rows: DataFrame, batch: str) -> list[Folder]:
        """Write rows as the batch's folders; what they hold."""
        out = rows.withColumn("ingest_date", F.to_date("timestamp")).withColumn("batch_id", F.lit(batch))
        (out.hint("rebalance", F.col("ingest_date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*PARTITIONS).parquet(self.path))
        return self._written(batch)

    def _written(self, batch: str) -> list[Folder]:
        """The folders of a batch, counted from their files' timestamps."""
        days = [n for n in self.commits.names() if n.startswith("ingest_date=")]
        places = [f"{d}/batch_id={batch}" for d in days if f"batch_id={batch}" in self.commits.names(d)]
        if not places:
            return []
        got = self._scan(places).groupBy("ingest_date").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()
        return [Folder(str(r["ingest_date"]), batch, r["n"], r["a"].isoformat(), r["b"].isoformat()) for r in sorted(got)]

    def _scan(self, places: list[str]) -> DataFrame:
        schema = T.StructType([*TRAIN_POSITIONS.fields, T.StructField("ingest_date", T.DateType()), T.StructField("batch_id", T.StringType())])
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{x}" for x in places])

    def append(self, rows: DataFrame, batch_id: int, source: str = "stream") -> bool:
        """Add a batch of fact rows (``as_fact``), ids given in the order of insertion; False if it is there already."""
        name = f"{source}-{batch_id}"
        rows = rows.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp().cast("timestamp_ntz")))
        for _ in range(TRIES):
            m = self.manifest()
            if m.last.get(source, -1) >= batch_id:
                return False
            base = m.next_id
            numbered = rows.withColumn("id", F.lit(base) + F.monotonically_increasing_id())
            made = self._write(numbered.select(*TRAIN_POSITIONS.fieldNames()), name)
            top = self._scan([f.place for f in made]).agg(F.max("id")).first()[0] if made else None

            def change(now: Manifest) -> bool:
                if now.next_id != base or now.last.get(source, -1) >= batch_id:
                    return False  # another writer has been faster: ids have to be given anew
                now.last[source] = batch_id
                now.next_id = base if top is None else top + 1
                now.live = [f for f in now.live if f.batch != name] + made
                return True

            if self._commit(change):
                return True
        raise RuntimeError(f"{self.path}: batch {name} lost {TRIES} races")

    def read(self, since: datetime | None = None) -> DataFrame:
        """Live rows; with ``since`` only folders that may hold a row so young, and of them the rows that are."""
        live = self.manifest().live
        if since is None:
            return self._scan([f.place for f in live])
        return self._scan([f.place for f in live if datetime.fromisoformat(f.most) >= since]).where(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))

    def newest(self) -> datetime | None:
        """The newest timestamp, from the manifest."""
        return max((datetime.fromisoformat(f.most) for f in self.manifest().live), default=None)

    def latest(self, window: str = "2 minutes", line: str | None = None) -> DataFrame:
        """C2 over the table: opens no folder that lies outside ``window``."""
        newest = self.newest()
        if newest is None:
            return latest_positions(self._scan([]), window, line)
        lower = self.spark.range(1).select((F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {window}")).alias("t")).first()["t"]
        return latest_positions(self.read(lower), window, line, batch_ts=newest)

    def prune(self, as_of: datetime, keep: str) -> Swept:
        """Delete rows older than ``as_of - keep``.

        Rewritten folders get a new name, so a reader of the old manifest never meets half of one.
        """
        cutoff = self.spark.range(1).select((F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {keep}")).alias("t")).first()["t"]
        done: dict[str, list[Folder]] = {}
        fresh: dict[Folder, list[Folder]] = {}

        def change(m: Manifest) -> bool:
            old = [f for f in m.live if datetime.fromisoformat(f.least) < cutoff]
            done["drop"] = [f for f in old if datetime.fromisoformat(f.most) < cutoff]
            done["cut"] = [f for f in old if f not in done["drop"]]
            for f in done["cut"]:
                if f not in fresh:
                    fresh[f] = self._write(self._scan([f.place]).where(F.col("timestamp") >= F.lit(cutoff).cast("timestamp_ntz")).select(*TRAIN_POSITIONS.fieldNames()), f"{f.batch}.{uuid.uuid4().hex[:6]}")
            m.live = [x for f in m.live if f not in done["drop"] for x in fresh.get(f, [f])]
            done["live"] = m.live
            return bool(old)

        self._commit(change)
        self._delete([*done["drop"], *done["cut"]])
        deleted = sum(f.rows for f in done["drop"]) + sum(f.rows - sum(x.rows for x in fresh[f]) for f in done["cut"])
        return Swept(deleted, sum(f.rows for f in done["live"]), done["drop"], done["cut"])

    def compact(self, many: int = MANY_FOLDERS) -> list[str]:
        """Merge the folders of every day that has more than ``many``; the days."""
        by_day: dict[str, list[Folder]] = {}
        for f in self.manifest().live:
            by_day.setdefault(f.day, []).append(f)
        crowded = {d: fs for d, fs in by_day.items() if len(fs) > many}
        for day, folders in crowded.items():
            made = self._write(self._scan([f.place for f in folders]).select(*TRAIN_POSITIONS.fieldNames()), f"merged-{uuid.uuid4().hex[:12]}")

            def change(m: Manifest) -> bool:
                if not set(folders) <= set(m.live):
                    return False  # a sweep took some of them meanwhile: leave the day for the next time
                m.live = [f for f in m.live if f not in folders] + made
                return True

            self._delete(folders if self._commit(change) else made)
        return list(crowded)
