"""Secret scan over every historical version of a path, by a ledger of content-addressed blobs.

A version's text is a blob, named by its SHA-256. The ledger is a folder of Parquet
batches::

    <ledger>/paths/batch=<id>   path, blob: every version ever handed in
    <ledger>/scans/batch=<id>   blob, rules, spans: what was scanned by which rule versions

``Ledger.scan`` names the blobs of a batch, takes away the (blob, rule version) pairs that
the ledger already has, scans each blob that is left once, by the rules it lacks, and
records the pairs, also those without a finding. A rule's version is a digest of its
definition, so a changed rule is a new rule and only that one runs over old blobs.
``Ledger.report`` joins the findings back to all paths.

* Only names are joined with the ledger. Texts move once at most, one text for each blob
  and task: if the blobs to be scanned are few (a count decides, ``BROADCAST_BLOBS``), their
  names are sent to the texts and everything else is dropped in place.
* Copies of a text meet as one row for each task and blob, and in the join back as short rows
  that adaptive execution can split; a blob that a third of all versions hold is no
  hot spot.
* A batch's folders are overwritten when the batch is run again, and its own earlier
  entries don't count as seen, so a retried batch ends in the same state.

Matching is on UTF-8 bytes, leftmost and without overlap for each kind; a match that fails
the rule's test is dropped and not tried again. All patterns hold ASCII at their ends, and
offsets are counted in code points, end exclusive. Each pattern reads a text in linear time.

Defined results: a null text is empty; an empty text is a blob like any other. Repeated
(path, text) rows stay as many rows, null paths too. Spans come by start, then in the order
of the rules. An empty table gives no rows and an empty batch. Other columns of the
input pass through ``report`` only if they belong to ``keys``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many names of blobs (about 100 bytes each) are sent to all tasks at most.
BROADCAST_BLOBS = 50_000

SPANS = "array<struct<rule:string,kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, ``test`` must fit the whole match; one of ``hints`` (lower case) stands in every text that matches."""

    kind: str
    pattern: str
    test: str
    hints: tuple[str, ...] = ()
    base: bool = False

    @property
    def version(self) -> str:
        return self.kind + "-" + hashlib.sha256("\0".join((self.pattern, self.test)).encode()).hexdigest()[:12]


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAME = "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
_ASSIGNED = _NAME + """["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9+/_.=-]"""

#: The kinds in the order of spans that start at one place.
RULES = (
    Rule("assign", _ASSIGNED + "+", _ASSIGNED + "{6,}", ("passw", "secret", "token", "api"), base=True),
    Rule("access", "AKIA[A-Z0-9]+", "[A-Z0-9]{20,}", ("akia",), base=True),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]+", base=True),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-.+-", ("private key-----",)),
    Rule("jwt", "eyJ[A-Za-z0-9_.-]+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35}", ("aiza",)),
    Rule("login", """://[^\\x00-\\x20/:@"'<>]+:[^\\x00-\\x20/@"'<>]+@""", "(?s:.+)", ("://",)),
)


def find(data: bytes, rules: list[tuple]) -> list[tuple[str, str, int, int]]:
    """(rule version, kind, start, end) of the compiled ``rules`` in a text, in code points, rule by rule."""
    lower, found = None, []
    for version, kind, pattern, test, hints in rules:
        if hints:
            lower = data.lower() if lower is None else lower
            if not any(h in lower for h in hints):
                continue
        for m in pattern.finditer(data):
            if test.fullmatch(m.group()):
                found.append((version, kind, *m.span()))
    if found and not data.isascii():
        chars, at, n = {}, 0, 0
        for b in sorted({b for f in found for b in f[2:]}):
            n += len(data[at:b].decode("utf-8", "replace"))
            chars[b], at = n, b
        found = [(v, k, chars[s], chars[e]) for v, k, s, e in found]
    return found


def compiled(rules: tuple[Rule, ...]) -> list[tuple]:
    return [(r.version, r.kind, re.compile(r.pattern.encode()), re.compile(r.test.encode()), tuple(h.encode() for h in r.hints)) for r in rules]


def blob(text: str | Column = "text") -> Column:
    """The name of a text's blob."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(c.cast("string"), F.lit("")).cast("binary"), 256)


def _scanner(rules: tuple[Rule, ...]):
    def task(batches):
        known = {r[0]: r for r in compiled(rules)}
        for batch in batches:
            texts, missing = batch.column("text"), batch.column("missing").to_pylist()
            rows = [find(t.as_buffer().to_pybytes() if t.is_valid else b"", [known[v] for v in lacks]) for t, lacks in zip(texts.cast(pa.large_binary()), missing)]
            spans = [[dict(zip(("rule", "kind", "start", "end"), f)) for f in row] for row in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("blob"), batch.column("missing"),
                pa.array(spans, pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["blob", "rules", "spans"])

    return task


class Ledger:
    """The ledger in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame | None:
        """All batches of a part; None before the first."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{part}")

    def paths(self) -> DataFrame | None:
        """Every version ever handed in: the keys, blob and batch."""
        if self._read("paths", "blob string") is None:
            return None
        where = f"{self.path}/paths"
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.option("mergeSchema", "true").parquet(where).schema if f.name != "batch")
        return self.spark.read.schema(f"{kept}, batch string").parquet(where)

    def scans(self) -> DataFrame | None:
        """blob, rules, spans, batch: what has been scanned."""
        return self._read("scans", f"blob string, rules array<string>, spans {SPANS}")

    def scan(self, versions: DataFrame, batch: str, keys: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
        """Record a batch of versions (``keys`` name a path's version); the number of blobs that had to be scanned."""
        if {"blob", "batch", "spans"} & set(keys):
            raise ValueError("keys can't be named blob, batch or spans")
        named = versions.select(*keys, blob(text).alias("blob"))
        named.write.mode("overwrite").parquet(f"{self.path}/paths/batch={batch}")
        wanted = F.array(*[F.lit(r.version) for r in rules]).cast("array<string>")
        own = self.spark.read.parquet(f"{self.path}/paths/batch={batch}").select("blob").distinct()
        earlier = self.scans()
        if earlier is None:
            todo = own.withColumn("missing", wanted)
        else:
            seen = earlier.where(F.col("batch") != batch).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
            lacks = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
            todo = own.join(seen, "blob", "left").select("blob", lacks.alias("missing")).where(F.size("missing") > 0)
        todo_at = f"{self.path}/todo/batch={batch}"
        todo.write.mode("overwrite").parquet(todo_at)
        todo = self.spark.read.parquet(todo_at)
        count = todo.count()
        texts = versions.select(blob(text).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        if count <= BROADCAST_BLOBS:
            fresh = texts.join(F.broadcast(todo), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("missing").alias("missing"))
        else:
            fresh = texts.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
        found = fresh.select("blob", "text", "missing").mapInArrow(_scanner(rules), f"blob string, rules array<string>, spans {SPANS}")
        found.write.mode("overwrite").parquet(f"{self.path}/scans/batch={batch}")
        return count

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and spans (rule, kind, start, end; by start, then in the rules' order) of all blobs where something was found."""
        order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.version), F.lit(k))])
        scans = self.scans()
        kept = F.filter("spans", lambda s: order[s["rule"]].isNotNull())
        one = scans.select("blob", kept.alias("spans")).where(F.size("spans") > 0)
        # a pair may stand in several batches (one ran while another was being written): each span counts once
        merged = one.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], order[s["rule"]].alias("place"), s["rule"], s["kind"], s["end"])))
        return merged.select("blob", F.transform(by_place, lambda s: F.struct(s["rule"], s["kind"], s["start"], s["end"])).alias("spans"))

    def report(self, batch: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Every recorded version (of one batch, or of all) with its spans, an empty array without a finding."""
        paths = self.paths() if batch is None else self.spark.read.parquet(f"{self.path}/paths/batch={batch}")
        found = paths.join(self.findings(rules), "blob", "left")
        return found.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
