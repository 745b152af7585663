"""URL filter: fixed rules first, then a tree of path templates per host, in DataFrame operations only.

A url that a rule fits gets the rule's verdict and is a labelled example.  For the
others, templates learnt from the labelled urls of their host decide:

1. Variable segments.  A segment of digits, or one with a long run of them or of
   hexadecimal digits, becomes ``{n}`` or ``{h}`` at once (an extension stays).
   Then level by level, below each branch (host and template so far): where a
   position has more than ``MAX_CHILDREN`` values, those with less than
   ``MIN_SHARE`` of the branch's urls become ``*`` and the band of their own smoothed
   share of blocked urls, so labelled sections stay out of the ``*`` of unlabelled ones.
2. Similar branches.  The children of a branch are grouped by the band of their
   smoothed share of blocked urls; a child joins its band's common branch (``~``
   and the band) unless its own labelled share differs from the band's by more
   than ``Z`` standard errors, in which case it stays by itself.
3. Purity.  A template's share of blocked urls among its labelled ones, smoothed
   towards the share over all hosts with the weight of ``WEIGHT`` urls, rejects the
   template from ``REJECT`` on.

Every position counts.  Where all paths of a branch go on alike, that common part is
taken in one round, so the rounds are as many as a path has forks.  Steps 1 to 3 work on counts of distinct templates, pre-aggregated from all urls; a host with
a third of all urls is a few rows there.  The urls meet their template again in an
equi-join that Spark broadcasts or splits by size.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, and is judged by the template of that empty host (allow, as no rule can
label it); repeated rows are counted and judged each; of rules of equal length the
first listed wins; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.session import materialize

MAX_CHILDREN = 16
MIN_SHARE = 0.05
BANDS = 4
Z = 1.96
WEIGHT = 8.0
REJECT = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, 'host/path') that fits, and its verdict; null where none fits."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _shape(segment: Column) -> Column:
    name, extension = F.regexp_extract(segment, r"\A(.*?)(\.[A-Za-z]{1,5})?\z", 1), F.regexp_extract(segment, r"\A(.*?)(\.[A-Za-z]{1,5})?\z", 2)
    general = F.when(name.rlike(r"\A[0-9]+\z") | name.rlike(r"[0-9]{4,}"), "{n}").when(name.rlike(r"\A[0-9a-fA-F-]{8,}\z") & name.rlike("[0-9]"), "{h}").otherwise(name)
    return F.concat(general, extension)


def _segments(path: Column) -> Column:
    """The shapes of the segments."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _shape)


def templates(labelled: DataFrame) -> DataFrame:
    """host, key, template, purity, from rows of host, key (array of shapes) and verdict (null: not labelled)."""
    counts = labelled.groupBy("host", "key").agg(F.count("*").alias("n"), F.count("verdict").alias("known"), F.count_if(F.col("verdict") == "block").alias("bad"))
    tree = materialize(counts.withColumn("branch", F.lit("")).withColumn("rest", F.col("key")), "branches")
    total = tree.agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).first()
    prior = (total["bad"] or 0) / total["known"] if total["known"] else 0.0
    smooth = lambda bad, known: (bad + F.lit(WEIGHT * prior)) / (known + F.lit(WEIGHT))
    band = lambda bad, known: F.least(F.floor(smooth(bad, known) * BANDS), F.lit(BANDS - 1)).cast("int")
    after = lambda rest, n: F.slice(rest, n + 1, F.size(rest))
    while True:
        # what all paths of a branch have in common is what the first and the last in order have
        ends = tree.groupBy("host", "branch").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        unlike = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
        ends = ends.select("host", "branch", F.when(unlike > 0, unlike - 1).otherwise(F.least(F.size("low"), F.size("high"))).cast("int").alias("alike"))
        on = tree.join(ends, ["host", "branch"]).withColumn("branch", F.concat("branch", F.when(F.col("alike") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("alike")), "/"))).otherwise("")))
        tree = materialize(on.withColumn("rest", after(F.col("rest"), F.col("alike"))).drop("alike"), "branches")
        if tree.where(F.size("rest") > 0).isEmpty():
            break
        here = tree.withColumn("child", F.get("rest", F.lit(0))).withColumn("rest", after(F.col("rest"), F.lit(1)))
        children = here.where("child IS NOT NULL").groupBy("host", "branch", "child").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
        wide = children.groupBy("host", "branch").agg(F.count("*").alias("width"), F.sum("n").alias("all"))
        named = children.join(wide, ["host", "branch"]).withColumn("name", F.when((F.col("width") > MAX_CHILDREN) & (F.col("n") < MIN_SHARE * F.col("all")), F.concat(F.lit("*"), band(F.col("bad"), F.col("known")))).otherwise(F.col("child")))
        named = materialize(named.select("host", "branch", "child", "name", "known", "bad"), "children")
        # similar branches: bands of the smoothed share
        branch = named.groupBy("host", "branch", "name").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
        branch = branch.withColumn("band", band(F.col("bad"), F.col("known")))
        bands = branch.groupBy("host", "branch", "band").agg(F.count("*").alias("width"), F.sum("known").alias("band_known"), F.sum("bad").alias("band_bad"))
        both = branch.join(bands, ["host", "branch", "band"])
        share = smooth(F.col("band_bad"), F.col("band_known"))
        apart = (F.col("known") > 0) & (F.abs(F.col("bad") / F.greatest(F.col("known"), F.lit(1)) - share) > Z * F.sqrt(share * (1 - share) / F.greatest(F.col("known"), F.lit(1))) + WEIGHT / (F.col("known") + WEIGHT))
        merged = both.select("host", "branch", "name", F.when((F.col("width") > 1) & ~apart, F.concat(F.lit("~"), "band")).otherwise(F.col("name")).alias("to"))
        to = named.join(merged, ["host", "branch", "name"]).select("host", "branch", "child", "to")
        tree = here.join(to, ["host", "branch", "child"], "left").withColumn("branch", F.when(F.col("to").isNotNull(), F.concat("branch", F.lit("/"), "to")).otherwise(F.col("branch"))).drop("child", "to")
        tree = materialize(tree, "branches")
    pure = tree.groupBy("host", "branch").agg(F.round(smooth(F.sum("bad"), F.sum("known")), 6).alias("purity"))
    return tree.join(pure, ["host", "branch"]).select("host", "key", F.col("branch").alias("template"), "purity")


def judge(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages``."""
    host, path = host_and_path(F.col(url).cast("string"))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = materialize(parsed.select("*", rule.alias("rule"), verdict.alias("verdict"), _segments(F.col("path")).alias("key")), "urls")
    learnt = templates(parsed)
    rejected = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return parsed.join(learnt, ["host", "key"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", rejected).alias("verdict"), "template", "purity")
