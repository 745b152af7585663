"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans are the leftmost non-overlapping matches of four patterns (email, ip,
card, phone) that pass their checks; they are the seeds.  Bootstrapping works on
mentions: blank-separated tokens with a digit or an ``@``.

1. Each seed and each mention has a lexical context: the token before it and the
   token behind it, in lower case.  A pattern is a left token, a right token, or
   both together.
2. Patterns and instances (the mention's text) form a graph; an edge says that the
   pattern stood around the instance.  Instances of seeds score 1 for their kind.
   In turn a pattern's score for a kind is the smoothed mean score of its
   instances, and an instance that is no seed scores the noisy-or of its patterns.
   Everything is an aggregation or an equi-join; scores are rounded, so the order
   of a sum decides nothing.
3. A mention that overlaps no base span and has a pattern of high score and enough
   distinct seeds becomes a span of that pattern's kind: the unseen identifiers.

Texts are read once, whole.  Offsets are code points: the text is split at the
matches, and an offset is the sum of the lengths before it, taken in a window over
the matches of one text (so a text with many matches costs no more than a sort).
All patterns are linear in the text: starts inside a run are excluded by
look-behind, and repetitions are possessive.

Defined results: a null or empty text has no spans (counts 0, empty strings hashed
and joined); repeated rows each get their own row; a null doc_id is kept; ties
between kinds go to the kind listed first; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.session import materialize

KINDS = ("email", "ip", "card", "phone")

# The same matches as the plain patterns
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+            of 14 to 19 digits
#   phone  \+[0-9][\x20().0-9-]+[0-9]
# as a run can only begin where a run begins (\G: where the match before it ended).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "mention": None}
CONTEXT_CHARS = 48

MIN_SCORE = 0.9
MIN_SEEDS = 5
ROUNDS = 3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Do the digits pass the Luhn check?"""
    d = F.reverse(_digits(m))
    term = lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    terms = F.transform(F.sequence(F.lit(1), F.length(d)), term)
    return F.aggregate(terms, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _passes(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    small = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"  # at most 255, leading zeros or all zeros
    ip = m.rlike(r"^" + r"\.".join([small] * 4) + r"$")
    return F.when(kind == "ip", ip).when(kind == "card", _luhn(m)).when(kind == "phone", n.between(10, 15)).otherwise(True)


def _tokens(text: Column) -> Column:
    return F.trim(F.translate(F.lower(text), "\t\n\r\f\x0b", "     "))


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Array of matches: kind, place, length of the text between the match before and this one, the match, its context."""
    ms, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(ms.alias("m"), F.slice(gaps, F.lit(1), F.size(ms)).alias("gap"), F.slice(gaps, F.lit(2), F.size(ms)).alias("rest"))
    one = lambda x, i: F.struct(
        F.lit(kind).alias("kind"),
        i.alias("place"),
        F.length(x["gap"]).cast("long").alias("gap"),
        x["m"].alias("m"),
        F.substring_index(_tokens(F.right(x["gap"], F.lit(CONTEXT_CHARS))), " ", -1).alias("left"),
        F.substring_index(_tokens(F.left(x["rest"], F.lit(CONTEXT_CHARS))), " ", 1).alias("right"),
    )
    has = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9@]")
    empty = F.array().cast("array<struct<kind:string,place:int,gap:bigint,m:string,left:string,right:string>>")
    return F.when(has, F.transform(zipped, one)).otherwise(empty)


def mentions(docs: DataFrame) -> DataFrame:
    """A stored table with a row for each match of each text, and one for a text without any.

    Columns: row (of the text), doc_id, kind (null: no match), start, end, m, left, right.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = reduce(F.concat, [_found(F.col("text"), k, p) for k, p in [*PATTERNS.items(), ("mention", MENTION)]])
    each = rows.select("row", "doc_id", found.alias("found")).select("row", "doc_id", F.explode_outer("found").alias("x")).select("row", "doc_id", "x.*")
    stored = materialize(each, "matches")
    upto = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("m")).over(upto)
    return stored.select("row", "doc_id", "kind", (end - F.length("m")).alias("start"), end.alias("end"), "m", "left", "right")


def _order(kind: str = "kind") -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind))


def bootstrap(found: DataFrame, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id, kind, start, end, base of all spans, from what ``mentions`` found."""
    base = found.where(F.col("kind") != "mention").where(_passes(F.col("kind"), F.col("m")))
    both = base.withColumn("base", F.lit(True)).union(found.where("kind = 'mention'").withColumn("base", F.lit(False)))
    own = Window.partitionBy("row").orderBy("start", F.col("base").desc())
    before = F.max(F.when(F.col("base"), F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    # read backwards: a frame that reaches forward is evaluated anew for each row
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("base"))
    behind = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(behind >= F.col("end"), F.lit(True))
    # a mention that overlaps a seed is that seed's own text
    spans = materialize(both.select("*", free.alias("free")).where("base OR free").drop("free"), "spans")

    side = lambda s, c: F.when(F.col(c) != "", F.concat(F.lit(s), F.col(c)))
    both_sides = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("B "), "left", F.lit(" "), "right"))
    patterns = F.array_compact(F.array(side("L ", "left"), side("R ", "right"), both_sides))
    uses = spans.select("*", F.explode(patterns).alias("pattern"))
    instance = F.xxhash64(F.lower("m"))
    edges = uses.select("pattern", instance.alias("instance"), F.when(F.col("base"), F.col("kind")).alias("seed")).distinct()
    # only patterns of seeds can score
    seeds = edges.where("seed IS NOT NULL").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
    edges = materialize(edges.join(seeds.select("pattern").distinct(), "pattern"), "edges")
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    seeds = materialize(seeds.join(sizes, "pattern"), "seeds")
    known = edges.where("seed IS NULL").select("pattern", "instance").join(edges.where("seed IS NOT NULL").select("instance").distinct(), "instance", "left_anti")
    score = seeds.select("pattern", "kind", "seeds", "size", F.round(F.col("seeds") / (F.col("size") + 1), 6).alias("score"))
    for _ in range(rounds - 1):
        guess = known.join(score, "pattern").groupBy("instance", "kind").agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))), 6).alias("p"))
        # kinds compete for an instance
        total = guess.groupBy("instance").agg(F.greatest(F.sum("p"), F.lit(1.0)).alias("total"))
        guess = guess.join(total, "instance").select("instance", "kind", F.round(F.col("p") / F.col("total"), 6).alias("p"))
        more = known.join(guess, "instance").groupBy("pattern", "kind").agg(F.round(F.sum("p"), 4).alias("more"))
        score = materialize(seeds.join(more, ["pattern", "kind"], "left").select("pattern", "kind", "seeds", "size", F.round((F.col("seeds") + F.coalesce("more", F.lit(0.0))) / (F.col("size") + 1), 6).alias("score")), "scores")
    best = Window.partitionBy("pattern").orderBy(F.col("score").desc(), _order())
    high = score.where((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)).select("pattern", "kind", "score", F.row_number().over(best).alias("n")).where("n = 1")
    pick = F.min_by(F.struct("new_kind"), F.struct(-F.col("score"), F.col("o")))["new_kind"]
    ripe = high.select("pattern", F.col("kind").alias("new_kind"), "score", _order().alias("o"))
    new = uses.where("NOT base").join(ripe, "pattern").groupBy("row", "doc_id", "start", "end").agg(pick.alias("kind"))
    return spans.where("base").select("row", "doc_id", "kind", "start", "end", "base").union(new.select("row", "doc_id", "kind", "start", "end", F.lit(False)))


def extract(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row, doc_id and spans, an array of
    (start, place of the kind, kind, end, base) in order."""
    found = mentions(docs)
    all_spans = bootstrap(found, **settings)
    every = found.where("kind IS NULL").select("row", "doc_id", "kind", "start", "end", F.lit(None).cast("boolean").alias("base"))
    rest = found.where("kind IS NOT NULL").select("row", "doc_id").distinct().select("row", "doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("boolean").alias("base"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", _order().alias("o"), "kind", "end", "base"))
    return all_spans.union(every).union(rest).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in square brackets; null texts stay null.

    Spans are joined back by doc_id and a hash of the text, so repeated rows share them.
    """
    columns = docs.columns
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    spans = extract(keyed.select(F.col("_key").alias("doc_id"), "text"), **settings)
    spans = spans.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("_key")).agg(F.min("spans").alias("_spans"))
    # a span that overlaps the one before it starts where that ends
    empty = F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")
    merged = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("upto"), empty.alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["end"]).alias("upto"),
        F.when(s["end"] <= acc["upto"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(F.greatest(s["start"], acc["upto"]).alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))).alias("out")))["out"]
    cut = keyed.join(spans.select("_key", merged.alias("_spans")), "_key", "left")
    previous = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at("_spans", F.greatest(i, F.lit(1)))["end"])
    part = lambda s, i: F.concat(F.substring(F.col("text"), (previous(i) + 1).cast("int"), (s["start"] - previous(i)).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    last = F.element_at("_spans", -1)["end"]
    clean = F.concat(F.array_join(F.transform("_spans", part), ""), F.substring(F.col("text"), (last + 1).cast("int"), F.length("text")))
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns])
