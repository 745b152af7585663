"""Licence scan: Dice coefficient over word bigrams against licence templates, in DataFrame operations only.

The units of a document are its whole text, each of its lines, and windows of its
words across or within lines.  A unit is normalised (A-Z to a-z, every run of other
characters than a-z and 0-9 to one blank) and becomes its set of word bigrams (a unit
of one word: that word).  With a unit of n bigrams and a template of b,

    Dice = 2 * shared / (n + b)  >=  t    needs    t / (2 - t) * b  <=  n  <=  (2 - t) / t * b

so a template meets only units of the sizes between.  The same bound says that a match
holds more than t / (2 - t) of a template's bigrams.  So whatever words together stand
in more than the rest of them, one of these anchor words occurs in every match, and
texts and lines without an anchor word are left out before their bigrams are made.

Windows.  Each bigram of a text with an anchor word meets the templates that hold it
in a broadcast join; these places are the hits.  A window begins with a hit that
follows no hit (a hit before it could only raise the coefficient), holds at most
(2 - t) / t times the template's positions, and is tried only where the hits needed
lie within that reach; a fold over its places finds the end with the highest
coefficient.  Of windows that share words the one with most shared bigrams stays,
then the higher coefficient.  A window is left out if the whole text, or a line
that it touches, matches under the same name.  Its line is the one where it begins.

Defined results: a null or empty text, and a unit without a word, match nothing;
repeated rows match as often as they occur; line 0 is the whole text, and a text of
one line gives no second unit; of the templates that match a text or line the one with
the highest coefficient counts, of equal ones the first by name; a template of one word
has no windows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railpulse.llm.license_templates import MORE, TEMPLATES
from railpulse.session import materialize

THRESHOLD = 0.8
COMMON = frozenset("a an and any as at be by for from if in is it may not of on or such that the this to under which with you your".split())

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words; a single word stands for itself."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(pairs))


def anchors(texts: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every match of a template holds at least one; long words are taken first, common ones last."""
    chosen: set[str] = set()
    for text in sorted(texts, key=len):
        words = re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()
        grams = set(zip(words, words[1:])) or {(w,) for w in words}
        spare = len(grams) - math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)  # bigrams that a match may lack
        covered = {g for g in grams if chosen & set(g)}
        while len(covered) <= spare:
            left = Counter(w for g in grams - covered for w in set(g))
            best = max(left, key=lambda w: (w not in COMMON, min(len(w), 6), left[w], w))
            chosen.add(best)
            covered |= {g for g in grams if best in g}
    return sorted(chosen)


def _prepared(spark: SparkSession, pairs: list[tuple[str, str]], threshold: float) -> DataFrame:
    """t, license, tb, b, low, high, need, reach of every template: its bigrams, their number, the sizes a unit may have, and for windows the hits needed and the most positions."""
    made = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(pairs)], "t int, license string, text string")
    made = made.withColumn("words", F.split(normalised(F.col("text")), " ")).withColumn("tb", bigrams(F.col("words"))).withColumn("b", F.size("tb"))
    ratio = threshold / (2 - threshold)
    whole = lambda c: c.cast("int")
    low, high, reach = F.ceil(F.col("b") * ratio - 1e-9), F.floor(F.col("b") / ratio + 1e-9), F.floor(F.greatest(F.size("words") - 1, F.lit(1)) / ratio + 1e-9)
    return made.select("t", "license", "tb", "b", whole(low).alias("low"), whole(high).alias("high"), whole(low).alias("need"), whole(reach).alias("reach"))


def _windows(licensed: DataFrame, listed: DataFrame, threshold: float) -> DataFrame:
    """row, license, line, last, shared, dice, n_bigrams: windows of words that match a template, the best ones where they overlap."""
    worded = F.transform(F.split("text", "\n", -1), lambda line, k: F.transform(F.filter(F.split(normalised(line), " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (k + 1).alias("line"))))
    words = licensed.select("row", F.flatten(worded).alias("words"))
    less = F.size("words") - 1
    grams = F.zip_with(F.slice("words", F.lit(1), less), F.slice("words", F.lit(2), less), lambda a, b: F.concat(a["w"], F.lit(" "), b["w"]))
    words = materialize(words.where(F.size("words") > 1).select("row", grams.alias("grams"), F.col("words")["line"].alias("at")), "licensed_words")
    # the places of a template's bigrams, and those from which enough of them stand within reach
    listed = listed.drop("license", "tb", "low", "high"), listed.select("t", F.explode("tb").alias("gram")), listed.select("t", "license")
    hits = words.select("row", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(listed[1]), "gram").groupBy("row", "t").agg(F.sort_array(F.collect_list("pos")).alias("hits"), F.size(F.collect_set("gram")).alias("kinds"))
    # a window shares different bigrams: however often a short text repeats, it holds no more of a long template
    hits = hits.join(F.broadcast(listed[0]), "t").where(F.col("kinds") >= F.col("need")).drop("kinds")
    begins = F.transform("hits", lambda p, k: F.when(((k == 0) | (F.get("hits", k - 1) < p - 1)) & (F.get("hits", k + F.col("need") - 1) - p < F.col("reach")), F.struct(k.alias("k"), p.alias("p"))))
    hits = hits.withColumn("begins", F.filter(begins, lambda x: x.isNotNull())).where(F.size("begins") > 0)
    # for every place the one before with the same bigram, so that a window counts each bigram once
    first, length = F.element_at("begins", 1)["p"], F.element_at("begins", -1)["p"] - F.element_at("begins", 1)["p"] + F.col("reach")
    zones = hits.join(words, "row").withColumn("first", first).withColumn("zone", F.slice("grams", first + 1, length))
    zones = zones.withColumn("zone", F.sort_array(F.transform("zone", lambda g, k: F.struct(g.alias("g"), (k + F.col("first")).alias("p")))))
    shifted = F.slice(F.concat(F.array(F.lit(None).cast("struct<g:string,p:int>")), "zone"), F.lit(1), F.size("zone"))
    before = F.zip_with("zone", shifted, lambda x, y: F.struct(x["p"].alias("p"), F.when(x["g"] == y["g"], y["p"]).otherwise(-1).alias("before")))
    zones = zones.withColumn("before", F.sort_array(before)["before"])
    zones = zones.select("row", "t", "b", "reach", "hits", "at", "first", "before", F.explode("begins").alias("begin"))
    begin = F.col("begin")["p"]

    def step(x: Column, earlier: Column) -> Column:
        hit = F.coalesce(F.get("hits", x["k"]) == x["p"], F.lit(False))
        n, s = x["n"] + (earlier < begin).cast("long"), x["s"] + (hit & (earlier < begin)).cast("long")
        better = hit & (s * (x["bn"] + F.col("b")) > x["bs"] * (n + F.col("b")))
        return F.struct((x["p"] + 1).alias("p"), (x["k"] + hit.cast("int")).alias("k"), n.alias("n"), s.alias("s"), F.when(better, n).otherwise(x["bn"]).alias("bn"), F.when(better, s).otherwise(x["bs"]).alias("bs"), F.when(better, x["p"]).otherwise(x["end"]).alias("end"))

    zero = F.struct(begin.alias("p"), F.col("begin")["k"].alias("k"), *[F.lit(0).cast("long").alias(c) for c in ("n", "s", "bn", "bs")], begin.alias("end"))
    best = zones.withColumn("best", F.aggregate(F.slice("before", begin - F.col("first") + 1, F.col("reach")), zero, step))
    dice = 2 * F.col("shared") / (F.col("n") + F.col("b"))
    found = best.select("row", "t", "b", F.col("best")["bs"].alias("shared"), F.col("best")["bn"].alias("n"), begin.alias("begin"), F.col("best")["end"].alias("end"), "at").withColumn("dice", dice).where(F.col("dice") >= threshold)
    found = found.join(F.broadcast(listed[2]), "t").select("row", "license", "begin", "end", F.get("at", F.col("begin")).alias("line"), F.get("at", F.col("end") + 1).alias("last"), "shared", "dice", "n")
    # of windows that share words the one with most shared bigrams stays, then the higher coefficient
    ordered = Window.partitionBy("row").orderBy("begin", "end", "license")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("opens", F.coalesce(F.col("begin") > reached + 1, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("order"), (-F.col("dice")).alias("minus"), "begin", "license", "end", "line", "last", "shared", "dice", F.col("n").cast("int").alias("n_bigrams"))))
    islands = found.groupBy("row", "island").agg(ranked.alias("ranked"))
    none = F.slice("ranked", 1, 0)
    kept = F.aggregate("ranked", none, lambda have, x: F.when(F.exists(have, lambda y: (x["begin"] <= y["end"] + 1) & (y["begin"] <= x["end"] + 1)), have).otherwise(F.concat(have, F.array(x))))
    return islands.select("row", F.inline(kept)).select("row", "license", "line", "last", "shared", "dice", "n_bigrams")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line, license, dice (six decimals), n_bigrams: the matching units of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    pairs = list(templates.items()) if templates else [*TEMPLATES.items(), *MORE]
    listed = materialize(_prepared(spark, pairs, threshold), "templates")
    least = listed.agg(F.min("low")).first()[0]
    anchor = r"(?i)(?<![a-z0-9])(?:" + "|".join(anchors([t for _, t in pairs], threshold)) + r")(?![a-z0-9])"
    text = F.col("text").cast("string")
    licensed = materialize(docs.where(text.rlike(anchor)).select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")), "licensed")
    lines = F.split("text", "\n", -1)
    units = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.array("text"))
    each = licensed.select("row", F.posexplode(units).alias("line", "unit"))
    # n distinct bigrams need n + 1 words at least, and so 2 n + 1 characters
    each = each.where((F.length("unit") >= 2 * least - 1) & F.col("unit").rlike(anchor)).select("row", "line", F.split(normalised(F.col("unit")), " ").alias("words"))
    each = each.where((F.size("words") >= least) & (F.element_at("words", 1) != "")).select("row", "line", bigrams(F.col("words")).alias("ub"))
    each = each.withColumn("n", F.size("ub"))
    shared = F.size(F.array_intersect("ub", "tb"))
    met = each.join(F.broadcast(listed), F.col("n").between(F.col("low"), F.col("high"))).select("row", "line", "license", "n", "b", shared.alias("shared"))
    dice = 2 * F.col("shared") / (F.col("n") + F.col("b"))
    met = met.where(dice >= threshold).select("row", "line", "license", dice.alias("dice"), F.col("n").alias("n_bigrams"))
    best = F.row_number().over(Window.partitionBy("row", "line").orderBy(F.desc("dice"), "license"))
    met = materialize(met.withColumn("best", best).where("best = 1").drop("best"), "units")
    # windows that a unit does not already say
    seen = met.select(F.col("row").alias("r"), F.col("license").alias("name"), F.col("line").alias("at")).distinct()
    said = (F.col("row") == F.col("r")) & (F.col("license") == F.col("name")) & ((F.col("at") == 0) | F.col("at").between(F.col("line"), F.col("last")))
    more = _windows(licensed, listed, threshold).join(seen, said, "left_anti")
    out = met.unionByName(more.select("row", "line", "license", "dice", "n_bigrams"))
    return out.join(licensed.select("row", "doc_id"), "row").select("doc_id", "line", "license", F.round("dice", 6).alias("dice"), "n_bigrams")
