"""Order-dependent running average ``acc = (acc + x) div 2`` (A6) over keys of any size.

The fold starts from a key's first value.  A run of values is a function of the
accumulator before it: monotone, and after ``BLOCK`` halvings it takes at most two
values over all integers between the key's minimum and maximum, ``low`` below a
threshold and ``high`` from it on.  So each key is cut into ordered blocks of
``BLOCK`` values, every block becomes such a function, and functions compose: ``BLOCK``
neighbours at a time, level by level, until one per key is left.  The last block of a
key is folded from the accumulator that the others give; the first one starts the
fold, so what it hands on is a number.

Keys of up to ``SHORT`` values, counted first, are folded in one aggregation over their
sorted values.  Longer ones are never gathered: their rows are dealt by ranges of (key, order), so a hot key lies
in many partitions; a row's rank is its place within (key, partition) plus the rows
of the key's earlier partitions; and every collected list has ``BLOCK`` items at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.session import materialize

#: 2 ** BLOCK must exceed the range of a key's values; 64 does for any bigint.
BLOCK = 64
#: A list of so many values of one key at most is held by a task.
SHORT = 16 * BLOCK


def _fold(xs: Column, start: Column) -> Column:
    # arithmetic shift right by one == floor division by two (Python ``//``)
    return F.aggregate(xs, start.cast("bigint"), lambda a, x: F.shiftright(a + x, 1))


def _threshold(xs: Column, lo: Column, hi: Column, high: Column) -> Column:
    """The smallest start from ``lo`` to ``hi`` that folds to ``high``, by bisection."""
    ends = F.struct(lo.alias("a"), hi.alias("b"))  # a folds to less, b to ``high``
    halve = lambda s, _: F.when(s["b"] - s["a"] <= 1, s).otherwise(
        F.when(_fold(xs, F.shiftright(s["a"] + s["b"], 1)) >= high,
               F.struct(s["a"].alias("a"), F.shiftright(s["a"] + s["b"], 1).alias("b")))
        .otherwise(F.struct(F.shiftright(s["a"] + s["b"], 1).alias("a"), s["b"].alias("b"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), ends, halve)["b"]


def _apply(f: Column, a: Column) -> Column:
    return F.when(a >= f["from"], f["high"]).otherwise(f["low"])


def _ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_rank`` (from 0) within each key."""
    dealt = materialize(df.repartitionByRange(*keys, *order).withColumn(
        "_part", F.spark_partition_id()), "fold-rows")
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_c")
    counts = counts.select(*keys, "_part", before.alias("_before"))
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    return dealt.join(counts, [*keys, "_part"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(own) - 1).drop("_part", "_before")


def halving_fold(df: DataFrame, keys: list[str], order: list[str], value: str,
                 out: str = "folded", extra_aggs: tuple[Column, ...] = ()) -> DataFrame:
    """keys..., ``n`` (values folded per key), extra aggregates, ``out`` (bigint).

    Keys and values must not be null; rows that tie in ``order`` must have equal values.
    """
    df = materialize(df, "fold-input")
    long = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SHORT)
                       .select(*keys), "fold-long")
    if long.isEmpty():
        return _fold_short(df, keys, order, value, out, extra_aggs)
    short = _fold_short(df.join(long, keys, "left_anti"), keys, order, value, out, extra_aggs)
    return short.unionByName(_fold_long(df.join(long, keys, "left_semi"), keys, order, value, out, extra_aggs))


def _fold_short(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                extra_aggs: tuple[Column, ...]) -> DataFrame:
    """Keys of at most ``SHORT`` values: one list each."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("bigint").alias("_v"))))
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *extra_aggs, listed.alias("_xs"))
    extra = [c for c in got.columns if c not in (*keys, "n", "_xs")]
    xs = F.transform("_xs", lambda s: s["_v"])
    return got.select(*keys, "n", *extra, _fold(F.slice(xs, 2, SHORT), F.element_at(xs, 1)).alias(out))


def _fold_long(df: DataFrame, keys: list[str], order: list[str], value: str,
               out: str, extra_aggs: tuple[Column, ...]) -> DataFrame:
    """Keys of any size, block by block."""
    v = F.col(value).cast("bigint")
    rows = _ranked(df, keys, order)
    ranked = materialize(rows.select("*", F.floor(F.col("_rank") / BLOCK).alias("_block")), "fold-ranked")
    stats = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("_lo"),
                                      F.max(v).alias("_hi"), *extra_aggs)
    extra = [c for c in stats.columns if c not in (*keys, "n", "_lo", "_hi")]
    values = ranked.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.struct("_rank", v.alias("_v")))).alias("_xs"))
    values = values.join(stats, keys).withColumn("_xs", F.transform("_xs", lambda s: s["_v"]))
    last = F.floor((F.col("n") - 1) / BLOCK)
    values = materialize(values.withColumn("_last", last), "fold-blocks")

    tail = values.where(F.col("_block") == F.col("_last"))
    blocks = int(values.agg(F.max("_last")).first()[0] or 0)  # of the longest key, but its last
    first = _fold(F.slice("_xs", 2, BLOCK), F.element_at("_xs", 1))
    if not blocks:
        return tail.select(*keys, "n", *extra, first.alias(out))
    low, high = _fold(F.col("_xs"), F.col("_lo")), _fold(F.col("_xs"), F.col("_hi"))
    step = F.when(F.col("_block") == 0, F.struct(first.alias("low"), first.alias("high"), F.col("_lo").alias("from"))
                  ).otherwise(F.struct(low.alias("low"), high.alias("high"), F.when(
                      low < high, _threshold(F.col("_xs"), F.col("_lo"), F.col("_hi"), high)
                  ).otherwise(F.col("_lo")).alias("from")))
    steps = values.where(F.col("_block") < F.col("_last")).select(*keys, "_block", step.alias("_f"))
    while True:
        after = lambda s, f: F.struct(_apply(f, s["low"]).alias("low"),
                                      _apply(f, s["high"]).alias("high"), s["from"].alias("from"))
        fs = F.transform("_fs", lambda s: s["_f"])
        steps = (steps.groupBy(*keys, F.floor(F.col("_block") / BLOCK).alias("_block"))
                 .agg(F.sort_array(F.collect_list(F.struct("_block", "_f"))).alias("_fs"))
                 .select(*keys, "_block", F.aggregate(F.slice(fs, 2, BLOCK), F.element_at(fs, 1), after).alias("_f")))
        blocks = -(-blocks // BLOCK)
        if blocks == 1:
            break
    start = steps.select(*keys, F.col("_f.low").alias("_start"))  # it begins with the first block, so low == high
    return tail.join(start, keys, "left").select(*keys, "n", *extra, F.when(
        F.col("_start").isNull(), first).otherwise(_fold(F.col("_xs"), F.col("_start"))).alias(out))
