"""Repair of conversation structure on Spark, by the grammar-compressed shortest path of ``repair_grammar``.

``repair`` takes rows (conversation, turn, role, text) and gives, for each conversation,
counts of faults, the cost and the audit of the cheapest edits, and the repaired rows.

1. Rows are dealt by ranges of (conversation, turn, role, digest of the text), sorted and stored once;
   ``pos`` is their global order. A conversation of any length spreads over many
   partitions, and all later steps carry ``pos`` and short columns; texts wait in the
   stored table.
2. A row is a duplicate if its (role, text) stands at a smaller ``pos``: a minimum
   for each (conversation, role, digest), joined back.
3. Symbols of neighbouring rows are put together in blocks of at most ``BLOCK`` rows.
   Re-Pair runs over the different blocks of all conversations: each round counts
   neighbouring symbols on the executors and makes the most frequent pairs rules. The number
   of rules is bounded (``ROUNDS * PER_ROUND``), so the grammar with its matrices is small
   and travels with the tasks.
4. Blocks of a conversation, in order, are folded symbol by symbol: what stays in
   memory is one cost and one rope for each of four states, and at the end the audit,
   which is the result itself.
5. The edits are joined to the stored rows by ``pos``.

Defined results: null roles and texts count as one space (a blank text; a role that is no
lawful one). Rows go by turn, nulls first; rows of one turn go by role, then by the
SHA-256 of the text, so equal rows are neighbours. A null conversation id is a
conversation. An initial is the first character of the role; all but s, u and a count as another.
An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.llm.repair_grammar import BASE, TERMINALS, Fold, Grammar, output, pairs
from railpulse.session import materialize

#: Rows of a block at most.
BLOCK = 4096
#: Rounds of Re-Pair and rules of a round at most.
ROUNDS, PER_ROUND = 8, 48
#: Rows of a record batch that leaves a task.
SLICE = 8192
_SPACE = r"\x20\x09-\x0D"


@dataclass
class Repaired:
    """``conversations``: conv_id, n_rows, blank, duplicate, truncated, illegal, cost, audit.

    ``rows``: conv_id, pos, part (order of the repaired rows), role, text.
    ``stored``: the rows that went in, with pos. ``grammar``: the rules.
    """

    conversations: DataFrame
    rows: DataFrame
    stored: DataFrame
    grammar: Grammar


def _store(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows in their order, with pos, sha, and what a row's own text tells of its fault."""
    own = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    own = own.withColumns({
        "sha": F.unhex(F.sha2(F.col("text").cast("binary"), 256)),
        "blank": ~F.col("text").rlike(f"[^{_SPACE}]"),
        "truncated": F.col("text").rlike(f"[^{_SPACE}.!?][{_SPACE}]*\\z")})
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "sha")]
    return materialize(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "conversation-rows")


def _symbol(fault: Column) -> Column:
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)
    return F.substring(F.lit("".join(chr(BASE + k) for k in range(TERMINALS))), place + fault + 1, F.lit(1))


def _blocks(stored: DataFrame) -> DataFrame:
    """conv_id, start (pos of the first row) and symbols of neighbouring rows of a conversation."""
    light = stored.select("conv_id", "pos", "role", "sha", "blank", "truncated")
    again = light.groupBy("conv_id", "role", "sha").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s"), "first")
    known = light.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("sha") == F.col("_s")), "left")
    fault = F.when(F.col("blank"), 2).when(F.col("pos") > F.col("first"), 3).when(F.col("truncated"), 1).otherwise(0)
    one = known.select("conv_id", "pos", _symbol(fault).alias("symbol"))
    part, place = F.shiftright("pos", 33), F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    blocks = one.groupBy("conv_id", part.alias("part"), F.floor(place / BLOCK).alias("block")).agg(F.min("pos").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("s"))
    return blocks.select("conv_id", "start", F.array_join(F.col("s.symbol"), "").alias("symbols"))


def learn(blocks: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Grammar:
    """Re-Pair over all blocks; each round makes rules of the most frequent neighbours that stand at least twice."""
    kinds = materialize(blocks.groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
    grammar = Grammar()
    for _ in range(rounds):

        def task(batches, grammar=grammar):
            for batch in batches:
                found = pairs(zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()), grammar)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        counted = kinds.mapInArrow(task, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        top = counted.orderBy(F.col("n").desc(), "pair").limit(per_round).collect()
        if not top:
            break
        for row in top:
            grammar.add(*(ord(c) - BASE for c in row["pair"]))
    return grammar


def _fold(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """One row for each conversation (pos null) and one for each of its rows (its edit)."""
    kind = dict(blocks.dtypes)["conv_id"]
    conv_type = blocks.limit(0).select("conv_id").toArrow().schema.field(0).type
    fields = [("conv_id", conv_type), ("pos", pa.int64()), ("before", pa.string()), ("edit", pa.string()), ("new_role", pa.string()), ("after", pa.string()), ("n_rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
    schema = pa.schema(fields)

    def finished(conv, fold, spans, initials):
        cost, audit = fold.end()
        yield (conv, None, None, None, None, None, fold.rows, *fold.faults, fold.unlawful, cost, audit)
        places = (start + k for start, n in spans for k in range(n))
        steps, held = output(audit, "".join(initials)), None
        for step in steps:
            if held is not None:
                yield (conv, next(places), *held, None if step[1] else step[0], *[None] * 7)
            held = step

    def rows(batches):
        conv, fold, spans, initials = None, None, [], []
        for batch in batches:
            for c, start, symbols in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "start", "symbols"))):
                if fold is None or c != conv:
                    if fold is not None:
                        yield from finished(conv, fold, spans, initials)
                    conv, fold, spans, initials = c, Fold(grammar), [], []
                spans.append((start, len(symbols)))
                initials.append("".join("suao"[(ord(s) - BASE) // 4] for s in symbols))
                for s in grammar.compress(symbols):
                    fold.push(ord(s) - BASE)
        if fold is not None:
            yield from finished(conv, fold, spans, initials)

    def task(batches):
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) >= SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(task, f"conv_id {kind}, pos long, before string, edit string, new_role string, after string, n_rows long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _full(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Counts, costs and audits of all conversations, and the repaired rows."""
    stored = _store(rows, conv, turn, role, text)
    blocks = materialize(_blocks(stored), "conversation-blocks")
    grammar = learn(blocks)
    found = materialize(_fold(blocks, grammar), "conversation-edits")
    conversations = found.where(F.col("pos").isNull()).select("conv_id", "n_rows", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = found.where(F.col("pos").isNotNull()).select("pos", "before", "edit", "new_role", "after")
    made = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lambda x: F.struct(_full(x).alias("role"), F.lit("").alias("text")))
    kept = F.when(F.col("edit") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(F.when(F.col("edit") == "R", _full(F.col("new_role"))).otherwise(F.col("role")).alias("role"), F.col("text").alias("text"))))
    out = stored.select("conv_id", "pos", "role", "text").join(edits, "pos")
    out = out.select("conv_id", "pos", F.posexplode(F.concat(made(F.col("before")), kept, made(F.col("after")))).alias("part", "row"))
    return Repaired(conversations, out.select("conv_id", "pos", "part", "row.role", "row.text"), stored, grammar)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, read in order as a stream, never held together."""
    import hashlib

    kind = dict(repaired.dtypes)["conv_id"]
    conv_type = repaired.limit(0).select("conv_id").toArrow().schema.field(0).type

    def task(batches):
        conv, state = None, None
        for batch in batches:
            done = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], conv_type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    ordered = repaired.select("conv_id", "pos", "part", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "pos", "part")
    return ordered.mapInArrow(task, f"conv_id {kind}, repaired_sha256 string")


def gaps(stored: DataFrame) -> DataFrame:
    """conv_id and how many turns between the first and the last are absent; null turns don't count."""
    turns = stored.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("n"))
    wide = F.col("hi").cast("decimal(38,0)") - F.col("lo").cast("decimal(38,0)") + 1 - F.col("n")
    return turns.select("conv_id", F.coalesce(wide, F.lit(0)).cast("decimal(38,0)").try_cast("long").alias("gaps"))
