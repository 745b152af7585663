"""Packing token pieces into fixed-length sequences: shortest pack first over the length histogram.

A document's ids (with an end id behind) are cut into pieces of ``seq_len`` and
one remainder.  Packing looks only at the histogram of piece lengths, which has
at most ``seq_len`` bins whatever the corpus: from the longest length to the
shortest, all pieces of a length go to the pack patterns that are shortest so
far (a new pattern where none has room), and only the counts of patterns change.
The patterns then meet the pieces again by rank: the r-th piece of a length takes
the r-th place that the patterns keep for that length.

Ranks need no ordering of the whole corpus and no task that sees a whole length.
Each length is dealt into as many salts as its share of the shuffle partitions
asks for; a piece's rank is its place within (length, salt) plus the pieces of
the length's earlier salts, which a second small count gives.  What reaches the
driver is bounded by ``seq_len`` bins and a few counts a partition.

Defined results: a null or empty text has the end id alone; a null doc_id is
kept; repeated rows are packed as often as they occur; an empty table gives no
pieces.  Sequence ids run from 0 and every sequence is gapless from offset 0.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.byte_bpe import BLANK_RUN, PIECE_CHARS, cut
from railpulse.llm.common import digest, once_per_worker, read_small_file, shuffle_partitions
from railpulse.session import materialize

SEQ_LEN = 1024
END_ID = 0

PIECES = "start long, length long, ids binary, doc_tokens long"

# Characters on which the two libraries that know this vocabulary split alike
# (tests/llm compares them); a text with any other goes through the slower one.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞₠-₿]*+")
_LONG_BLANKS = regex.compile(r"\s{%d,}" % BLANK_RUN)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1
    characters stand for themselves, the other bytes for 256, 257, ... in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class JsonTokenizer:
    """Ids of a byte-level BPE vocabulary in a tokenizers file.

    ``tokenizers`` itself encodes about 1.3 MB a second and core; the same
    vocabulary read as ranks by tiktoken gives the same ids about four times as
    fast.  Texts outside the characters for which that is tested go through
    ``tokenizers``.
    """

    def __init__(self, data: bytes):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(data)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_str(data.decode())
        self.exact.encode_special_tokens = True  # their strings in a text are ordinary text

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if _PLAIN.fullmatch(text) is None:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) <= PIECE_CHARS and _LONG_BLANKS.search(text) is None:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.concatenate([self.fast.encode_to_numpy(p, disallowed_special=()) for p in cut(text)]).astype("<u4", copy=False)


@once_per_worker
def _tokenizer(key: str, data: bytes) -> JsonTokenizer:
    return JsonTokenizer(data)


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens."""
    data = read_small_file(tokenizer_path)
    key, shared = digest(data), docs.sparkSession.sparkContext.broadcast(data)

    def task(batches):
        tok = _tokenizer(key, shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                row, start, length, ids, total = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    all_ids = np.append(tok.ids(text), np.uint32(end_id)).astype("<u4", copy=False)
                    for s in range(0, len(all_ids), seq_len):
                        piece = all_ids[s:s + seq_len]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece))
                        ids.append(piece.tobytes())
                        total.append(len(all_ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(task, f"doc_id {kind}, {PIECES}")


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack in order, number of such packs), shortest pack first.

    Each step adds a length to whole groups of equal packs or splits one group,
    so there are at most two groups a bin of the histogram.
    """
    shortest: list[tuple[int, int, tuple[int, ...], int]] = []  # (filled, tie, lengths, packs)
    done: list[tuple[tuple[int, ...], int]] = []
    tie = 0

    def keep(filled: int, lengths: tuple[int, ...], n: int) -> None:
        nonlocal tie
        tie += 1
        if filled == seq_len:
            done.append((lengths, n))
        else:
            heapq.heappush(shortest, (filled, tie, lengths, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not shortest or shortest[0][0] + length > seq_len:
                keep(length, (length,), left)
                break
            filled, _, lengths, n = heapq.heappop(shortest)
            took = min(left, n)
            if took < n:
                keep(filled, lengths, n - took)
            keep(filled + length, (*lengths, length), took)
            left -= took
    return done + [(lengths, n) for _, _, lengths, n in sorted(shortest)]


class Places:
    """Which sequence and offset the r-th piece of a length takes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        first, by_length = 0, {}
        for lengths, n in patterns:
            offset = 0
            for length in lengths:
                by_length.setdefault(length, []).append((n, first, offset))
                offset += length
            first += n
        self.of = {}
        for length, rows in by_length.items():
            n, seq, offset = (np.array(c, np.int64) for c in zip(*rows))
            self.of[length] = (np.cumsum(n) - n, seq, offset)

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, seq, offset = self.of[length]
        k = np.searchsorted(begin, rank, side="right") - 1
        return seq[k] + rank - begin[k], offset[k]


def pack(rows: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``rows`` (one per piece: doc_id, start, length, ...) with sequence_id and offset.

    The rows are read three times; hand in a stored table.
    """
    spark = rows.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < length <= seq_len for length in histogram):
        raise ValueError(f"a piece has from 1 to {seq_len} ids")
    places = Places(plan(histogram, seq_len))

    # a length gets a salt for each quarter of a shuffle partition that its rows would fill
    share = max(1, sum(histogram.values()) // (4 * shuffle_partitions(spark)))
    salts = spark.createDataFrame([(length, -(-n // share)) for length, n in histogram.items()], "length long, _salts long")
    dealt = rows.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), "_salts").cast("int"))
    counts = dealt.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()  # at most seq_len + four a partition
    before: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["_salt"])):
        before[r["length"], r["_salt"]] = seen.get(r["length"], 0)
        seen[r["length"]] = seen.get(r["length"], 0) + r["n"]
    shared = spark.sparkContext.broadcast((places, before))

    columns = [c for c in rows.columns if c.lower() not in ("sequence_id", "offset")]
    ranked = dealt.select(*columns, "_salt", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[F.col(c) for c in ("doc_id", "start")], F.xxhash64(*columns))).alias("_rank"))

    def task(batches):
        where, first = shared.value
        for batch in batches:
            at = batch.schema.get_field_index
            length, salt, rank = (batch.column(at(c)).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            key = length * (1 << 32) + salt
            order = np.argsort(key, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(own):
                    n, s = int(length[own[0]]), int(salt[own[0]])
                    seq[own], offset[own] = where.find(n, rank[own].astype(np.int64) - 1 + first[n, s])
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in columns] + [pa.array(seq), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)
    return ranked.mapInArrow(task, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from packed pieces that carry ``ids``: sequence_id, length, ids.

    A sequence has at most ``seq_len`` ids, so a group is bounded.
    """
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(own, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length")).select("sequence_id", "length", "ids")


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, derive=None) -> DataFrame:
    """Tokenise, cut and pack whole documents.

    ``derive`` maps the table of pieces to the columns that are worth carrying
    through the shuffle (by default all, ids included).
    """
    cut_up = pieces(docs, tokenizer_path, seq_len, end_id)
    return pack(materialize(derive(cut_up) if derive else cut_up, "pieces"), seq_len)
