"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode`` adds the ids of every whole text, ``decode`` turns ids back into raw
bytes, ``transcode`` does both in one pass over the rows.  The rank file is read
once on the driver (its size is checked) and travels to the tasks as a broadcast
variable; each Python worker builds its encoder once.

Long texts are cut before they reach the library, only where the pattern puts a
boundary whatever stands around it, so the ids are those of the uncut text:

* between a letter or digit and a character of another kind that is not the
  same run (a match never reaches from a letter or digit into anything else);
* before the last blank of a run of blanks, and before the run itself.

So no piece handed to the library holds a long run of blanks together with the
character behind it, which its regex engine cannot backtrack over.

Defined results: a null or empty text has no ids (an empty array) and decodes to
empty bytes; null ids decode to empty bytes; repeated rows are each encoded;
other columns pass through, and an existing column named like an output is
replaced.  Ids without a rank raise KeyError.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from railpulse.llm.common import digest, once_per_worker, parse_ranks, read_small_file

#: Texts up to this many characters go to the library whole unless they hold a long run of blanks.
PIECE_CHARS = 16_384
#: A run of at least so many blanks is always cut off.
BLANK_RUN = 256

_BLANKS = regex.compile(r"\s{%d,}" % BLANK_RUN)
# a position between a letter or digit and something that continues no run of it
_SAFE = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


def cut(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of ``text`` whose ids, one after the other, are those of ``text``."""
    start = 0
    for run in _BLANKS.finditer(text):
        yield from _cut_run(text, start, run.start(), size)
        # the pattern gives all but the last blank one match; at the end of a text, all of them
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start():last]
        start = last
    yield from _cut_run(text, start, len(text), size)


def _cut_run(text: str, start: int, end: int, size: int) -> Iterator[str]:
    while end - start > size:
        m = _SAFE.search(text, start + size, end)
        if m is None or m.start() >= end:
            break
        yield text[start:m.start()]
        start = m.start()
    if end > start:
        yield text[start:end]


@once_per_worker
def _encoder(key: str, payload: tuple[bytes, str]):
    import tiktoken

    data, pattern = payload
    return tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})


def encode_text(encoder, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= PIECE_CHARS and _BLANKS.search(text) is None:
        return encoder.encode_ordinary(text)
    return [i for piece in cut(text) for i in encoder.encode_ordinary(piece)]


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` without columns named like ``new``, and those of ``new`` behind."""
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() not in new]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(new.values()), names=[batch.schema.names[i] for i in kept] + list(new))


def _schema(df: DataFrame, new: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n for n, _ in new}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + [T.StructField(n, t) for n, t in new])


def _slices(batch: pa.RecordBatch, column: str, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Small parts of a batch, so that the ids of long texts never pile up in a worker."""
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield part, part.column(batch.schema.get_field_index(column)).to_pylist()


def _shared(df: DataFrame, ranks_path: str, pattern: str | None):
    import public_tokenizers

    data = read_small_file(ranks_path)
    return digest(data), df.sparkSession.sparkContext.broadcast((data, pattern or public_tokenizers.PATTERN))


def _ids(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def encode(df: DataFrame, ranks_path: str, text: str = "text", pattern: str | None = None) -> DataFrame:
    """``df`` with a column ``ids``: array<int>, the ids of the whole text."""
    key, shared = _shared(df, ranks_path, pattern)

    def task(batches):
        enc = _encoder(key, shared.value)
        for batch in batches:
            for part, texts in _slices(batch, text):
                yield _with(part, {"ids": _ids([encode_text(enc, t) for t in texts])})

    return df.mapInArrow(task, _schema(df, [("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", pattern: str | None = None) -> DataFrame:
    """``df`` with a column ``decoded``: binary, the raw bytes of the ids (they may not be whole characters)."""
    key, shared = _shared(df, ranks_path, pattern)

    def task(batches):
        enc = _encoder(key, shared.value)
        for batch in batches:
            for part, rows in _slices(batch, ids):
                yield _with(part, {"decoded": pa.array([enc.decode_bytes(r or []) for r in rows], pa.binary())})

    return df.mapInArrow(task, _schema(df, [("decoded", T.BinaryType())]))


def transcode(df: DataFrame, ranks_path: str, text: str = "text", pattern: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass: columns ``ids`` and ``decoded``."""
    key, shared = _shared(df, ranks_path, pattern)

    def task(batches):
        enc = _encoder(key, shared.value)
        for batch in batches:
            for part, texts in _slices(batch, text):
                ids = [encode_text(enc, t) for t in texts]
                yield _with(part, {"ids": _ids(ids), "decoded": pa.array([enc.decode_bytes(r) for r in ids], pa.binary())})

    return df.mapInArrow(task, _schema(df, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())]))
