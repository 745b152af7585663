"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import base64
import functools
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of this remainder of crc32(doc_id as text) mod 4 are never learnt from.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents of the fold that training must not see."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4) == HELD_OUT


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read_small_file(path: str, max_bytes: int = 64 << 20) -> bytes:
    """A vocabulary file of the driver, sent to the tasks inside the function
    that uses it; refused beyond ``max_bytes``."""
    with open(path, "rb") as f:
        data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"{path} has more than {max_bytes} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank, from the lines 'base64 rank' of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def once_per_worker(build):
    """Keep what ``build(key, payload)`` made for the last few keys of a Python worker."""
    kept: dict = {}

    @functools.wraps(build)
    def get(key, payload):
        if key not in kept:
            if len(kept) >= 4:
                kept.clear()
            kept[key] = build(key, payload)
        return kept[key]

    return get
