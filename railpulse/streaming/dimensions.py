"""Dimensions of a stream, built anew only when a table they come from has changed.

The sources are keyed tables, whose newest commit is a number.  ``load`` compares the numbers
with those of the last build: as long as they are the same, a micro-batch gets the
tables stored then; a change of a source shows in the next batch, without a restart.
The build's intermediate folders go when it ends, the stored tables when they are replaced or
the dimensions are closed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railpulse.session import delete_folder, scratch_job, scratch_path
from railpulse.sinks.keyed_table import KeyedTable


class Dimensions:
    """``derive`` makes the dimensions, by name, from the sources' rows, by name."""

    def __init__(self, spark: SparkSession, sources: dict[str, KeyedTable],
                 derive: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]):
        self.spark, self.sources, self.derive = spark, sources, derive
        self.builds = 0
        self._versions: dict[str, int] | None = None
        self._folder: str | None = None
        self._names: list[str] = []

    def load(self) -> dict[str, DataFrame]:
        """The dimensions of the sources' newest commits."""
        versions = {n: t.commits.newest()[0] for n, t in self.sources.items()}
        if versions != self._versions:
            folder = scratch_path(self.spark, f"dimensions-{uuid.uuid4().hex}")
            with scratch_job(self.spark, "dimensions-build"):
                made = self.derive({n: t.read() for n, t in self.sources.items()})
                for name, df in made.items():
                    df.write.parquet(os.path.join(folder, name))
            self.close()
            self._versions, self._folder, self._names = versions, folder, list(made)
            self.builds += 1
        return {n: self.spark.read.parquet(os.path.join(self._folder, n)) for n in self._names}

    def close(self) -> None:
        """Delete the stored dimensions; the next ``load`` builds them again."""
        if self._folder:
            delete_folder(self.spark, self._folder)
        self._versions = self._folder = None
