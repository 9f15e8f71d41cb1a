"""Model tables by name under one folder.

A table that is replaced has versions (see :mod:`tickerloom.sources.versions`); one that is appended to is a plain folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tickerloom.sources.versions import Versions


class Tables:
    """``keep`` is the number of versions that stay of a replaced table; without it all stay until they are vacuumed.

    A reader of a version that goes fails, so where others read while tables are replaced, enough are to be kept.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int | None = None):
        self.spark, self.keep = spark, keep
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def versions(self, name: str) -> Versions:
        return Versions(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        versions = self.versions(name)
        return versions.read() if versions.exists() else self.spark.read.parquet(self.path(name))

    def read_or_empty(self, name: str, schema: str) -> DataFrame:
        """The table, or no rows while nothing has been written to it."""
        versions = self.versions(name)
        if versions.exists():
            return versions.read()
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Full refresh.  Readers see the old rows until all new ones are there; of two writers at once the later one fails."""
        stored = self.versions(name).replace(df)
        self.tidy(name)
        return stored

    def tidy(self, name: str) -> None:
        """Delete the versions of a table that are not to stay."""
        if self.keep:
            self.versions(name).vacuum(self.keep, strays=False)

    def replace_parts(self, name: str, df: DataFrame, parts: Iterable[str] | None = None, *more: DataFrame, gather: bool = True,
                      each: Iterable[tuple[str, DataFrame]] = ()) -> list[str]:
        """Refresh of the named parts alone; ``df`` and ``more`` have theirs in the column ``_part``, no part in two of them or in ``each``."""
        written = self.versions(name).replace_parts(df, parts, None, *more, gather=gather, each=each)
        self.tidy(name)
        return written

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(name))

    def view(self, name: str, df: DataFrame) -> DataFrame:
        """Register a model that is not stored."""
        df.createOrReplaceTempView(name)
        return df
