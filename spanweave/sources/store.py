"""Page frames and annotations written once, bucketed alike on the page key.

Cleaned pages are labelled again and again (other annotations, other models,
other evaluations).  Over the store their join with the annotations, and the
grouping of the annotations by page, read bucket by bucket: the page text is
exchanged once, when the store is written, and never again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import PAGE


class PageStore:
    """Tables ``frame`` and ``annotations`` under ``root`` (a folder that all executors share).

    ``buckets`` sets the size of a task of every later join: about the bytes of all
    frames divided by 128 MB.  A store is written once; another one takes another
    folder.  Writing into a folder that holds a store is an error.  The bucket count
    is kept beside the tables, with their columns, so that a later session opens the store by its folder.
    Empty tables and pages without annotations (or the reverse) are stored as they are;
    rows with a null key are stored and meet nothing, as in any join.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._names: dict[str, str] = {}

    def write(self, frame: DataFrame, annotations: DataFrame, buckets: int) -> None:
        if buckets < 1:
            raise ValueError("a store has at least one bucket")
        # The layout comes last: a folder without it is a store that was not finished.
        for part, df in (("frame", frame), ("annotations", annotations)):
            # One task per bucket (the exchange hashes as buckets do), so a bucket is one file.
            df.repartition(buckets, *PAGE).write.format("parquet").bucketBy(buckets, *PAGE).sortBy(*PAGE).option(
                "path", f"{self.root}/{part}").mode("errorifexists").saveAsTable(self._name(part))
        # The columns are kept too, since an empty table has no file that tells them.
        columns = [", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for df in (frame, annotations)]
        self.spark.createDataFrame([(buckets, *columns)], "buckets int, frame string, annotations string").coalesce(1).write.parquet(f"{self.root}/layout")

    def _name(self, part: str) -> str:
        return self._names.setdefault(part, f"page_store_{part}_{uuid.uuid4().hex}")

    def _table(self, part: str) -> DataFrame:
        if part not in self._names:
            layout, keys = self.spark.read.parquet(f"{self.root}/layout").first(), ", ".join(PAGE)
            self.spark.sql(f"CREATE TABLE {self._name(part)} ({layout[part]}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                           f"INTO {layout['buckets']} BUCKETS LOCATION '{self.root}/{part}'")
        return self.spark.table(self._names[part])

    def frame(self) -> DataFrame:
        return self._table("frame")

    def annotations(self) -> DataFrame:
        return self._table("annotations")
