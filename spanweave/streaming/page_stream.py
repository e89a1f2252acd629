"""Structured Streaming: tag page files as they arrive in a folder.

Prediction over a folder of ``{category}/{page_id}.txt`` files, run
incrementally: every new file is one whole page, so a micro-batch is a set of
complete pages and the batch plan (clean → characters → score → spans) needs
no state across batches.  Each micro-batch appends JSON-lines predictions;
progress and exactly-once bookkeeping live in the checkpoint location, a
required argument, since every stream needs one of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import PAGE, TextParams
from ..operators import chars, spans


def read_page_stream(spark: SparkSession, plain_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming pages(category, page_id, text) from new text files."""
    df = (spark.readStream.format("text")
          .option("wholetext", "true")
          .option("maxFilesPerTrigger", max_files_per_trigger)
          .load(f"{plain_dir.rstrip('/')}/*/*.txt"))
    path = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+\.txt$", 1).alias("category"),
        F.regexp_extract(path, r"([^/]+)\.txt$", 1).cast("bigint").alias("page_id"),
        F.col("value").alias("text"),
    )


def tag_pages(pages: DataFrame, params: TextParams,
              scorer: Callable[[DataFrame], DataFrame], context: int = 1) -> DataFrame:
    """Batch plan for one set of whole pages → flat predicted span records."""
    lines = chars.clean_lines(pages, params)
    kept = chars.kept_chars(lines, params, context=context)
    sp = spans.decode_spans(scorer(kept)).join(chars.page_info(pages, params).drop("n_lines"), PAGE)
    return spans.span_records(sp).select("page_id", "title", "attribute", "text_offset")


def start_prediction_stream(spark: SparkSession, plain_dir: str, out_dir: str, params: TextParams,
                            scorer: Callable[[DataFrame], DataFrame], checkpoint: str,
                            trigger_once: bool = False) -> StreamingQuery:
    """Start the query; every micro-batch appends the predictions of its pages."""
    pages = read_page_stream(spark, plain_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on replay: idempotent
        tag_pages(batch, params, scorer).write.mode("overwrite").json(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    w = pages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
