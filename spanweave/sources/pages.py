"""Sources and sinks: page text files, driver tables, JSON-lines annotations
and predictions, and the output folder layout."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PAGE
from ..functions.codepoints import joined_strings
from ..functions.text import split_lines_expr

# {category}/{page_id}.txt, or the folders a partitioned text sink writes for the same.
PAGE_FILE = r"(?:category=)?([^/]+)/(?:page_id=([0-9]+)/[^/]+|([0-9]+))\.txt$"
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")  # as Spark's partitioned sinks escape folder names
ANNOTATION_FILE = r"(?:[^/=]*=)?([^/=]+)_dist\.json(?:/[^/]*)?$"

POS = T.StructType([T.StructField("line_id", T.IntegerType()), T.StructField("offset", T.IntegerType())])
# Field order start, text, end is the order the predictions are written in.
TEXT_OFFSET = T.StructType([
    T.StructField("start", POS),
    T.StructField("text", T.StringType()),
    T.StructField("end", POS),
])
ANNOTATION_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("attribute", T.StringType()),
    T.StructField("text_offset", TEXT_OFFSET),
])


def read_pages(spark: SparkSession, plain_dir: str, category: str | None = None) -> DataFrame:
    """``{category}/{page_id}.txt`` files → pages(category, page_id, text).

    ``wholetext`` reads one row per file; id and category come from the path.
    Zero-length files are skipped by the file scan; ``annotate.page_annotations``
    reports annotated pages that are missing.

    Where Arrow opens the folder, tasks list it and read the files, as Spark's scan would
    (hidden names are passed over, paths are URL-encoded); its index of all files, which
    the driver would hold, is then not made.  Other paths and globs are scanned by Spark.
    """
    root = f"{plain_dir.rstrip('/')}/{category}" if category else plain_dir
    if _opens(root):
        df = _read_files(spark, root)
        path = F.col("path")
    else:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
        path = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(path, PAGE_FILE, 1).alias("category"),
        F.concat(F.regexp_extract(path, PAGE_FILE, 2), F.regexp_extract(path, PAGE_FILE, 3)).cast("bigint").alias("page_id"),
        F.col("value").alias("text"),
    )


def _opens(root: str) -> bool:
    """Whether ``root`` names a folder that Arrow reads."""
    if any(c in root for c in "*?[]{}\\,"):
        return False
    try:
        files, base = fs.FileSystem.from_uri(root)
        return files.get_file_info(base).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ImportError):
        return False


def _url_encoded(path: str) -> str:
    """As Java quotes a path: what is not plain in ASCII, and the blanks and controls beyond it."""
    return re.sub(r"[^\w\-.!~*'(),;:$&+=@/]|[\s\x7f-\xa0]", lambda m: m[0] if ord(m[0]) > 0xA0 and not m[0].isspace() else "".join(f"%{b:02X}" for b in m[0].encode("utf-8")), path)


def _passed_over(name: str) -> bool:
    return name[0] == "." or name.endswith("._COPYING_") or (name[0] == "_" and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


LISTED = 10_000       # files named in one batch
READ_BYTES = 8 << 20  # bytes of texts in one batch


def _read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, value of the text files under ``root`` that are not empty.

    One task lists the root, others what lies in its folders, one folder at a time;
    the names are dealt out and the files read where they come to.
    """
    def entries(files: fs.FileSystem, folder: str, deep: bool) -> Iterator[tuple[str, bool]]:
        folders = [folder]
        while folders:
            for found in files.get_file_info(fs.FileSelector(folders.pop())):
                if _passed_over(found.base_name):
                    continue
                if found.type == fs.FileType.Directory:
                    if deep:
                        folders.append(found.path)
                    else:
                        yield found.path, True
                elif found.base_name.endswith(".txt") and found.size:
                    yield found.path, False

    def batched(rows: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
        while some := list(itertools.islice(rows, LISTED)):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.bool_())], names=["file", "folder"])

    def listed(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = fs.FileSystem.from_uri(root)
            for batch in batches:
                for file, folder in zip(*[c.to_pylist() for c in batch.columns]):
                    yield from batched(entries(files, file or base, deep) if folder else iter([(file, False)]))
        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(root)

        def made(paths: list[str], texts: list[bytes]) -> pa.RecordBatch:
            at = np.append(0, np.cumsum([len(t) for t in texts]))
            return pa.RecordBatch.from_arrays([pa.array([_url_encoded(x) for x in paths], pa.string()), joined_strings(at, b"".join(texts))], names=["path", "value"])

        paths, texts, size = [], [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with files.open_input_stream(file) as f:
                    text = f.read()
                paths.append(file)
                texts.append(text)
                size += len(text)
                if size >= READ_BYTES:
                    yield made(paths, texts)
                    paths, texts, size = [], [], 0
        if paths:
            yield made(paths, texts)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.range(1).select(F.lit(None).cast("string").alias("file"), F.lit(True).alias("folder")).coalesce(1).mapInArrow(listed(False), "file string, folder boolean")
    names = top.repartition(n, "file").mapInArrow(listed(True), "file string, folder boolean").select("file")
    return names.repartition(n, "file").mapInArrow(read, "path string, value string")


def write_pages(pages: DataFrame, root: str) -> int:
    """pages(category, page_id, text) → ``{category}/{page_id}.txt`` under ``root``, a folder that all executors share.

    The tasks write the files themselves: Spark's partitioned sink makes a folder for
    every page, which its committer moves one by one on the driver.  A file is written
    under a hidden name and then renamed, so a task that is run again replaces whole
    files.  Rows with one key share a file, a line feed between them; null texts are
    empty.  Folders that Spark would pass over (null, ``_x``, ``.x``) get the prefix
    ``category=``; null ids are named as Spark's sinks name them.  Returns the number of files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        written, now, texts = 0, None, []

        def close() -> int:
            category, page_id = now
            name = ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", category) if category else NULL_NAME
            folder = f"{base.rstrip('/')}/{'category=' if name[0] in '_.' else ''}{name}"
            if folder not in made:
                files.create_dir(folder)
                made.add(folder)
            held = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(held) as out:
                out.write("\n".join(texts).encode("utf-8"))
            files.move(held, f"{folder}/{f'page_id={NULL_NAME}' if page_id is None else page_id}.txt")
            return 1

        for batch in batches:
            for category, page_id, text in zip(*[batch.column(i).to_pylist() for i in range(2)], batch.column(2)):
                if (category, page_id) != now:
                    written += close() if now else 0
                    now, texts = (category, page_id), []
                texts.append(text.as_py() or "")
        written += close() if now else 0
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    dealt = pages.select(*PAGE, "text").repartition(*PAGE).sortWithinPartitions(*PAGE)
    return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def pages_from_documents(documents: DataFrame) -> DataFrame:
    """Driver table binding: documents(doc_id, text, source) → pages."""
    return documents.select(
        F.col("source").alias("category"),
        F.col("doc_id").alias("page_id"),
        F.col("text"),
    )


def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver documents as pages.

    ``spark.spanweave.inputPartitions`` deals out a file of one row group, which Spark
    cannot split; only local sessions for small test files set it.
    """
    pages = pages_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    parts = spark.conf.get("spark.spanweave.inputPartitions", None)
    return pages.repartition(int(parts)) if parts else pages


def list_pages(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """category, page_id, n_bytes of every page file, empty ones included (their text has no row in ``read_pages``).

    Only the files' names and lengths are read.  A scan skips files without content,
    so the names come from the driver's file index (which holds every scanned folder's
    files anyway), the lengths from a scan of the metadata; a file without one is empty.
    """
    folder = f"{path.rstrip('/')}/{category or '*'}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.txt$", 1).alias("category"),
                         F.regexp_extract("path", r"([^/]+)\.txt$", 1).cast("bigint").alias("page_id"), *[c for c in df.columns if c != "path"])

    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string")  # URL-encoded, unlike the scan's
    names = named(listed.select(F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("path")))
    lengths = named(files.select("path", F.col("length").alias("n_bytes")))
    return names.join(lengths, PAGE, "left").select(*PAGE, F.coalesce("n_bytes", F.lit(0).cast("bigint")).alias("n_bytes"))


def split_lines(pages: DataFrame) -> DataFrame:
    """pages → lines(category, page_id, line_id, line); lines keep their newline."""
    return pages.select(
        *PAGE,
        F.posexplode(split_lines_expr(F.col("text"))).alias("line_id", "line"),
    ).withColumn("line_id", F.col("line_id").cast("int"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``{category}_dist.json`` files: gold spans with their category and a file-order ordinal.

    The category is the file name's; a directory of such files holds several.
    A line that does not parse is an error, not a row of nulls.  ``anno_seq`` is the annotation's position among the annotations of its
    page in file order (later annotations win on overlap).  Row order inside a
    split plus the split's byte offset and the file path give a total order
    consistent with the file; the per-page rank only shuffles annotations.
    """
    df = spark.read.schema(ANNOTATION_SCHEMA).option("mode", "FAILFAST").json(path)
    df = df.withColumn("category", F.regexp_extract(F.col("_metadata.file_path"), ANNOTATION_FILE, 1))
    order_key = F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("m"),
    )
    df = df.withColumn("_ord", order_key)
    w = Window.partitionBy(*PAGE).orderBy("_ord")
    return df.withColumn("anno_seq", (F.row_number().over(w) - 1).cast("bigint")).drop("_ord")


def write_predictions(records: DataFrame, attributes: DataFrame, root: str, model: str, block: str, mode: str = "overwrite") -> None:
    """Records as JSON-lines under ``{root}/{category}_{model}_{block}``, in the order of the original.

    Overwriting replaces the folders that the records belong to; those of other
    categories, models and block modes stay as they are.
    Pages in the string order of their file name, then attribute index, then
    position.  A range exchange and a sort give that order over the part files
    (whose names sort alike); nothing is gathered into one task.  Non-ASCII
    characters are written as is.
    """
    r = records.join(attributes, ["category", "attribute"], "left")
    order = ["category", F.concat(F.col("page_id").cast("string"), F.lit(".txt")), "attr_idx", "start_idx"]
    laid = output_layout(r, None, model, block)
    ranged = laid.repartitionByRange(*order).sortWithinPartitions("out_dir", *order)
    ranged.select("page_id", "title", "attribute", "text_offset", "out_dir").write.mode(mode).partitionBy("out_dir").option(
        "partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").json(root)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*ANNOTATION_SCHEMA.fields, T.StructField("out_dir", T.StringType())])).option(
        "mode", "FAILFAST").json(path)


def output_layout(df: DataFrame, category: str | None, model: str, block: str) -> DataFrame:
    """Output partition keys: lower-cased category, model and block mode."""
    cat = F.lower(F.col("category")) if category is None else F.lit(category.lower())
    return df.withColumn("out_category", cat) \
        .withColumn("out_model", F.lit(model.lower())) \
        .withColumn("out_block", F.lit(block.lower())) \
        .withColumn("out_dir", F.concat_ws("_", "out_category", "out_model", "out_block"))


def write_partitioned(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Overwriting replaces only the partition folders that ``df`` has rows for."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("out_category", "out_model", "out_block").json(root)
