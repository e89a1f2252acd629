"""Page listings and sinks that replace only their own folders."""

import os
import re

from pyspark.sql import functions as F

from spanweave.operators import annotate
from spanweave.sources import pages as src
from tests.test_pipeline import _anno_df


def test_listed_pages_tell_empty_from_missing(spark, tmp_path):
    for name, text in {"City/1.txt": "abc\n", "City/2.txt": "", "Town/1.txt": "é\n", "Old Town+é/4.txt": "", "City/note.md": "x"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    listed = src.list_pages(spark, str(tmp_path))
    assert {(r.category, r.page_id, r.n_bytes) for r in listed.collect()} == {("City", 1, 4), ("City", 2, 0), ("Town", 1, 3), ("Old Town+é", 4, 0)}
    assert src.list_pages(spark, str(tmp_path), "Town").count() == 1
    anno = _anno_df(spark, [(p, "a", 0, 0, 0, 1, p) for p in (1, 2, 3)]).withColumn("category", F.lit("City"))
    got = {r.page_id: r.page_state for r in annotate.page_annotations(anno, listed).collect()}
    assert got == {1: "found", 2: "empty", 3: "missing"}


def test_a_run_replaces_only_its_own_folder(spark, tmp_path):
    root = str(tmp_path / "out")

    def records(category, pages):
        a = _anno_df(spark, [(p, "a", 0, 0, 0, 1, 0) for p in pages]).withColumn("category", F.lit(category))
        return a.withColumn("start_idx", F.col("anno_seq")), annotate.attribute_index(a)

    def written():
        return {(r.out_dir, r.page_id) for r in src.read_predictions(spark, root).collect()}

    for category, pages, model in (("City", [1, 2], "M"), ("Town", [7], "M"), ("City", [5], "N"), ("City", [3], "M")):
        src.write_predictions(*records(category, pages), root, model, "Char")
    assert written() == {("city_m_char", 3), ("town_m_char", 7), ("city_n_char", 5)}


def test_pages_are_written_as_one_plain_file_each(spark, tmp_path):
    """Files of the layout itself, not folders of parts; texts come back byte for byte."""
    root = str(tmp_path / "pages")
    rows = [("City", 1, "a\r\nb"), ("City", 2, "é\n"), ("City", 2, "é\n"), ("_x", 3, "z"), ("a/b", 4, "q"), (None, 5, "n"), ("City", None, "m")]
    pages = spark.createDataFrame(rows, "category string, page_id long, text string").repartition(3)
    assert src.write_pages(pages, root) == 6
    assert src.write_pages(pages, root) == 6  # a task that is run again replaces its files
    files = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)
    assert files == sorted(["City/1.txt", "City/2.txt", "category=_x/3.txt", "a%2Fb/4.txt", "category=__HIVE_DEFAULT_PARTITION__/5.txt",
                            "City/page_id=__HIVE_DEFAULT_PARTITION__.txt"])
    got = {r.page_id: (r.category, r.text) for r in src.read_pages(spark, root).where("category != ''").collect()}
    assert (got[1], got[2], got[3], got[5]) == (("City", "a\r\nb"), ("City", "é\n\né\n"), ("_x", "z"), ("__HIVE_DEFAULT_PARTITION__", "n"))
    assert src.write_pages(pages.where("page_id < 0"), str(tmp_path / "none")) == 0


def test_page_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """The same pages as a scan by Spark, whose driver indexes every file."""
    for name, text in {"City/1.txt": "abc\r\n", "City/2.txt": "", "Old Town+é字%25/4.txt": "é\n", "City/note.md": "x", "_x/5.txt": "hidden", "category=_x/6.txt": "z", "City/.7.txt": "hidden",
                       "a　b/8.txt": "w", "q~!'()@&=$,;[]{}^`|\"<>#?%/9.txt": "s", "deep/er/page_id=3/part-0.txt": "p", "12.txt": "root"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(text.encode("utf-8"))
    scan = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(str(tmp_path), wholetext=True)
    want = {(re.sub("^file:/+", "/", r.p), r.value) for r in scan.select(F.col("_metadata.file_path").alias("p"), "value").collect()}
    assert {(r.path, r.value) for r in src._read_files(spark, str(tmp_path)).collect()} == want and len(want) == 7
    for root, category in ((str(tmp_path), "City"), (f"file://{tmp_path}/", "City")):
        made = src.read_pages(spark, root, category)
        assert [(r.category, r.page_id, r.text) for r in made.collect()] == [("City", 1, "abc\r\n")] and made.inputFiles() == []
    assert src.read_pages(spark, f"{tmp_path}/C*").collect() == src.read_pages(spark, str(tmp_path), "City").collect()
