"""Corpus pipeline: raw documents to a training mix in five stages.

Each stage takes (spark, docs, sf_dir) with ``docs`` as its predecessor wrote it
and returns a DataFrame; all but the last return the columns of ``docs``.

Stages, and what their decisions do:

1. quality rules: documents that the rules reject go;
2. SimHash near-duplicates: of each group the document with the smallest id stays
   (null ids last; among repeated rows the first read);
3. benchmark decontamination: documents that overlap a benchmark item go;
4. secret scan: every occurrence of a found secret is replaced in its text;
5. mixing: one row per document with how often the mix takes it.

Stages 1 and 2 need a decision per row, not per id, since ids may be null or
repeated.  Stage 1 carries the documents through the pass that takes their
statistics and decides in the row.  Stage 2 numbers the rows in a copy written to
the shared folder, decides on narrow columns, and joins the numbers back.  Joins
that bring a decision back to the texts are sort-merge joins at every size: what
they join with grows with the documents, so it must not be broadcast because a
small input happens to allow it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import mixing, risk_rules, secret_forest, simhash_trie, spaced_seed
from spanweave.llm.common import materialize, table

ROW = "__pipeline_row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # no name of the documents clashes with the operator's
    judged = risk_rules.judge_quality(docs.toDF(*names.values()), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", names["doc_id"]),
                                      names["doc_id"], names["text"], names["lang"], keep=tuple(n for c, n in names.items() if c != "doc_id"))
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-near")  # read again, never computed again
    grouped = simhash_trie.near_duplicates(numbered, keep=(ROW,))
    # Components of null ids only have no id; their fingerprints cannot be told apart by it, so the root names a group.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", ROW))
    kept = grouped.groupBy("group_fp").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return numbered.join(materialize(kept, "pipeline-firsts").hint("merge"), ROW, "left_semi").drop(ROW)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    overlaps = spaced_seed.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return spaced_seed.remove_contaminated(docs, overlaps)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_forest.redact(docs, secret_forest.find_secrets(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("source_mix", source_mix),
]

#: The stages on risk-controlled cutoffs, SimHash components and a random forest
#: have no SQL form; tests/llm/test_pipeline.py checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
