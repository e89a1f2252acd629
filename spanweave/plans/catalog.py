"""Registered queries (Spark) and their DuckDB oracle statements.

Each entry: name → (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None).
tables (or what Spark derives from them) in full.  Doubles are rounded to 6
places on both sides; integer widths are cast explicitly.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PAGE, fixture_params
from ..functions import text as tx
from ..functions.codepoints import list_parts
from ..operators import annotate, block_model, blocks, chars, evaluate, examples, scoring, spans, splits
from ..sources import fixtures as fx
from ..sources.store import PageStore
from ..session import bounded_broadcast, checkpointed, ensure_checkpoint_dir
from ..sources.pages import (
    load_pages, output_layout, read_annotations, read_pages, read_predictions, split_lines, write_pages, write_partitioned, write_predictions,
)
from . import oracle as O
from .extract import Corpus, extract_spans, flat_records, set_spans

P = fixture_params()                                           # char mode, cap 2047
P510 = fixture_params(variant="vocab", max_length=512)         # char mode, cap 510
PLINE = fixture_params(mode="line", variant="vocab", max_length=512)  # line mode, cap 510
P26 = fixture_params(header_last=26)                           # the original header cut

REGISTRY: dict[str, tuple] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _pages(spark, d):
    return load_pages(spark, d)


def _corpus(spark, d, p=P):
    return Corpus(_pages(spark, d), p)


def _gold(spark, d):
    return fx.fixture_annotations(_pages(spark, d))


def _pred(spark, d):
    return fx.fixture_predictions(_gold(spark, d))


W = O.with_
BASE = O.base()

# ----------------------------------------------------------------- 2.1 sources


def _folder(spark, name):
    """A new folder under the one that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("read_pages", "SELECT doc_id AS page_id, source AS category, text FROM documents WHERE length(text) > 0")
def q_read_pages(spark, d):
    """Round trip: the pages written as one text file per page, named {category}/{page_id}.txt, and read back."""
    path = _folder(spark, "pages")
    write_pages(_pages(spark, d).where(F.length("text") > 0), path)
    return read_pages(spark, path).select("page_id", "category", "text")


@register("split_lines", W(O.raw_lines_cte()) + "SELECT page_id, line_id, line FROM raw_lines")
def q_split_lines(spark, d):
    return split_lines(_pages(spark, d)).select("page_id", "line_id", "line")


@register("read_annotations", W(O.raw_lines_cte(), O.anno_cte()) +
          """SELECT category, page_id, attribute, sl, so, el, eo, text,
  CAST(row_number() OVER (PARTITION BY category, page_id ORDER BY anno_seq) - 1 AS BIGINT) AS anno_seq FROM anno""")
def q_read_annotations(spark, d):
    """The gold spans as {category}_dist.json files, a page's spans in order, read back with their ordinals."""
    path = _folder(spark, "annotations")
    gold = _gold(spark, d).withColumn("file", F.concat("category", F.lit("_dist.json")))
    gold.repartition("file", "page_id").sortWithinPartitions("file", "page_id", "anno_seq").select(
        "page_id", "title", "attribute", "text_offset", "file").write.partitionBy("file").option("ignoreNullFields", "false").json(path)
    return annotate.span_bounds(read_annotations(spark, path)).select(
        "category", "page_id", "attribute", "sl", "so", "el", "eo", "text", "anno_seq")


@register("output_layout", """SELECT doc_id AS page_id, lower(source) || '_shiba_char' AS out_dir, lower(source) AS out_category,
  'shiba' AS out_model, 'char' AS out_block FROM documents""")
def q_output_layout(spark, d):
    """Page ids written under the partition folders and read back with the folders' columns."""
    path = _folder(spark, "layout")
    write_partitioned(output_layout(_pages(spark, d).select(*PAGE), None, "Shiba", "Char").drop("category"), path)
    return spark.read.schema("page_id bigint, out_dir string, out_category string, out_model string, out_block string").json(path)


# ------------------------------------------------------- 2.2 page-text operators


@register("page_title", W(O.raw_lines_cte(), O.title_cte(P)) + "SELECT page_id, title FROM titles")
def q_page_title(spark, d):
    return chars.page_info(_pages(spark, d), P).select("page_id", "title")


def _blank_query(step, fn):
    sql = W(O.raw_lines_cte(), O.prefixed_lines_cte(), O.clean_ctes(steps=(step,), src="prefixed")) + "SELECT page_id, line_id, line FROM clean"

    def run(spark, d):
        return fx.prefixed_lines(_pages(spark, d)).select("page_id", "line_id", fn(F.col("line")).alias("line"))
    return run, sql


for _name, _step, _fn in [
    ("blank_caret_lines", "caret", tx.blank_caret),
    ("blank_hosts", "host", lambda c: tx.blank_regex(c, tx.HOST_PATTERN)),
    ("blank_file_refs", "file", lambda c: tx.blank_regex(c, tx.FILE_PATTERN)),
    ("blank_fixed_phrases", "phrases",
     lambda c: tx.blank_literal(tx.blank_literal(c, tx.NAV_PHRASE), tx.CREDIT_PHRASE)),
]:
    _run, _sql = _blank_query(_step, _fn)
    REGISTRY[_name] = (_run, _sql)


@register("blank_urls", W(O.raw_lines_cte(), O.prefixed_lines_cte(), O.clean_ctes(steps=("url",), src="prefixed")) + f"""
SELECT page_id, line_id, line FROM clean UNION ALL SELECT page_id, -1, {O.blank_sql('url', tx.URL_PATTERN)} FROM pages""")
def q_blank_urls(spark, d):
    """Lines with several URLs of different lengths, and the URLs of the crawled pages (as line -1)."""
    lines = fx.prefixed_lines(_pages(spark, d)).select("page_id", "line_id", "line")
    urls = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.lit(-1).alias("line_id"), F.col("url").alias("line"))
    return lines.unionByName(urls).select("page_id", "line_id", tx.blank_regex(F.col("line"), tx.URL_PATTERN).alias("line"))


@register("clean_lines", W(O.raw_lines_cte(), O.clean_ctes()) + "SELECT page_id, line_id, line FROM clean")
def q_clean_lines(spark, d):
    return _corpus(spark, d).lines.select("page_id", "line_id", "line")


@register("footer_trigger", W(O.raw_lines_cte(), O.prefixed_lines_cte(), O.clean_ctes(src="prefixed")) +
          f"SELECT page_id, line_id, ({O.trigger_sql(P)}) AS trigger FROM clean")
def q_footer_trigger(spark, d):
    line = tx.clean_line(F.col("line"))
    return fx.prefixed_lines(_pages(spark, d)).select("page_id", "line_id", line.alias("line")).select(
        "page_id", "line_id", tx.footer_trigger(F.col("line"), P.footer_regex, P.footer_headings).alias("trigger"))


@register("footer_cut", W(BASE) + "SELECT page_id, cut AS footer_line FROM trig")
def q_footer_cut(spark, d):
    pf = chars.page_frame(_pages(spark, d), P)
    return pf.select("page_id", F.when(F.col("footer_line") >= 0, F.col("footer_line")).alias("footer_line"))


@register("header_cut", W(O.base(P26)) + "SELECT page_id, line_id FROM body WHERE in_body")
def q_header_cut(spark, d):
    return _corpus(spark, d, P26).lines.where("in_body").select("page_id", "line_id")


@register("whitespace_drop", W(BASE) + """SELECT r.page_id, r.line_id,
  CAST(count(*) FILTER (WHERE NOT regexp_matches(r.ch, """ + O.q("^" + tx.WS_CLASS + "$") + """)) AS INTEGER) AS n_kept
  FROM rawchars r GROUP BY r.page_id, r.line_id""")
def q_whitespace_drop(spark, d):
    return _corpus(spark, d).lines.select("page_id", "line_id", tx.kept_count(F.col("line")).cast("int").alias("n_kept"))


@register("kept_chars", W(BASE) + 'SELECT page_id, line_id, "offset", ch FROM kept')
def q_kept_chars(spark, d):
    return _corpus(spark, d).chars.select("page_id", "line_id", "offset", "ch")


# ------------------------------------------------- 2.3 character table, blocks


@register("explode_chars", W(BASE) + 'SELECT page_id, line_id, "offset", char_idx, ch FROM rawchars')
def q_explode_chars(spark, d):
    return chars.explode_chars(_corpus(spark, d).lines).drop("category")


@register("raw_char_index", W(BASE) + "SELECT page_id, line_id, CAST(char_base AS BIGINT) AS char_base FROM body")
def q_raw_char_index(spark, d):
    return _corpus(spark, d).lines.select("page_id", "line_id", "char_base")


@register("kept_char_index", W(BASE) + 'SELECT page_id, line_id, "offset", new_char_idx FROM kept')
def q_kept_char_index(spark, d):
    return _corpus(spark, d).chars.select("page_id", "line_id", "offset", "new_char_idx")


@register("blocks_by_char", W(O.base(P510)) + "SELECT page_id, new_char_idx, block_id, block_idx FROM kept")
def q_blocks_by_char(spark, d):
    return _corpus(spark, d, P510).chars.select("page_id", "new_char_idx", "block_id", "block_idx")


@register("blocks_by_line", W(O.base(PLINE)) +
          'SELECT page_id, line_id, "offset", new_char_idx, block_id, block_idx FROM kept')
def q_blocks_by_line(spark, d):
    return _corpus(spark, d, PLINE).chars.select(
        "page_id", "line_id", "offset", "new_char_idx", "block_id", "block_idx")


@register("block_stats", W(O.base(P510)) + """SELECT page_id, block_id, count(*) AS n_chars,
  min(new_char_idx) AS first_idx, max(new_char_idx) AS last_idx FROM kept GROUP BY page_id, block_id""")
def q_block_stats(spark, d):
    c = _corpus(spark, d, P510)
    return chars.block_stats_narrow(c.frame, P510).drop("category")


# ------------------------------------------------------ 2.4 annotation operators

ANNO = W(BASE, O.anno_cte(), O.cells_ctes())


@register("attribute_index", W(O.raw_lines_cte(), O.anno_cte()) +
          "SELECT category, attribute, CAST(row_number() OVER (PARTITION BY category ORDER BY attribute) - 1 AS INTEGER) AS attr_idx "
          "FROM (SELECT DISTINCT category, attribute FROM anno)")
def q_attribute_index(spark, d):
    return annotate.attribute_index(_gold(spark, d))


@register("page_annotations", W(O.raw_lines_cte(), O.anno_cte()) +
          """SELECT a.category, a.page_id, a.attribute, a.anno_seq,
  CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN coalesce(length(d.text), 0) = 0 THEN 'empty' ELSE 'found' END AS page_state
  FROM anno a LEFT JOIN documents d ON d.doc_id = a.page_id AND d.source = a.category""")
def q_page_annotations(spark, d):
    return annotate.page_annotations(_gold(spark, d), _pages(spark, d)).select(*PAGE, "attribute", "anno_seq", "page_state")


@register("expand_spans", ANNO +
          'SELECT page_id, line_id, "offset", attribute, anno_seq, bio, ch, new_char_idx FROM cells')
def q_expand_spans(spark, d):
    c = _corpus(spark, d)
    return annotate.expand_spans(_gold(spark, d), c.frame, P).select(
        "page_id", "line_id", "offset", "attribute", "anno_seq", "bio", "ch", "new_char_idx")


@register("resolve_overlaps", ANNO + """SELECT page_id, line_id, "offset", attribute,
  arg_max(bio, anno_seq) AS bio FROM cells GROUP BY page_id, line_id, "offset", attribute""")
def q_resolve_overlaps(spark, d):
    c = _corpus(spark, d)
    return annotate.resolve_overlaps(annotate.expand_spans(_gold(spark, d), c.frame, P)) \
        .select("page_id", "line_id", "offset", "attribute", "bio")


@register("label_chars", ANNO +
          'SELECT page_id, attribute, new_char_idx, bio, line_id, "offset", ch, prev_ch FROM labels')
def q_label_chars(spark, d):
    return _corpus(spark, d).labels(_gold(spark, d)).select(
        "page_id", "attribute", "new_char_idx", "bio", "line_id", "offset", "ch", "prev_ch")


@register("annotated_pages", W(O.raw_lines_cte(), O.anno_cte()) + "SELECT DISTINCT category, page_id FROM anno")
def q_annotated_pages(spark, d):
    return annotate.annotated_pages(_gold(spark, d))


# ----------------------------------------------------------- 2.6 split / sample

SPLIT_SQL = W(O.raw_lines_cte(), O.anno_cte(), O.splits_cte())


def _split(annotations):
    return splits.split_pages(annotate.annotated_pages(annotations), n_train=fx.N_TRAIN, n_valid=fx.N_VALID)


@register("split_pages", SPLIT_SQL + "SELECT category, page_id, tvt FROM splits")
def q_split_pages(spark, d):
    return _split(_gold(spark, d))


@register("holdout_merge", SPLIT_SQL + "SELECT category, page_id, tvt FROM splits WHERE tvt IN ('valid', 'test')")
def q_holdout_merge(spark, d):
    return splits.holdout_merge(_split(_gold(spark, d)))


@register("split_annotations", SPLIT_SQL +
          "SELECT a.category, a.page_id, a.attribute, a.anno_seq, s.tvt FROM anno a JOIN splits s USING (category, page_id)")
def q_split_annotations(spark, d):
    g = _gold(spark, d)
    return splits.split_annotations(g, checkpointed(_split(g))).select(*PAGE, "attribute", "anno_seq", "tvt")


# ----------------------------------------------------------- 2.8 span decoding

SPAN_COLS = "page_id, attribute, start_idx, end_idx, start_line, start_offset, end_line, end_offset, text"
GOLD_SPANS = W(BASE, O.anno_cte(), O.cells_ctes(), O.dense_spans_ctes())


def _pred_ctes() -> str:
    pred = O.anno_cte(pred=True)
    gold_part, pred_part = pred.split(",\nanno AS (", 1)
    return ",\n".join([BASE, gold_part, "p_anno AS (" + pred_part, "anno AS (SELECT * FROM gold_anno)",
                       O.cells_ctes(), O.cells_ctes("p_"), O.dense_spans_ctes(), O.dense_spans_ctes("p_")
                       .replace(O.ATTRS, "")])


EVAL = W(_pred_ctes())


@register("bio_transitions", GOLD_SPANS + """SELECT page_id, attribute, new_char_idx, bio,
  prev_bio IN ('B','I') AND bio IN ('B','O') AS "insert", bio = 'B' OR (prev_bio = 'O' AND bio = 'I') AS "start",
  bio IN ('B','I') AS "end" FROM trans WHERE bio <> 'O' OR prev_bio <> 'O'""")
def q_bio_transitions(spark, d):
    return spans.bio_transitions(_corpus(spark, d).labels(_gold(spark, d), carry=("n_kept",))).drop("category")


@register("decode_spans", EVAL + f"SELECT {SPAN_COLS} FROM p_spans")
def q_decode_spans(spark, d):
    return _corpus(spark, d).spans_of(_pred(spark, d)).drop("category")


@register("span_text", GOLD_SPANS + "SELECT page_id, attribute, start_idx, text FROM spans")
def q_span_text(spark, d):
    return _corpus(spark, d).spans_of(_gold(spark, d)).select("page_id", "attribute", "start_idx", "text")


@register("stored_spans", GOLD_SPANS + f"SELECT {SPAN_COLS} FROM spans")
def q_stored_spans(spark, d):
    """Gold spans over a store of page frames and annotations, which meet bucket by bucket."""
    store = PageStore(spark, _folder(spark, "store"))
    store.write(_corpus(spark, d).frame, _gold(spark, d), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    labels = annotate.label_chars(store.annotations(), store.frame(), P)
    return spans.decode_spans(labels).drop("category")


@register("span_records", W(BASE, O.title_cte(P), O.anno_cte(), O.cells_ctes(), O.dense_spans_ctes()) +
          """SELECT s.page_id, t.title, s.attribute, s.start_line, s.start_offset, s.end_line, s.end_offset, s.text
  FROM spans s LEFT JOIN titles t USING (page_id)""")
def q_span_records(spark, d):
    return extract_spans(_pages(spark, d), _gold(spark, d), P).select(
        "page_id", "title", "attribute", "start_line", "start_offset", "end_line", "end_offset", "text")


@register("write_predictions", W(BASE, O.title_cte(P), O.anno_cte(), O.cells_ctes(), O.dense_spans_ctes(), """ai AS (
  SELECT category, attribute, row_number() OVER (PARTITION BY category ORDER BY attribute) - 1 AS attr_idx
  FROM (SELECT DISTINCT category, attribute FROM gold_anno))""") +
          """SELECT s.page_id, t.title, s.attribute, s.start_line, s.start_offset, s.end_line, s.end_offset, s.text,
  lower(d.source) || '_shiba_char' AS out_dir,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY CAST(s.page_id AS VARCHAR) || '.txt', ai.attr_idx, s.start_idx) - 1 AS BIGINT) AS place
  FROM spans s LEFT JOIN titles t USING (page_id) JOIN documents d ON d.doc_id = s.page_id
  JOIN ai ON ai.category = d.source AND ai.attribute = s.attribute""")
def q_write_predictions(spark, d):
    """Gold span records written in the original's order and layout, read back with their place in the files."""
    path = _folder(spark, "predictions")
    g = _gold(spark, d)
    write_predictions(_corpus(spark, d).records(g), annotate.attribute_index(g), path, "Shiba", "Char")
    back = read_predictions(spark, path).withColumn("_at", F.struct(
        F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")))
    w = Window.partitionBy("out_dir").orderBy("_at")
    return flat_records(back, "out_dir", (F.row_number().over(w) - 1).cast("bigint").alias("place"))


# ------------------------------------------------------------- 2.9 evaluation

MATCH_SQL = """matches AS (
  SELECT coalesce(g.page_id, p.page_id) AS page_id, coalesce(g.attribute, p.attribute) AS attribute,
         coalesce(g.start_idx, p.start_idx) AS start_idx, coalesce(g.end_idx, p.end_idx) AS end_idx,
         g.page_id IS NOT NULL AND p.page_id IS NOT NULL AS tp,
         g.page_id IS NOT NULL AND p.page_id IS NULL AS fn,
         g.page_id IS NULL AND p.page_id IS NOT NULL AS fp
  FROM spans g FULL OUTER JOIN p_spans p
    ON g.page_id = p.page_id AND g.attribute = p.attribute AND g.start_idx = p.start_idx AND g.end_idx = p.end_idx
),
eval_pages AS (SELECT DISTINCT s.page_id FROM splits s JOIN documents d ON d.doc_id = s.page_id AND d.source = s.category
               WHERE s.tvt IN ('valid', 'test')),
prf AS (
  SELECT e.page_id, CAST(coalesce(sum(CASE WHEN m.tp OR m.fn THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_gold,
         CAST(coalesce(sum(CASE WHEN m.tp OR m.fp THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_pred,
         CAST(coalesce(sum(CASE WHEN m.tp THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp
  FROM eval_pages e LEFT JOIN matches m USING (page_id) GROUP BY e.page_id
),
prf2 AS (
  SELECT page_id, n_gold, n_pred, tp,
         CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
         CASE WHEN n_gold = 0 THEN 0.0 ELSE tp / n_gold END AS recall,
         CASE WHEN n_gold + n_pred = 0 THEN 0.0 ELSE 2.0 * tp / (n_gold + n_pred) END AS f1
  FROM prf
)"""
EVAL_FULL = W(_pred_ctes(), O.splits_cte("gold_anno"), MATCH_SQL)


def _matches(spark, d):
    """Matches of gold spans and their perturbed copies: one expansion, one decode."""
    return evaluate.match_sets(set_spans(_corpus(spark, d), fx.fixture_gold_and_pred(_gold(spark, d))))


def _holdout_pages(spark, d, sp=None):
    """The hold-out pages that exist."""
    sp = _tagger_split(spark, d) if sp is None else sp
    return sp.where(F.col("tvt") != "train").join(_pages(spark, d).select(*PAGE), PAGE, "left_semi").select(*PAGE)


@register("gold_spans", GOLD_SPANS + f"SELECT {SPAN_COLS} FROM spans")
def q_gold_spans(spark, d):
    return _corpus(spark, d).spans_of(_gold(spark, d)).drop("category")


@register("span_matches", EVAL_FULL + "SELECT page_id, attribute, start_idx, end_idx, tp, fn, fp FROM matches")
def q_span_matches(spark, d):
    return _matches(spark, d).drop("category")


@register("page_prf", EVAL_FULL + """SELECT page_id, n_gold, n_pred, tp, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf2""")
def q_page_prf(spark, d):
    pages = checkpointed(_holdout_pages(spark, d))
    r = evaluate.page_prf(_matches(spark, d).join(pages, PAGE, "left_semi"), pages)
    return r.select("page_id", "n_gold", "n_pred", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


EPOCHS_SQL = """elog AS (
  SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS epoch,
         value / 500.0 AS valid_f1
  FROM events
),
best AS (
  SELECT run, epoch, valid_f1,
         valid_f1 > greatest(0.0, coalesce(max(valid_f1) OVER (PARTITION BY run ORDER BY epoch
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS improved
  FROM elog
),
best2 AS (
  SELECT *, greatest(0.0, max(valid_f1) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)) AS best_valid_f1,
         max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last_imp,
         min(epoch) OVER (PARTITION BY run) AS first_epoch
  FROM best
),
best3 AS (
  SELECT run, epoch, valid_f1, improved, best_valid_f1, CAST(coalesce(last_imp, 0) AS INTEGER) AS best_epoch,
         CAST(CASE WHEN last_imp IS NULL THEN epoch - first_epoch + 1 ELSE epoch - last_imp END AS INTEGER) AS since_best
  FROM best2
),
ran AS (
  SELECT * FROM best3
  QUALIFY coalesce(max(CASE WHEN since_best >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
)"""


@register("mean_loss", """SELECT user_id AS run, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
  CAST(count(*) AS BIGINT) AS n_batches, round(avg(value / 100.0), 6) AS train_loss
  FROM events GROUP BY ALL""")
def q_mean_loss(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    m = evaluate.mean_loss(fx.batch_log(ev))
    return m.select("run", F.col("epoch").cast("int"), F.col("n_batches").cast("bigint"),
                    F.round("train_loss", 6).alias("train_loss"))


@register("best_epoch", W(EPOCHS_SQL) + """SELECT run, epoch, round(valid_f1, 6) AS valid_f1, improved,
  round(best_valid_f1, 6) AS best_valid_f1, best_epoch, since_best FROM best3""")
def q_best_epoch(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    b = evaluate.best_epoch(fx.epoch_log(ev))
    return b.select("run", "epoch", F.round("valid_f1", 6).alias("valid_f1"), "improved",
                    F.round("best_valid_f1", 6).alias("best_valid_f1"), "best_epoch", "since_best")


@register("early_stop", W(EPOCHS_SQL) + """SELECT run, CAST(count(*) AS BIGINT) AS epochs_run,
  min(CASE WHEN since_best >= 10 THEN epoch END) AS stop_epoch, arg_max(best_epoch, epoch) AS best_epoch,
  round(max(best_valid_f1), 6) AS best_valid_f1 FROM ran GROUP BY run""")
def q_early_stop(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    s = evaluate.run_summary(fx.epoch_log(ev))
    return s.select("run", F.col("epochs_run").cast("bigint"), "stop_epoch", "best_epoch",
                    F.round("best_valid_f1", 6).alias("best_valid_f1"))


# ---------------------------------------------------------- 2.5 example arrays

VOCAB_SQL = """vocab AS (
  SELECT ch, n, CAST(row_number() OVER (ORDER BY n DESC, ch) - 1 + 5 AS INTEGER) AS id
  FROM (SELECT ch, count(*) AS n FROM kept GROUP BY ch)
)"""
# The vocabulary of the train pages: characters that only other pages hold are unknown.
TRAIN_VOCAB_SQL = """vocab AS (
  SELECT ch, n, CAST(row_number() OVER (ORDER BY n DESC, ch) - 1 + 5 AS INTEGER) AS id
  FROM (SELECT k.ch, count(*) AS n FROM kept k JOIN documents d ON d.doc_id = k.page_id
        JOIN splits s ON s.page_id = d.doc_id AND s.category = d.source AND s.tvt = 'train' GROUP BY k.ch)
),
vocab_ids AS (
  SELECT k.page_id, k.block_id, count(*) + 2 AS n_ids, '2,' || string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ',' ORDER BY k.block_idx) || ',3' AS ids
  FROM kept k LEFT JOIN vocab v USING (ch) GROUP BY k.page_id, k.block_id
)"""


def _examples_codepoint(spark, d):
    c = _corpus(spark, d, P)
    return examples.encode_codepoint_blocks(examples.codepoint_blocks(c.lines, P))


@register("encode_codepoints", W(BASE) + """SELECT page_id, block_id,
  '57344,' || string_agg(CAST(unicode(ch) AS VARCHAR), ',' ORDER BY block_idx)
  || CASE WHEN count(*) <= 3 THEN ',0,0,0' ELSE '' END AS ids
  FROM kept GROUP BY page_id, block_id""")
def q_encode_codepoints(spark, d):
    e = _examples_codepoint(spark, d)
    return e.select("page_id", "block_id", F.array_join("input_ids", ",").alias("ids"))


@register("pad_short_blocks", W(BASE) + """SELECT page_id, block_id, CAST(count(*) AS INTEGER) AS n,
  count(*) <= 3 AS padded, CAST(count(*) + 1 + CASE WHEN count(*) <= 3 THEN 3 ELSE 0 END AS INTEGER) AS n_ids
  FROM kept GROUP BY page_id, block_id""")
def q_pad_short_blocks(spark, d):
    e = _examples_codepoint(spark, d)
    return e.select("page_id", "block_id", F.col("n").cast("int").alias("n"), (F.col("n") <= 3).alias("padded"),
                    F.size("input_ids").cast("int").alias("n_ids"))


@register("build_vocab", W(BASE, VOCAB_SQL) + "SELECT ch, CAST(n AS BIGINT) AS n, id FROM vocab")
def q_build_vocab(spark, d):
    return examples.build_vocab(_corpus(spark, d, P).chars)


def _train_vocab(spark, d, p):
    """The vocabulary of the train pages (bounded by Unicode), counted once."""
    train = _train_corpus(_pages(spark, d), _tagger_split(spark, d), p)
    return checkpointed(examples.build_vocab(train.chars))


def _examples_vocab(spark, d):
    c = _corpus(spark, d, P510)
    return examples.encode_vocab(examples.codepoint_blocks(c.lines, P510), _train_vocab(spark, d, P510))


@register("encode_vocab", W(O.base(P510), O.anno_cte(), O.splits_cte(), TRAIN_VOCAB_SQL) + "SELECT page_id, block_id, ids FROM vocab_ids")
def q_encode_vocab(spark, d):
    return _examples_vocab(spark, d).select("page_id", "block_id", F.array_join("input_ids", ",").alias("ids"))


@register("attention_mask", W(O.base(P), """cp AS (SELECT page_id, block_id, count(*) AS n FROM kept GROUP BY page_id, block_id),
vb AS (SELECT page_id, b AS block_id, least(510, t - 510 * b) AS n
       FROM (SELECT page_id, sum(n) AS t FROM cp GROUP BY page_id), LATERAL (SELECT unnest(range(CAST((t + 509) // 510 AS BIGINT))) AS b))""") + """SELECT 'codepoint' AS variant, page_id, block_id, repeat('0', CAST(n + 1 + CASE WHEN n <= 3 THEN 3 ELSE 0 END AS INTEGER)) AS mask FROM cp
UNION ALL
SELECT 'vocab', page_id, block_id, repeat('1', CAST(n + 2 AS INTEGER)) FROM vb""")
def q_attention_mask(spark, d):
    """Both masks as they are built, a digit per position."""
    written = lambda c: F.array_join(F.transform(c, lambda x: F.when(x, "1").otherwise("0")), "").alias("mask")
    cp = _examples_codepoint(spark, d).withColumn("m", examples.codepoint_mask())
    return cp.select(F.lit("codepoint").alias("variant"), "page_id", "block_id", written("m")).unionByName(
        _examples_vocab(spark, d).select(F.lit("vocab").alias("variant"), "page_id", "block_id", written("attention_mask")))


LABELS_SQL = """ai AS (SELECT category, attribute, CAST(row_number() OVER (PARTITION BY category ORDER BY attribute) - 1 AS INTEGER) AS attr_idx
  FROM (SELECT DISTINCT category, attribute FROM gold_anno)),
blabels AS (
  SELECT d.page_id, k.block_id, ai.attr_idx,
         '-1,' || string_agg(CASE d.bio WHEN 'B' THEN '0' WHEN 'I' THEN '1' ELSE '2' END, ','
                             ORDER BY k.block_idx) || ',-1' AS labels
  FROM dense d JOIN kept k ON k.page_id = d.page_id AND k.new_char_idx = d.new_char_idx
  JOIN documents c ON c.doc_id = d.page_id JOIN ai ON ai.category = c.source AND ai.attribute = d.attribute
  GROUP BY d.page_id, k.block_id, ai.attr_idx
)"""
LABELS_BASE = W(O.base(P510), O.anno_cte(), O.cells_ctes(), O.dense_spans_ctes(), LABELS_SQL)


def _label_blocks(spark, d, p):
    """Blocks of all pages with their code points and tag runs."""
    g = _gold(spark, d)
    return blocks.page_blocks(_corpus(spark, d, p).frame, p, g, annotate.attribute_index(g))


def _block_labels(spark, d, p):
    return examples.block_labels(_label_blocks(spark, d, p), p)


def _labelled_examples(spark, d):
    """Ids, mask and label arrays of every block, from one row per page."""
    rows = _label_blocks(spark, d, P510).select(*PAGE, "block_id", "n", F.col("chars").alias("cps"), "runs").where(F.size("runs") > 0)
    return examples.label_arrays(examples.encode_vocab(rows, _train_vocab(spark, d, P510)), P510).drop("runs")


@register("tag_strings", GOLD_SPANS + """SELECT page_id, attribute, new_char_idx,
  CASE WHEN bio = 'O' THEN 'O' ELSE bio || '-' || attribute END AS tag,
  split_part(CASE WHEN bio = 'O' THEN 'O' ELSE bio || '-' || attribute END, '-', 1) AS bio FROM dense""")
def q_tag_strings(spark, d):
    """Every kept character and attribute, O included, spelled out from the label arrays of the blocks."""
    bl = _block_labels(spark, d, P510)
    pos = bl.select("page_id", "attribute", "first_idx", F.posexplode_outer("labels").alias("pos", "label")).where(F.col("label") >= 0)
    t = annotate.tag_string(annotate.bio_from_index(F.col("label")), F.col("attribute"))
    return pos.select("page_id", "attribute", (F.col("first_idx") + F.col("pos") - 1).cast("bigint").alias("new_char_idx"),
                      t.alias("tag"), annotate.tag_prefix(t).alias("bio"))


@register("block_labels", LABELS_BASE + "SELECT page_id, block_id, attr_idx, labels FROM blabels")
def q_block_labels(spark, d):
    bl = _block_labels(spark, d, P510)
    return bl.select("page_id", "block_id", "attr_idx", F.array_join("labels", ",").alias("labels"))


EXAMPLES_SQL = W(O.base(P510), O.anno_cte(), O.splits_cte(), TRAIN_VOCAB_SQL, O.cells_ctes(), O.dense_spans_ctes(), LABELS_SQL) + """, bl2 AS (
  SELECT page_id, block_id, string_agg(labels, '|' ORDER BY attr_idx) AS labels FROM blabels GROUP BY page_id, block_id
),
ex AS (SELECT v.*, bl2.labels, d.source AS category FROM vocab_ids v JOIN bl2 USING (page_id, block_id) JOIN documents d ON d.doc_id = v.page_id)"""
PADDED_SQL = """ids || repeat(',0', CAST(len - n_ids AS INTEGER)) AS ids, CAST(n_ids AS INTEGER) AS n_attend,
  array_to_string(list_transform(string_split(labels, '|'), lambda x: x || repeat(',-1', CAST(len - n_ids AS INTEGER))), '|') AS labels"""


def _padded(df, *keys):
    """The arrays written out: ids and labels as digits, the mask as the number of true places."""
    rows = df.select(*keys, "input_ids", "attention_mask", "labels")
    schema = T.StructType([*rows.schema.fields[:len(keys)], T.StructField("ids", T.StringType()), T.StructField("n_attend", T.IntegerType()), T.StructField("labels", T.StringType())])

    def joined(column, by):
        at, values = list_parts(column)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype("int32")), values), by)

    def digits(column):
        at, values = list_parts(column)
        return joined(pa.ListArray.from_arrays(pa.array(at.astype("int32")), values.cast(pa.string())), ",")

    def run(batches):
        for batch in batches:
            ids, mask, labels = batch.columns[len(keys):]
            at, on = list_parts(mask)
            attend = np.append(0, np.cumsum(on.to_numpy(zero_copy_only=False)))[at]
            per, values = list_parts(labels)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], digits(ids), pa.array(np.diff(attend).astype("int32")),
                                              joined(pa.ListArray.from_arrays(pa.array(per.astype("int32")), digits(values)), "|")], names=schema.names)

    return rows.mapInArrow(run, schema)


@register("batch_pad", EXAMPLES_SQL + f""", bt AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY page_id ORDER BY block_id) - 1) // 8 AS BIGINT) AS batch_id FROM ex
),
bt2 AS (SELECT *, max(n_ids) OVER (PARTITION BY page_id, batch_id) AS len FROM bt)
SELECT page_id, batch_id, block_id, {PADDED_SQL} FROM bt2""")
def q_batch_pad(spark, d):
    return _padded(examples.batch_pad(_labelled_examples(spark, d), 8), "page_id", "batch_id", "block_id")


@register("training_batches", EXAMPLES_SQL + f""", tr AS (
  SELECT ex.*, row_number() OVER (ORDER BY md5('7:2:' || ex.category || ':' || CAST(ex.page_id AS VARCHAR) || ':' || CAST(block_id AS VARCHAR)), ex.page_id, block_id) - 1 AS r
  FROM ex JOIN splits s ON s.page_id = ex.page_id AND s.category = ex.category AND s.tvt = 'train'
),
tr2 AS (SELECT *, max(n_ids) OVER (PARTITION BY r // 8) AS len FROM tr)
SELECT CAST(r // 8 AS BIGINT) AS batch_id, CAST(r % 8 AS INTEGER) AS place, page_id, block_id, {PADDED_SQL} FROM tr2""")
def q_training_batches(spark, d):
    """The train blocks of all pages in one seeded permutation, in padded batches of eight."""
    train = bounded_broadcast(_tagger_split(spark, d).where(F.col("tvt") == "train").select(*PAGE))
    made = examples.training_batches(_labelled_examples(spark, d).join(train, PAGE, "left_semi"), 8, seed=7, epoch=2)
    return _padded(made, "batch_id", "place", "page_id", "block_id")


@register("reassemble_page", LABELS_BASE + """SELECT d.page_id, ai.attr_idx, d.new_char_idx,
  CAST((CASE d.bio WHEN 'B' THEN 0 WHEN 'I' THEN 1 ELSE 2 END
        + CASE WHEN (d.page_id + k.block_idx + ai.attr_idx) % 5 = 0 THEN 1 ELSE 0 END) % 3 AS INTEGER) AS pred
  FROM dense d JOIN kept k ON k.page_id = d.page_id AND k.new_char_idx = d.new_char_idx
  JOIN documents c ON c.doc_id = d.page_id JOIN ai ON ai.category = c.source AND ai.attribute = d.attribute""")
def q_reassemble_page(spark, d):
    """Block predictions that differ from the labels at every fifth position, put back onto the characters."""
    bl = _block_labels(spark, d, P510)
    pred = F.transform("labels", lambda x, i: F.pmod(x + F.when((F.col("page_id") + i - 1 + F.col("attr_idx")) % 5 == 0, 1).otherwise(0), F.lit(3)))
    r = spans.reassemble_page(bl.withColumn("pred", pred))
    return r.select("page_id", "attr_idx", "new_char_idx", F.col("pred").cast("int").alias("pred"))


# ------------------------------------------------------------------ 2.7 scoring

HEAD_SQL = """ex AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings
),
hid AS (
  SELECT ex.vec_id, a.a, o.o,
         greatest(0.0, sum(ex.x * ((((a.a * 31 + o.o * 17 + ex.i * 7) % 13) - 6) / 10.0))
                  + ((((a.a * 31 + o.o * 17 + 64 * 7) % 13) - 6) / 10.0)) AS h
  FROM ex, range(3) a(a), range(64) o(o) GROUP BY ex.vec_id, a.a, o.o
),
logit AS (
  SELECT hid.vec_id, hid.a AS attr_idx, t.t AS tag_idx,
         sum(hid.h * ((((hid.a * 31 + t.t * 17 + hid.o * 7) % 13) - 6) / 10.0))
         + ((((hid.a * 31 + t.t * 17 + 64 * 7) % 13) - 6) / 10.0) AS logit
  FROM hid, range(3) t(t) GROUP BY hid.vec_id, hid.a, t.t
),
mx AS (SELECT *, max(logit) OVER (PARTITION BY vec_id, attr_idx) AS m FROM logit),
prob AS (
  SELECT vec_id, attr_idx, tag_idx, logit,
         exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY vec_id, attr_idx) AS p
  FROM mx
)"""


def _heads(spark, d):
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    w1, w2 = scoring.head_weights(fx.HEAD_ATTRS, 64, fx.head_weight)
    return scoring.linear_heads(emb, "embedding", ["vec_id"], w1, w2)


def _explode_tags(df, col, name):
    return df.select("vec_id", "attr_idx", F.posexplode(col).alias("tag_idx", name)) \
        .select("vec_id", F.col("attr_idx").cast("int"), F.col("tag_idx").cast("int"), F.round(name, 6).alias(name))


@register("linear_heads", W(HEAD_SQL) +
          "SELECT vec_id, CAST(attr_idx AS INTEGER) AS attr_idx, CAST(tag_idx AS INTEGER) AS tag_idx, "
          "round(logit, 6) AS logit FROM logit")
def q_linear_heads(spark, d):
    return _explode_tags(_heads(spark, d), "logits", "logit")


@register("softmax_scores", W(HEAD_SQL) +
          "SELECT vec_id, CAST(attr_idx AS INTEGER) AS attr_idx, CAST(tag_idx AS INTEGER) AS tag_idx, "
          "round(p, 6) AS prob FROM prob")
def q_softmax_scores(spark, d):
    return _explode_tags(scoring.softmax_scores(_heads(spark, d)), "probs", "prob")


@register("argmax_tag", W(HEAD_SQL) +
          "SELECT vec_id, CAST(attr_idx AS INTEGER) AS attr_idx, CAST(arg_min(tag_idx, -p + tag_idx * 1e-12) "
          "AS INTEGER) AS pred FROM prob GROUP BY vec_id, attr_idx")
def q_argmax_tag(spark, d):
    a = scoring.argmax_tag(scoring.softmax_scores(_heads(spark, d)))
    return a.select("vec_id", F.col("attr_idx").cast("int"), "pred")


@register("masked_nll", W(HEAD_SQL, """sc AS (
  SELECT l.vec_id, l.vec_id // 8 AS batch_id, l.attr_idx, l.tag_idx, l.logit * CASE WHEN l.vec_id % 5 = 0 THEN 100.0 ELSE 1.0 END AS x,
         CASE WHEN (l.vec_id + l.attr_idx) % 4 = 0 OR ((l.vec_id // 8) % 7 = 0 AND l.attr_idx = 2) THEN -1
              ELSE (e.label + l.attr_idx) % 3 END AS label
  FROM logit l JOIN embeddings e USING (vec_id)
),
lse AS (SELECT *, max(x) OVER w AS m FROM sc WINDOW w AS (PARTITION BY vec_id, attr_idx)),
pos AS (
  SELECT vec_id, batch_id, attr_idx, any_value(label) AS label,
         max(m) + ln(sum(exp(x - m))) - max(CASE WHEN tag_idx = label THEN x END) AS nll
  FROM lse GROUP BY vec_id, batch_id, attr_idx
),
per AS (SELECT batch_id, attr_idx, avg(CASE WHEN label <> -1 THEN nll END) AS m, count(*) AS n FROM pos GROUP BY batch_id, attr_idx)""") +
          "SELECT CAST(batch_id AS BIGINT) AS batch_id, CASE WHEN bool_or(m IS NULL) THEN NULL ELSE round(sum(m) / max(n), 6) END AS loss "
          "FROM per GROUP BY batch_id")
def q_masked_nll(spark, d):
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    w1, w2 = scoring.head_weights(fx.HEAD_ATTRS, 64, fx.head_weight)
    scored = scoring.linear_heads(emb, "embedding", ["vec_id", "label"], w1, w2)
    scored = scored.select(
        fx.embedding_batch().alias("batch_id"), "attr_idx", F.transform("logits", lambda x: x * fx.logit_scale()).alias("logits"),
        fx.embedding_label(F.col("attr_idx")).alias("label"))
    return scoring.masked_nll(scored).select("batch_id", F.round("loss", 6).alias("loss"))


TAGGER_SQL = """kept_ctx AS (
  SELECT k.*, d.source AS category, coalesce(r.ch, '') AS prev_ch FROM kept k JOIN documents d ON d.doc_id = k.page_id
  LEFT JOIN rawchars r ON r.page_id = k.page_id AND r.line_id = k.line_id AND r."offset" = k."offset" - 1
),
tr_chars AS (SELECT k.* FROM kept_ctx k JOIN splits s ON s.page_id = k.page_id AND s.tvt = 'train'),
tr_lab AS (SELECT l.*, s.category FROM labels l JOIN splits s ON s.page_id = l.page_id AND s.tvt = 'train'),
freq AS (SELECT category, prev_ch, ch, count(*) AS n FROM tr_chars GROUP BY category, prev_ch, ch),
lc AS (SELECT category, attribute, prev_ch, ch, CAST(sum(CASE WHEN bio = 'B' THEN 1 ELSE 0 END) AS BIGINT) AS n_b,
              CAST(sum(CASE WHEN bio = 'I' THEN 1 ELSE 0 END) AS BIGINT) AS n_i
       FROM tr_lab GROUP BY category, attribute, prev_ch, ch),
model AS (
  SELECT lc.category, lc.attribute, lc.prev_ch, lc.ch, lc.n_b, lc.n_i, CAST(f.n - lc.n_b - lc.n_i AS BIGINT) AS n_o,
         CASE WHEN f.n - lc.n_b - lc.n_i >= lc.n_i AND f.n - lc.n_b - lc.n_i >= lc.n_b THEN 'O'
              WHEN lc.n_i >= lc.n_b THEN 'I' ELSE 'B' END AS bio
  FROM lc JOIN freq f USING (category, prev_ch, ch)
),
p_labels AS (
  SELECT k.page_id, m.attribute, k.new_char_idx, m.bio, k.line_id, k."offset", k.ch
  FROM kept_ctx k JOIN model m ON m.category = k.category AND m.ch = k.ch AND m.prev_ch = k.prev_ch AND m.bio <> 'O'
)"""
TAGGER = W(BASE, O.anno_cte(), O.cells_ctes(), O.splits_cte(), TAGGER_SQL)


def _tagger_split(spark, d):
    """The split (one small row per annotated page), derived once and kept in the shared folder."""
    return checkpointed(_split(_gold(spark, d)))


def _train_corpus(pages, sp, p=P):
    """The train pages: n_train ids per category, counted before they are broadcast; the text is filtered, not shuffled."""
    return Corpus(pages.join(bounded_broadcast(sp.where(F.col("tvt") == "train").select(*PAGE)), PAGE, "left_semi"), p)


def _train_side(pages, sp, context):
    """Kept characters with context and labels of the train pages.  The fixture
    rule is per page, so their annotations come from those pages alone."""
    train = _train_corpus(pages, sp)
    ctx = chars.kept_chars(train.lines, P, context=context)
    return ctx, train.labels(fx.fixture_annotations(train.pages))


def _count_model(pages, sp):
    return scoring.train_tagger_counts(*_train_side(pages, sp, 1))


@register("train_tagger_counts", TAGGER + "SELECT category, attribute, prev_ch, ch, n_b, n_i, n_o, bio FROM model")
def q_train_tagger_counts(spark, d):
    return _count_model(_pages(spark, d), _tagger_split(spark, d))


def _scored(pages, sp):
    """Predicted spans of the count tagger on the given pages, annotated or not."""
    ctx = chars.kept_chars(chars.clean_lines(pages, P), P, context=1)
    return spans.decode_spans(scoring.score_with_counts(ctx, _count_model(pages, sp)))


PRED_DENSE = O.dense_spans_ctes("p_")


@register("score_pages", TAGGER.rstrip() + ",\n" + PRED_DENSE +
          "\nSELECT page_id, attribute, start_idx, end_idx, start_line, start_offset, end_line, end_offset, text "
          "FROM p_spans")
def q_score_pages(spark, d):
    return _scored(_pages(spark, d), _tagger_split(spark, d)).select(
        "page_id", "attribute", "start_idx", "end_idx", "start_line", "start_offset", "end_line", "end_offset", "text")


MODEL_SQL = """kept_ctx AS (
  SELECT k.*, coalesce(r.ch, '') AS prev_ch FROM kept k
  LEFT JOIN rawchars r ON r.page_id = k.page_id AND r.line_id = k.line_id AND r."offset" = k."offset" - 1
),
pairs AS (SELECT DISTINCT ch, prev_ch, unicode(ch) AS cp, CASE WHEN prev_ch = '' THEN 0 ELSE unicode(prev_ch) END AS bf FROM kept_ctx),
hidden AS (SELECT ch, prev_ch, j, (cp * (2 * j + 3) + bf * (j + 1) + 5 * j) % 11 - 5 AS h FROM pairs, range({n}) t(j)),
inner_layer AS (SELECT ch, prev_ch, a, o, greatest(0, sum(h * ((a * 31 + o * 17 + j * 7) % 13 - 6)) + ((a * 31 + o * 17 + {n} * 7) % 13 - 6)) AS h
  FROM hidden, range(2) x(a), range({n}) y(o) GROUP BY ch, prev_ch, a, o),
logits AS (SELECT ch, prev_ch, a, t, sum(h * ((a * 31 + t * 17 + o * 7) % 13 - 6)) + ((a * 31 + t * 17 + {n} * 7) % 13 - 6) + CASE WHEN t = 2 THEN {bias} ELSE 0 END AS x
  FROM inner_layer, range(3) z(t) GROUP BY ch, prev_ch, a, t),
best AS (SELECT ch, prev_ch, a, arg_max(t, x * 4 - t) AS tag FROM logits GROUP BY ch, prev_ch, a),
tagged AS (
  SELECT k.page_id, CASE WHEN a = 0 THEN '{first}' ELSE '{second}' END AS attribute, k.new_char_idx, tag, k.line_id, k."offset", k.ch
  FROM kept_ctx k JOIN best b ON b.ch = k.ch AND b.prev_ch = k.prev_ch WHERE tag < 2
),
numbered AS (
  SELECT *, sum(st) OVER (PARTITION BY page_id, attribute ORDER BY new_char_idx ROWS UNBOUNDED PRECEDING) AS span_no
  FROM (SELECT *, CASE WHEN tag = 0 OR lag(new_char_idx) OVER w IS DISTINCT FROM new_char_idx - 1 THEN 1 ELSE 0 END AS st
        FROM tagged WINDOW w AS (PARTITION BY page_id, attribute ORDER BY new_char_idx))
)""".format(n=fx.BLOCK_HIDDEN, bias=fx.BLOCK_O_BIAS, first=fx.BLOCK_ATTRS[0], second=fx.BLOCK_ATTRS[1])


@register("score_pages_model", W(BASE, MODEL_SQL) + """SELECT page_id, attribute, min(new_char_idx) AS start_idx, max(new_char_idx) AS end_idx,
  arg_min(line_id, new_char_idx) AS start_line, arg_min("offset", new_char_idx) AS start_offset,
  arg_max(line_id, new_char_idx) AS end_line, arg_max("offset", new_char_idx) + 1 AS end_offset, string_agg(ch, '' ORDER BY new_char_idx) AS text
  FROM numbered GROUP BY page_id, attribute, span_no""")
def q_score_pages_model(spark, d):
    """Spans of a model over padded block batches: hidden vectors by formula, two-layer heads, argmax, reassembly, decode."""
    return block_model.predict_spans(_pages(spark, d), P, fx.block_scorer()).select(
        "page_id", "attribute", "start_idx", "end_idx", "start_line", "start_offset", "end_line", "end_offset", "text")


@register("macro_page_f1", W(BASE, O.anno_cte(), O.cells_ctes(), O.splits_cte(), TAGGER_SQL, O.dense_spans_ctes(),
                             PRED_DENSE.replace(O.ATTRS, ""), MATCH_SQL) +
          "SELECT CAST(count(*) AS BIGINT) AS n_pages, round(coalesce(avg(f1), 0.0), 6) AS macro_f1 FROM prf2")
def q_macro_page_f1(spark, d):
    """The closed loop: train the count tagger, score the pages, decode, and compare with gold on the hold-out pages."""
    pages, sp = _pages(spark, d), _tagger_split(spark, d)
    held = checkpointed(pages.select(*PAGE).join(splits.holdout_merge(sp), PAGE, "left_semi"))
    gold = Corpus(pages, P).spans_of(fx.fixture_annotations(pages))
    cols = [*evaluate.SPAN_KEY]
    both = gold.select(*cols, F.lit("gold").alias("set")).unionByName(_scored(pages, sp).select(*cols, F.lit("pred").alias("set")))
    m = evaluate.macro_page_f1(evaluate.page_prf(evaluate.match_sets(both.join(held, PAGE, "left_semi")), held))
    return m.select(F.col("n_pages").cast("bigint"), F.round("macro_f1", 6).alias("macro_f1"))


def _tagger_schema(spark, d):
    """The split and the attribute names of the annotation schema (the same few as in the files), from one pass over the gold spans."""
    named = checkpointed(_gold(spark, d).select(*PAGE, "attribute").distinct())
    names = named.select("attribute").dropna().distinct().orderBy("attribute")
    return checkpointed(_split(named)), [r.attribute for r in names.collect()]


def _lr_model(spark, d):
    sp, names = _tagger_schema(spark, d)
    return sp, scoring.train_tagger_lr(*_train_side(_pages(spark, d), sp, 2), names, k=2)


def lr_spans(spark, d):
    """Predicted spans of the logistic-regression tagger on all pages."""
    kept = chars.kept_chars(chars.clean_lines(_pages(spark, d), P), P, context=2)
    return spans.decode_spans(scoring.score_with_lr(kept, _lr_model(spark, d)[1]))


@register("train_tagger_lr", W(BASE, O.anno_cte(), O.splits_cte()) + """SELECT s.page_id, CAST(count(k.ch) AS BIGINT) AS n_scored,
  true AS spans_hold, true AS fit_holds FROM splits s JOIN documents d ON d.doc_id = s.page_id AND d.source = s.category
  LEFT JOIN kept k ON k.page_id = s.page_id WHERE s.tvt IN ('valid', 'test') GROUP BY s.page_id""")
def q_train_tagger_lr(spark, d):
    """Per hold-out page: characters that the model scored; whether every predicted span's text is the kept
    characters of its range; whether the fit's loss fell at every step, to less than a tenth of that of even odds.

    The fit is iterative and has no SQL form; tests check its gradient and its hold-out F1.
    """
    sp, model = _lr_model(spark, d)
    held = bounded_broadcast(_holdout_pages(spark, d, sp))
    fell = all(b <= a for a, b in zip(model.losses, model.losses[1:])) and (not model.losses or model.losses[-1] < model.losses[0] / 10)
    own = Corpus(_pages(spark, d).join(held, PAGE, "left_semi"), P)
    scored = checkpointed(scoring.lr_line_cells(chars.kept_lines(own.lines), P, model))
    n = scored.groupBy(*PAGE).agg(F.sum("n_scored").alias("n"))
    body = F.filter("lines", lambda x: x["in_body"])
    text = own.frame.select(*PAGE, F.array_join(F.transform(
        body, lambda x: F.regexp_replace(x["line"], F.lit(tx.WS_CLASS), F.lit(""))), "").alias("kept"))
    found = spans.decode_spans(scoring.spread_tags(scored.where(F.col("tags").isNotNull()), model.attributes)).groupBy(*PAGE).agg(
        F.collect_list(F.struct("start_idx", "end_idx", "text")).alias("spans"))
    j = held.join(n, PAGE, "left").join(text, PAGE, "left").join(found, PAGE, "left")
    right = F.forall(F.coalesce("spans", F.array().cast("array<struct<start_idx:bigint,end_idx:bigint,text:string>>")),
                     lambda s: F.substring(F.col("kept"), (s["start_idx"] + 1).cast("int"), (s["end_idx"] - s["start_idx"] + 1).cast("int")) == s["text"])
    return j.select("page_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_scored"), right.alias("spans_hold"), F.lit(fell).alias("fit_holds"))


def queries() -> dict:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
