"""Pages as arrays of code points: gold spans, labels and the decode against plain models."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanweave.config import TextParams
from spanweave.operators import annotate, block_model, blocks, cells, chars, examples, spans
from spanweave.plans import catalog
from spanweave.sources import fixtures
from tests.test_pipeline import all_pages, pages_df
from tests.test_store import exchanges

TAGGED = "category string, page_id bigint, attribute string, new_char_idx bigint, bio string, line_id int, offset int, ch string"


def test_gold_spans_are_the_matches_of_their_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["A", "B", "b", "c", "dd", "é", "ê", "7", "1", " ", "\n", "\r\n", "\r", "字", "𠮷", "É"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    rows = [("C" if i % 5 else None, i, t) for i, t in enumerate([None, "", "\n", "Abcd", *texts])] + [("C", None, "Abcd éa"), ("C", 7, "é\n12")]
    want = []
    for category, pid, text in rows:
        lines = re.findall(r"[^\n]*\n|[^\n]+", re.sub("\r\n?", "\n", text or ""))
        want += [(category, pid, name, i, m.start(), i, m.end(), m[0], (i * 4 + k) * fixtures.MATCH_STEP + n)
                 for i, line in enumerate(lines) for k, (name, pattern) in enumerate(fixtures.ATTRIBUTE_PATTERNS) for n, m in enumerate(re.finditer(pattern, line))]
        for mod, shift, name, sl, so, el, eo, seq in ((7, 0, "cap", 1, 2, 2, 6, 0), (11, 0, "accent-word", 1, 0, 1, 8, 1), (13, 0, "number", 1, 5, 1, 5, 2),
                                                      (13, 0, "number", 1, 8, 2, 3, 3), (97, 10_000_000, "cap", 0, 0, 0, 3, -(1 << 50))):
            want += [(category, pid + shift, name, sl, so, el, eo, None, (1 << 50) + seq)] if pid is not None and pid % mod == 0 else []
    gold = fixtures.fixture_annotations(spark.createDataFrame(rows, "category string, page_id bigint, text string"))
    assert sorted(map(str, map(tuple, annotate.span_bounds(gold).select("category", "page_id", "attribute", "sl", "so", "el", "eo", "text", "anno_seq").collect()))) == sorted(map(str, want))
    assert str(gold.select("text_offset").schema["text_offset"].dataType) == str(fixtures.TEXT_OFFSET)


def decoded(rows):
    """The decode character by character."""
    out = []
    for key in {r[:3] for r in rows}:
        own, found = sorted((r for r in rows if r[:3] == key), key=lambda r: r[3]), []
        for i, r in enumerate(own):
            if r[4] == "B" or not i or own[i - 1][3] != r[3] - 1:
                found.append([])
            found[-1].append(r)
        out += [(*key, s[0][3], s[-1][3], *s[0][5:7], s[-1][5], s[-1][6] + 1, "".join(r[7] or "" for r in s)) for s in found]
    return sorted(map(str, out))


def test_fragments_decode_as_characters_in_any_order(spark):
    rng = random.Random(4)
    rows = []
    for page in (1, 2, None):
        for a in ("x", "y-z"):
            rows += [("C", page, a, i, rng.choice("BIII"), i // 9, i % 9 + i % 9 // 4, rng.choice("ab字𠮷")) for i in range(200) if rng.random() < 0.8]
    rows += [("C", 3, "x", i, "I", 0, i, None if i == 2 else "ab") for i in range(4)]
    twice = [("C", 5, "x", i, "BII"[i % 3], 0, i, "abc"[i % 3]) for i in range(9)] * 2
    for given in (rows, rows + twice):
        rng.shuffle(given)
        made = spans.decode_spans(spark.createDataFrame(given, TAGGED).repartition(3))
        assert sorted(map(str, map(tuple, made.collect()))) == decoded(given)


def test_only_fragments_are_exchanged(spark):
    rows = [("C", 1, "x", i, "B" if i == 0 else "I", 0, i, "a") for i in range(50)]
    made = spans.decode_spans(spark.createDataFrame(rows, TAGGED).coalesce(1))
    found, plan = exchanges(made)
    assert len(found) == 1 and "start_idx" in found[0] and "ch#" not in found[0]
    assert "Window" not in plan and "Aggregate" not in plan
    batch = pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in TAGGED.split(", ")], r)) for r in rows])
    assert spans.fragments(batch, 3).to_pylist() == [{"category": "C", "page_id": 1, "attribute": "x", "start_idx": 0, "n": 50, "begins": True, "line_id": 0, "offset": 0, "text": "a" * 50}]


def test_a_group_of_fragments_goes_on_over_batches():
    names = ["category", "page_id", "attribute", *spans.FRAGMENT]
    rows = [("C", p, "x", i * 2, 2, i % 3 == 0, 0, i * 2, "ab") for p in (1, 2) for i in range(10)] + [("C", 3, "x", 5, 1, False, 0, 5, "z")]
    rows = [dict(zip(names, r)) for r in rows]
    whole = [r for b in spans.joined_spans(iter([pa.RecordBatch.from_pylist(rows)]), 3) for r in b.to_pylist()]
    for size in (1, 3, 10, 20):
        cut = [pa.RecordBatch.from_pylist(rows[i:i + size]) for i in range(0, len(rows), size)]
        assert [r for b in spans.joined_spans(iter(cut), 3) for r in b.to_pylist()] == whole
    assert len(whole) == 9


def test_labels_of_odd_spans_and_small_pieces(spark, monkeypatch):
    p = TextParams(header_last=-1, blank_patterns=False)
    texts = {1: "ab 字𠮷\ncd é\n", 2: "", 3: "x\ty\nz"}
    spans_of = "category string, page_id bigint, attribute string, anno_seq bigint, text_offset struct<start:struct<line_id:int,offset:int>,text:string,end:struct<line_id:int,offset:int>>"
    given = [("C", 1, "a", 1, ((0, 0), None, (5, 4))), ("C", 1, "a", 2, ((0, 1), None, (0, 3))), ("C", 1, None, 3, ((1, -2), None, (1, 9))), ("C", 1, "a", None, ((0, 3), None, (0, 5))),
             ("C", 1, "b", 4, ((None, 0), None, (1, 2))), ("C", 1, "b", 5, ((0, None), None, (1, 2))), ("C", 2, "a", 6, ((0, 0), None, (0, 1))), ("C", 3, "a", 7, ((1, 0), None, (None, 2)))]
    anno, frame = spark.createDataFrame(given, spans_of), chars.page_frame(pages_df(spark, texts), p)
    made = annotate.label_chars(anno, frame, p, carry=("title",))
    cells_ = annotate.expand_spans(anno, frame, p, carry=("title",)).where(F.col("new_char_idx").isNotNull())
    grouped = annotate.resolve_overlaps(cells_, ("title",))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(made) == rows(grouped.select(made.columns)) != []
    piece = frame.select("category", "page_id", *cells.line_columns()).join(annotate.page_spans(anno), ["category", "page_id"]).toArrow().combine_chunks().to_batches()[0]
    whole = [r for x in annotate._labels(piece, p, (), ()) for r in pa.RecordBatch.from_pydict(x).to_pylist()]
    monkeypatch.setattr(cells, "PIECE_CELLS", 1)
    cut = [r for x in annotate._labels(piece, p, (), ()) for r in pa.RecordBatch.from_pydict(x).to_pylist()]
    assert sorted(map(str, cut)) == sorted(map(str, whole)) != []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class Mixed:
    """Tags by a character and the one before."""

    attributes = ("a", "b")

    def __call__(self, batch):
        out = np.zeros((*batch.ids.shape, 2, 3))
        for a in range(2):
            np.put_along_axis(out[:, :, a], ((batch.ids * (a + 1) + batch.before) % 3)[..., None], 1.0, axis=2)
        return out


def test_spans_are_predicted_without_rows_of_places(spark):
    for p in (TextParams(header_last=-1, max_length=8), TextParams(mode="line", variant="vocab", max_length=12)):
        pages = pages_df(spark, all_pages())
        made = block_model.predict_spans(pages, p, Mixed(), 3)
        scored = block_model.score_blocks(blocks.page_blocks(chars.page_frame(pages, p), p, places=True), Mixed(), 3)
        want = spans.decode_spans(block_model.predicted_tags(scored, Mixed.attributes))
        assert sorted(map(str, made.collect())) == sorted(map(str, want.collect())) != []
        assert "pred#" not in plan_of(made) and "_before#" not in plan_of(made) and "chars#" not in plan_of(made)


def test_tags_and_positions_without_splitting_and_zipping(spark):
    df = spark.createDataFrame([("B-a-b",), ("O",), ("",), (None,), ("-x",)], "tag string").select("tag", annotate.tag_prefix(F.col("tag")).alias("p"))
    assert [(r.tag, r.p) for r in df.collect()] == [("B-a-b", "B"), ("O", "O"), ("", ""), (None, None), ("-x", "")]
    assert "split_part" not in plan_of(df)
    rows = [("C", 1, 0, 0, 10, [-1, 2, 0, -1, -1], [7, 1, 0, 7]), ("C", 1, 1, 0, 20, [], []), ("C", 2, 0, 1, 0, None, [1]), ("C", 2, 1, 1, 30, [-1, 1], [0, 1, 2])]
    made = spans.reassemble_page(spark.createDataFrame(rows, "category string, page_id bigint, block_id bigint, attr_idx int, first_idx bigint, labels array<int>, pred array<int>"))
    assert [tuple(r) for r in made.collect()] == [("C", 1, 0, 0, 0, 10, 1), ("C", 1, 0, 0, 1, 11, 0), ("C", 2, 1, 1, 0, 30, 1)]
    assert "arrays_zip" not in plan_of(made)


def test_ids_and_written_batches_are_made_by_arrays(spark):
    vocab = spark.createDataFrame([("a", 3, 5), ("字", 2, 6), ("𠮷", 1, 7)], "ch string, n bigint, id int")
    rows = [("C", 1, 0, 3, [97, 0x5B57, 98], [[2, 0, 1], [2, 2, 2]]), ("C", 1, 1, 1, [0x20BB7], [[0], [2]]), ("C", 2, 0, 0, [], [[], []])]
    given = spark.createDataFrame(rows, "category string, page_id bigint, block_id bigint, n int, cps array<int>, tags array<array<int>>")
    made = examples.encode_vocab(given, vocab)
    assert [(r.page_id, r.block_id, r.input_ids, r.attention_mask) for r in made.collect()] == [
        (1, 0, [2, 5, 6, 1, 3], [True] * 5), (1, 1, [2, 7, 3], [True] * 3), (2, 0, [2, 3], [True] * 2)]
    assert "lambdafunction" not in plan_of(made)
    labelled = made.withColumn("labels", F.transform("tags", lambda r: F.concat(F.array(F.lit(-1)), r, F.array(F.lit(-1)))))
    written = catalog._padded(examples.batch_pad(labelled, 2), "page_id", "block_id")
    assert sorted(map(tuple, written.collect())) == [
        (1, 0, "2,5,6,1,3", 5, "-1,2,0,1,-1|-1,2,2,2,-1"), (1, 1, "2,7,3,0,0", 3, "-1,0,-1,-1,-1|-1,2,-1,-1,-1"), (2, 0, "2,3", 2, "-1,-1|-1,-1")]
    assert spark.createDataFrame(rows, given.schema).where("false").count() == 0 and examples.encode_vocab(given, vocab.where("false")).first().input_ids == [2, 1, 1, 1, 3]
