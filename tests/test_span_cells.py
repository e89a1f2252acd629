"""Span expansion on long lines: ranks across chunks, and rows that stay narrow."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanweave.config import TextParams
from spanweave.functions import text
from spanweave.operators import annotate, blocks, chars
from tests.test_pipeline import _anno_df, all_pages, pages_df

PLAIN = TextParams(header_last=-1, max_length=100, blank_patterns=False)
WS = re.compile(r"\s")


@pytest.mark.parametrize("mode", ["char", "line"])
def test_ranks_on_long_lines(spark, mode):
    rng = random.Random(11)
    lines = ["".join(rng.choice("ab字𠮷 \t　 ") for _ in range(n)) + "\n" for n in (1, 62, 63, 64, 65, 127, 128, 300)]
    p = TextParams(header_last=-1, mode=mode, max_length=100, blank_patterns=False)
    anns = []
    for _ in range(120):
        sl = rng.randrange(len(lines))
        el = min(len(lines), sl + rng.choice((0, 0, 1, 9)))
        so = rng.randrange(-2, 130)
        anns.append({"page_id": 1, "attribute": rng.choice("xy"), "sl": sl, "so": so, "el": el, "eo": so + rng.choice((0, 1, 3, 70, 400))})
    pages = pages_df(spark, {1: "".join(lines)})
    anno = spark.createDataFrame([("C", 1, a["attribute"], i, ((a["sl"], a["so"]), None, (a["el"], a["eo"]))) for i, a in enumerate(anns)],
                                 "category string, page_id bigint, attribute string, anno_seq bigint, text_offset struct<start:struct<line_id:int,offset:int>,text:string,end:struct<line_id:int,offset:int>>")
    want, base = set(), []
    for line in lines:
        n = len(WS.sub("", line))
        base.append((base[-1][0] + base[-1][1] if base else 0, min(n, p.capacity) if mode == "line" else n))
    for seq, a in enumerate(anns):
        for i in range(max(a["sl"], 0), min(a["el"], len(lines) - 1) + 1):
            for o in range(max(a["so"], 0), min(a["eo"], len(lines[i]))):
                ch, rank = lines[i][o], len(WS.sub("", lines[i][:o]))
                kept = not WS.match(ch) and (mode == "char" or rank < p.capacity)
                want.add((i, o, a["attribute"], seq, "B" if (i, o) == (a["sl"], a["so"]) else "I", ch, lines[i][o - 1] if o else "",
                          base[i][0] + rank if kept else None, rank if kept else None))
    got = annotate.expand_spans(anno, chars.page_frame(pages, p), p).select("line_id", "offset", "attribute", "anno_seq", "bio", "ch", "prev_ch", "new_char_idx", "line_rank")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_generated_rows_carry_no_page_and_no_line(spark):
    texts = all_pages()
    cells = annotate.expand_spans(_anno_df(spark, [{"page_id": 1, "attribute": "a", "sl": 0, "so": 0, "el": 1, "eo": 3}]), chars.page_frame(pages_df(spark, texts), PLAIN), PLAIN)
    outputs = [[a.split("#")[0] for a in g] for g in _generates(cells)]
    assert len(outputs) == 2 and not any(set(o) & {"lines", "spans", "_l", "_s"} for o in outputs), outputs


def _generates(df):
    """The output columns of the plan's generators."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Generate":
            found.append([str(node.output().apply(i)) for i in range(node.output().size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def _nodes(df, name):
    todo, found = [df._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        found += node.nodeName() == name
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("mode", ["char", "line"])
def test_overlaps_are_resolved_in_the_row_of_the_line(spark, mode):
    rng = random.Random(12)
    p = TextParams(header_last=0, mode=mode, max_length=20, blank_patterns=False)
    texts = {i: "".join("".join(rng.choice("ab字 \t") for _ in range(rng.randint(0, 30))) + "\n" for _ in range(4)) for i in range(8)}
    anno = _anno_df(spark, [{"page_id": rng.randrange(9), "attribute": rng.choice("xy"), "sl": rng.randrange(4), "so": (so := rng.randrange(12)),
                             "el": rng.randrange(5), "eo": so + rng.randrange(9), "anno_seq": i} for i in range(150)]).withColumn("set", F.when(F.col("anno_seq") % 2 == 0, "gold"))
    frame = chars.page_frame(pages_df(spark, texts), p)

    def rows(df):
        return sorted(map(str, df.collect()))

    def grouped(frame):
        cells = annotate.expand_spans(anno, frame, p, ("set",), ("n_kept",)).where("new_char_idx IS NOT NULL")
        return annotate.resolve_overlaps(cells, ("set", "n_kept"))

    labels = annotate.label_chars(anno, frame, p, ("set",), ("n_kept",))
    assert rows(labels) == rows(grouped(frame)) != []
    # The spans are gathered by page; the cells are neither moved nor aggregated.
    assert _nodes(labels, "Aggregate") == 1 and _nodes(labels, "RepartitionByExpression") == 0
    twice = frame.unionByName(frame.where("page_id < 3"))
    assert rows(annotate.label_chars(anno, twice, p, ("set",), ("n_kept",))) == rows(grouped(twice)) == rows(labels)


@pytest.mark.parametrize("mode", ["char", "line"])
def test_kept_characters_are_spelled_out_of_words(spark, mode):
    p = TextParams(header_last=-1, mode=mode, max_length=9, blank_patterns=False)
    lines = chars.clean_lines(pages_df(spark, {1: "  a　　b字 𠮷\t\n\n \t \nabcdefghijklm n\n", 2: "", 3: " \n", 4: "x"}), p)
    got = chars.kept_chars(lines, p)
    want = chars.kept_chars(lines, p, context=1).select(got.columns)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    assert [[c.split("#")[0] for c in g][-1] for g in _generates(got)] == ["ch", "_w", "in_body"]


def test_full_stops_of_prose_are_no_hosts(spark):
    lines = ["It ends. Here a.b too...", "a.jp x", "see www.x.org/p.", "10.0.0.1:80 and 1.2", "x.1", "no dot", "http://h.co", ".ab", "a.b1", "-.cd", ". a", "é.fr"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    plain = F.regexp_replace("line", F.lit(text.JAVA_DOT + text.HOST_PATTERN), F.repeat(F.lit(" "), F.length(F.regexp_extract("line", text.JAVA_DOT + text.HOST_PATTERN, 0))))
    out = df.select(text.blank_regex(F.col("line"), text.HOST_PATTERN).alias("got"), plain.alias("want"))
    assert all(r.got == r.want for r in out.collect())
    assert "RLIKE" in out._jdf.queryExecution().optimizedPlan().toString().upper()


def test_blocks_count_a_span_by_chunks(spark):
    p = TextParams(header_last=-1, max_length=100, blank_patterns=False)
    rng = random.Random(13)
    line = "".join(rng.choice("ab字 \t") for _ in range(2000)) + "\n"
    rows = [{"page_id": 1, "attribute": rng.choice("xy"), "sl": 0, "so": (so := rng.randrange(2100)), "el": rng.randrange(3), "eo": so + rng.randrange(90), "anno_seq": i} for i in range(60)]
    anno, frame = _anno_df(spark, rows), chars.page_frame(pages_df(spark, {1: line * 2}), p)
    made = blocks.page_blocks(frame, p, anno, annotate.attribute_index(anno))
    got = {(r.first_idx + x.start + i, r.attributes[a], "BI"[x.tag]) for r in made.collect() for a, runs in enumerate(r.runs) for x in runs for i in range(x.len)}
    assert got == {(r.new_char_idx, r.attribute, r.bio) for r in annotate.label_chars(anno, frame, p).collect()} != set()
    # No span reads the line from its start, no character is filtered one by one.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(flatten" not in plan and "array_sort(concat" not in plan
    assert not re.search(r"substring\(lambda", plan)
