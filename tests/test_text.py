"""Line split, blanking patterns, whitespace class: Spark vs the Python model."""

import random

from pyspark.sql import functions as F

from spanweave.functions.text import WS_CLASS, clean_line, is_whitespace_cp, split_lines_expr
from spanweave.functions.arrays import prefix_sum
from tests import model

FRAGMENTS = [
    "東京都は日本の首都である。", "http://example.com/a", "https://www.example.org/path?q=1&x=2",
    "ftp://files.example.net/pub/file.tar.gz", "「http://jp.example.jp/ページ」", "www.example.com",
    "192.168.0.1:8080/index.html", "Node.js", "U.S.Army", "ファイル:a.png", "ファイル:長い名前.jpeg 説明",
    "　", "\u0085", " ", "\u001c", "\x0b", "\t", "😀", "𠮷野家", " - Wikipedia Dump ",
    "移動先:\t\t\t\t\t案内、\t\t\t\t\t検索", "出典: フリー百科事典『ウィキペディア（Wikipedia）』",
    "」から取得", "脚注", "a", "abc def", "x.y", "1.2.3.4", "mail me at a.b@c.de now", "  ",
]


def random_line(rng: random.Random) -> str:
    parts = [rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 6))]
    s = rng.choice(["", " "]).join(parts)
    if rng.random() < 0.08:
        s = "^" + s
    return s


def random_text(rng: random.Random) -> str:
    ends = ["\n", "\r\n", "\r"]
    lines = [random_line(rng) + rng.choice(ends) for _ in range(rng.randint(0, 12))]
    text = "".join(lines)
    if rng.random() < 0.5:
        text += random_line(rng)  # unterminated last line
    return text


def test_whitespace_class_matches_python(spark):
    """Code-point predicate and regex class both equal Python's \\s, for every
    code point below U+30000 (surrogates excluded)."""
    import re
    cps = [cp for cp in range(0, 0x30000) if not 0xD800 <= cp <= 0xDFFF]
    sdf = spark.createDataFrame([(cp, chr(cp)) for cp in cps], "cp int, c string")
    res = sdf.select("cp", is_whitespace_cp(F.ascii("c")).alias("a"),
                     F.col("c").rlike("^" + WS_CLASS + "$").alias("b")).collect()
    assert len(res) == len(cps)
    for r in res:
        expect = re.match(r"\s", chr(r.cp)) is not None
        assert r.a == expect and r.b == expect, hex(r.cp)


def test_split_lines_matches_text_mode_read(spark):
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(150)] + ["", "\n", "a", "a\n\nb", "x\r\ny\rz\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.l for r in df.select("i", split_lines_expr(F.col("t")).alias("l")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == model.read_lines(t), repr(t)


def test_clean_line_matches_model(spark):
    rng = random.Random(2)
    lines = [random_line(rng) + "\n" for _ in range(3000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", clean_line(F.col("s")).alias("c")).collect()}
    bad = [(lines[i], got[i], model.clean(lines[i])) for i in range(len(lines)) if got[i] != model.clean(lines[i])]
    assert not bad, bad[:3]


def test_blanking_uses_first_match_length(spark):
    # two URLs of different lengths: both become blanks as long as the FIRST
    line = "see http://a.jp/x and http://longer.example.com/path end\n"
    got = spark.createDataFrame([(line,)], "s string").select(clean_line(F.col("s"))).first()[0]
    assert got == model.clean(line)
    assert len(got) != len(line)


def test_prefix_sum(spark):
    rng = random.Random(3)
    arrays = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 7, 64, 65, 1000, 5000)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    got = {r.i: r.p for r in df.select("i", prefix_sum(F.col("a")).alias("p")).collect()}
    for i, a in enumerate(arrays):
        run, acc = [], 0
        for x in a:
            acc += x
            run.append(acc)
        assert got[i] == run
