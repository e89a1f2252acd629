"""Source mixing, URL rules and the content-addressed archive."""

import base64
import hashlib
import random

import pytest

from spanweave.llm import mixing, url_rules, warc
from spanweave.llm.common import new_folder
from tests.llm.data import awkward, documents

WEIGHTS = (5, 2, 1)


def brute_targets(sizes, weights=WEIGHTS, most=3):
    """Share, cap, reshare the excess until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if target[s] >= most * sizes[s]}
        if not over or len(over) == len(free):
            return {**capped, **target, **(over if len(over) == len(free) else {})}
        capped.update(over)


def test_targets_and_taken_words(spark):
    rng = random.Random(4)
    rows = awkward() + [(1000 + i, "word " * rng.randint(1, 30), "en", rng.choice(["s1", "tiny", "Ünï", "", "s9"]), 0, "", "", "") for i in range(200)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, largest, taken = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix_sources(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_equal_rows_are_counted_apart(spark):
    rows = [(1, "a b c", "en", "s1", 0, "", "", "")] * 90 + [(2, "x", "en", "s2", 0, "", "", "")] * 30
    got = mixing.mix_sources(documents(spark, rows)).collect()
    for source, target in brute_targets({"s1": 270, "s2": 30}).items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 1.5
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_sources(documents(spark, [(1, None, None, None, None, None, None, None)])).collect()] == [0]


def test_better_documents_are_taken_first(spark):
    rows = [(i, "word " * 10 + ("| " * 9 if i % 2 else ""), "en", "big", 0, "", "", "") for i in range(400)]
    rows += [(1000 + i, "word " * 5, "en", "asmall", 0, "", "", "") for i in range(50)]
    got = [r for r in mixing.mix_sources(documents(spark, rows), weights=(1, 1)).collect() if r.source == "big"]
    plain, marked = sum(r.copies for r in got if r.doc_id % 2 == 0), sum(r.copies for r in got if r.doc_id % 2)
    assert plain > marked


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fit, default=(0, 0, None, default))
    return host, path, rule, verdict


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
         ("block", "b.c", ""), ("allow", "c", "/x"), ("block", "c", "/x/y/z"), ("allow", "d.e.f.g", "/p"), ("block", "g", "/pq/r")]


def test_urls_match_brute_force(spark):
    rng = random.Random(1)
    urls = [None, "", "net/", "http://", "http:///en/", "HTTP://A.Net", "http://a.net/", "http://a.net?x", "x://y://example.net/en/", "http://example.net/en/a#b?c",
            "http://notexample.net/en/", "http://b.c", "http://a.b.c/x/y/z/w", "http://É.org/fr/é", "http://a.org:80/fr/", "http://e.f.g/pq/r/" + "s/" * 5000,
            "http://" + "sub." * 3000 + "net/x", "http://u@example.com/de/\n/x", "http://.net/", "http://net./"]
    urls += [f"http://{'.'.join(rng.choice('abcdefg') for _ in range(rng.randint(1, 5)))}/{'/'.join(rng.choice(['x', 'y', 'z', 'p', 'pq', 'r', '']) for _ in range(rng.randint(0, 4)))}"
             for _ in range(400)]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, urls[6], None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, prefix string")
    rules = spark.createDataFrame(RULES + [("block", None, "/"), (None, "a", "/")], url_rules.RULE_SCHEMA)
    got = url_rules.judge_urls(pages, rules).collect()
    have = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)
    assert have == sorted(str((r[0], *brute_verdict(r[1], RULES))) for r in rows)
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_archive_round_trip(spark):
    html = ["<p>one</p>", "", None, "é\r\n\r\nWARC/1.1\r\n", "<p>one</p>", "<p>one</p>", "x" * 200_000]
    rows = [(i, f"http://h/{i}" if i else None, h, "clash") for i, h in enumerate(html)] + [(None, "http://n", "<p>one</p>", ""), (2, "http://h/2", None, ""), (9, "http://a\r\nb", "once", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.read_archive(spark, warc.write_archive(pages, new_folder(spark, "warc-test"))).collect()
    assert len(got) == len(rows)
    by_payload = {}
    for r in got:
        raw = (next(h for i, _, h, _ in rows if i == r.page_id) or "").encode()
        assert bytes(r.payload) == raw and r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        by_payload.setdefault(raw, []).append(r)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert bytes(r.header) == head + b"\r\n\r\n"
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[:length] == (b"" if r.record_type == "revisit" else raw) and rest[length:] == b"\r\n\r\n"
    for raw, rs in by_payload.items():
        first = min(i for i, _, h, _ in rows if (h or "").encode() == raw and i is not None)
        responses = [r for r in rs if r.record_type == "response"]
        assert len(responses) == 1 and responses[0].page_id == first and responses[0].refers_to is None
        assert all(r.refers_to == first for r in rs if r.record_type == "revisit")
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0), new_folder(spark, "warc-empty"))).count() == 0
    small = warc.read_archive(spark, warc.write_archive(pages, new_folder(spark, "warc-min"), min_revisit_bytes=11)).collect()
    assert all(r.record_type == "response" for r in small)


def test_payloads_are_stored_once_and_verified(spark):
    pages = spark.createDataFrame([(i, "u", "same") for i in range(50)], "page_id long, url string, html string")
    path = warc.write_archive(pages, new_folder(spark, "warc-once"))
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == 1
    broken = new_folder(spark, "warc-broken")
    stored.selectExpr("sha256", "n_bytes", "encode('sane', 'UTF-8') as payload").write.parquet(f"{broken}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{broken}/headers")
    with pytest.raises(Exception, match="payload does not match its digest"):
        warc.read_archive(spark, broken).collect()
