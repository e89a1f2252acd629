"""SimHash trie join, suffix dedup and decontamination against brute force."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from spanweave.llm import simhash_trie, spaced_seed, suffix_dedup
from spanweave.llm.graph import connected_components
from tests.llm.data import awkward, documents


def components(items, linked):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b) and find(a) != find(b):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for x in items:
        groups[find(x)].add(x)
    return list(groups.values())


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_fingerprints_and_components(spark):
    rows = awkward(30)
    got = simhash_trie.near_duplicates(documents(spark, rows)).collect()
    want = [(r[0], brute_fingerprint(r[1])) for r in rows]
    assert sorted(str((r.doc_id, r.fingerprint)) for r in got) == sorted(str((i, f"{f:016x}")) for i, f in want)
    first = {}
    for group in components(sorted({f for _, f in want}), lambda a, b: (a ^ b).bit_count() <= 2):
        ids = [i for i, f in want if f in group and i is not None]
        first.update({f"{f:016x}": min(ids, default=None) for f in group})
    assert all(r.component_id == first[r.fingerprint] for r in got)
    assert simhash_trie.near_duplicates(documents(spark, [])).count() == 0


def test_spark_hashes_shingles_alike(spark):
    r = spark.sql("select xxhash64('the quick brown') h").first().h
    assert r % (1 << 64) == xxhash.xxh64_intdigest(b"the quick brown", 42)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("heavy", [10**6, 15])
def test_trie_join_loses_no_link(spark, distance, heavy):
    rng = random.Random(distance)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash_trie.near_links(spark.createDataFrame(signed, "fp long"), distance, heavy_node=heavy, start_depth=8)
    got = collections.defaultdict(set)
    for node, root in connected_components(links).collect():
        got[root].add(node % (1 << 64))
    want = [g for g in components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= distance) if len(g) > 1]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_suffix_array_matches_a_sort():
    rng = random.Random(0)
    for _ in range(600):
        t = np.array([rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(1, 60))])
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_array_of_many_symbols(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BITS", 2)  # as if the names were too large to pack
    test_suffix_array_matches_a_sort()


def brute_removed(texts, length):
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("heavy", [suffix_dedup.HEAVY_BYTES, 60])
def test_repeats_are_cut_out_exactly(spark, heavy, monkeypatch):
    rng = random.Random(5)
    parts = ["abcabcabc", "xy" * 12, "hello world foo bar baz", "q" * 30, "é" * 9]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))
                        for _ in range(rng.randint(0, 4)))) for i in range(80)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (200, None), (201, "")]
    docs = documents(spark, [(i, t, None, None, None, None, None, None) for i, t in rows])
    got = suffix_dedup.remove_repeats(docs, length=20, anchor=8, heavy_bytes=heavy).collect()
    want = brute_removed([(t or "").encode() for _, t in rows], 20)
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(str((i, *w)) for (i, _), w in zip(rows, want))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_the_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_removed([(r.text or "").encode() for r in rows], 400)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).drop("kept").collect()}
    assert got == want
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 100)
    rng = random.Random(2)
    raw = bytes(rng.choice(b"ab") for _ in range(1000))
    rolling = suffix_dedup._Rolling(suffix_dedup._BASE, 200)
    at = 0
    for _, first, end, _ in suffix_dedup.anchors(raw, 20, 8, rolling):
        assert first[0] == at and (first[1:] == end[:-1]).all()
        at = int(end[-1])
    assert at == len(raw) - 19


def words(text):
    return (text or "").encode().lower().split()


def brute_overlaps(docs, items):
    found = set()
    for i, text in docs:
        w = words(text)
        for k, item in items:
            v = words(item)
            width = min(spaced_seed.WINDOW, len(v))
            if len(v) < spaced_seed.MIN_ITEM_WORDS:
                continue
            need = math.ceil(spaced_seed.SIMILARITY * width)
            for shift in range(-len(v) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                same = [w[j + shift] == v[j] for j in range(lo, hi)]
                if any(sum(same[s:s + width]) >= need for s in range(len(same) - width + 1)):
                    found.add((i, k))
                    break
    return found


def test_masks_survive_every_pair_of_substitutions():
    for a in range(13):
        for b in range(a):
            assert any(not {s + o for o in m} & {a, b} for m in spaced_seed.MASKS for s in range(13 - m[-1]))


def test_every_allowed_substitution_set_is_found(spark):
    """Items of 5 to 13 words, each with every set of substitutions that 80 % allows, and with one more."""
    items, docs, want = [], [], {}
    for m in range(spaced_seed.MIN_ITEM_WORDS, spaced_seed.WINDOW + 1):
        item = [f"w{m}x{i}" for i in range(m)]
        items.append((m, " ".join(item)))
        allowed = m - math.ceil(spaced_seed.SIMILARITY * m)
        for gone in (g for k in range(allowed + 2) for g in itertools.combinations(range(m), k)):
            if len(gone) <= allowed:
                want[len(docs), m] = m - len(gone)
            docs.append((len(docs), " ".join(["before", *["changed" if j in gone else w for j, w in enumerate(item)], "after"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = spaced_seed.find_overlaps(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.equal_words for r in found.collect()} == want


@pytest.mark.parametrize("block", [spaced_seed.MAX_BLOCK, 40])
def test_overlaps_match_brute_force(spark, block):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([3, 5, 6, 7, 9, 12, 13, 20, 30])))) for k in range(14)] + [(14, None), (15, ""), (3, "one more text with this id"), (None, "a b c d e f g h i")]
    docs = []
    for i in range(60):
        body = say(rng.randint(0, 30))
        if rng.random() < 0.7:
            quote = rng.choice(items)[1] or ""
            part = quote.split()[rng.randint(0, 3):]
            for _ in range(rng.randint(0, 3)):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [p.upper() if rng.random() < 0.3 else p for p in part]
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (None, items[9][1]), (5, docs[5][1])]
    frame = documents(spark, [(i, t, None, None, None, None, None, None) for i, t in docs])
    bench = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in spaced_seed.find_overlaps(frame, bench, max_block=block).collect()}
    assert got == brute_overlaps(docs, items)
    left = spaced_seed.remove_contaminated(frame, spaced_seed.find_overlaps(frame, bench))
    gone = {i for i, _ in got}
    assert left.columns == frame.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in gone)
    assert spaced_seed.find_overlaps(frame, bench.limit(0)).count() == 0
    assert spaced_seed.find_overlaps(frame.limit(0), bench).count() == 0


def test_seed_rows_are_narrow_and_blocks_are_jobs(spark):
    frame = documents(spark)
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(4)], "item_id long, text string")

    def nodes(df):
        todo = [df._jdf.queryExecution().optimizedPlan()]
        while todo:
            node = todo.pop()
            yield node
            todo += [node.children().apply(i) for i in range(node.children().size())]

    one = [n for n in nodes(spaced_seed.find_overlaps(frame, bench)) if n.nodeName() == "Generate"]
    carried = [{str(n.output().apply(i)).split("#")[0] for i in range(n.output().size())} for n in one]
    assert len(one) == 2 and not any("text" in c for c in carried)
    # Several blocks: their broadcasts are gone when the result is put together.
    assert not any(n.nodeName() in ("Generate", "Join") for n in nodes(spaced_seed.find_overlaps(frame, bench, max_block=60)))
