"""Integer Walsh-Hadamard codes and phrase collocations against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanweave.llm import hadamard_codes, phrases
from tests.llm.data import awkward, documents

VECTORS = "vec_id long, embedding array<float>, label int, code string, _id string"


# --- vector codes ---------------------------------------------------------------

def brute_codes(rows, parts, entries, rounds, scale):
    """(vec_id, label, code, error) in Python integers, and the codebooks' digest."""
    whole = [(i, l, [math.floor(scale * x) if abs(x) < 2**40 else int(x) * scale for x in v]) for i, v, l, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, _, v in whole) // parts))
    whole = [(i, l, v + [0] * (parts * width - len(v))) for i, l, v in whole]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    seeds = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in seeds] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, _, v in whole:
                members[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(m) for x in zip(*m)] if m else books[p][k] for k, m in enumerate(members)])
        books = new
    out = []
    for i, l, v in whole:
        found = [near(v, p) for p in range(parts)]
        out.append((i, l, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check_codes(spark, rows, settings, partitions=3):
    got = hadamard_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(partitions), settings=settings).collect()
    want, sha = brute_codes(rows, settings.parts, settings.entries, settings.rounds, settings.scale)
    label_error = Counter()
    for _, l, _, e in want:
        label_error[l] += e
    fits = lambda x: x if x < 2**63 else None
    assert Counter(map(tuple, got)) == Counter((i, c, fits(e), fits(label_error[l]), sha) for i, l, c, e in want)


def test_codes_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(24)], rng.choice([0, 1, None]), "c", "i") for i in range(150)]
    rows += rows[:5] + [(900 + i, rows[7][1], 1, "c", "i") for i in range(20)]  # repeated rows, equal vectors
    rows += [(200, None, 1, "", ""), (201, [0.1, None] * 12, 1, "", ""), (202, [float("nan")] + [0.0] * 23, 1, "", ""), (203, [float("-inf")] * 24, 1, "", ""),
             (None, [rng.random() for _ in range(24)], None, None, None), (-4, [0.5, -0.5], 2, "", ""), (-5, [], 2, "", "")]
    check_codes(spark, rows, hadamard_codes.Settings(parts=8, entries=16))
    check_codes(spark, rows[:9], hadamard_codes.Settings(parts=4, entries=16), 1)  # fewer vectors than entries
    assert hadamard_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    assert hadamard_codes.compress(spark.createDataFrame(rows[-7:-3], VECTORS)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_wide_components_stay_exact(spark):
    rng = random.Random(5)
    wide = lambda: float(np.float32(rng.choice([1e-3, 1.0, 3e4, 7e18, 2e38]) * rng.uniform(-1, 1)))
    check_codes(spark, [(i, [wide() for _ in range(12)], i % 3, "", "") for i in range(40)], hadamard_codes.Settings(parts=4, entries=6))


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 4, 7, 8):
        x, e = rng.integers(-99, 99, (50, width)), rng.integers(-99, 99, (9, width))
        e[5] = e[2]  # ties
        n = hadamard_codes.transform(x).shape[1]
        assert (hadamard_codes.transform(x) ** 2).sum() == n * (x ** 2).sum()
        d = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        code, least = hadamard_codes.nearest(x, e)
        assert (code == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    changes = [(np.diff(row) != 0).sum() for row in hadamard_codes.transform(np.eye(8, dtype=np.int64)).T]
    assert changes == list(range(8))


def test_many_labels_join_salted(spark, monkeypatch):
    monkeypatch.setattr(hadamard_codes, "BROADCAST_LABELS", 1)
    rng = random.Random(9)
    check_codes(spark, [(i, [rng.random() for _ in range(4)], rng.choice([0, None, i]), "", "") for i in range(60)], hadamard_codes.Settings(parts=2, entries=4))


# --- phrases --------------------------------------------------------------------

def brute_phrases(rows, s):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, s.longest + 1):
                f.update((lang, *words[i:i + m]) for i in range(len(words) - m + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= s.least}
    out = []
    for p, a in found.items():
        lang, words = p[0], p[1:]
        if any(q[0] == lang and 100 * b >= s.absorb_percent * a and any(q[i:i + len(words)] == words for i in range(1, len(q) - len(words) + 1)) for q, b in found.items() if len(q) > len(p)):
            continue
        cuts = [(s.scale * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:s.top])]
    return sorted(ranked, key=str)


@pytest.mark.parametrize("shard_bytes, range_tokens", [(8 << 20, 1 << 20), (300, 50)])
def test_phrases_match_brute_force(spark, monkeypatch, shard_bytes, range_tokens):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(phrases, "RANGE_TOKENS", range_tokens)
    rng = random.Random(7)
    vocab = ["of", "the", "The", "new", "york", "times", "é", "日本", "a\x01", "a", "x\xa0y", "--"]
    text = lambda: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    rows = awkward() + [(i, text() + rng.choice(["the new york times ", "of the "]) * rng.randint(0, 6), rng.choice(["en", "fr", None, ""]), "s", 0, "", "", "") for i in range(150)]
    for s in (phrases.Settings(least=12), phrases.Settings(least=5, absorb_percent=80, top=40, longest=4), phrases.Settings(least=9, longest=2)):
        got = phrases.mine(documents(spark, rows).repartition(5), settings=s).collect()
        want = brute_phrases(rows, s)
        assert sorted(map(tuple, got), key=str) == want and want


def test_phrases_of_nothing(spark):
    assert phrases.mine(documents(spark, [])).collect() == []
    assert phrases.mine(documents(spark)[["lang", "text"]].where("text is null")).collect() == []
    rare = phrases.mine(documents(spark), settings=phrases.Settings(least=10**9))
    assert rare.collect() == [] and rare.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_pass_64_bits(spark):
    # 1000 * a * n beyond a long: the decimal expression of the score against Python integers.
    rng = random.Random(2)
    rows = [(rng.randint(1, 10**13), rng.randint(10**10, 10**13), rng.randint(1, 10**13), rng.randint(1, 10**13)) for _ in range(200)]
    got = phrases.cut_score(spark.createDataFrame(rows, "n long, size long, l long, r long"), 1000).collect()
    assert all(r.score == 1000 * r.n * r.size // (r.l * r.r) for r in got)
