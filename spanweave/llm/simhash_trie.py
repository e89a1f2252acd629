"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are taken per document, then made distinct, so a group of exact
copies is one leaf.  The trie over the distinct fingerprints is joined with
itself: pairs of nodes of equal depth are traversed together, differing bits
are added up, and a pair is dropped as soon as they exceed the error budget.

The pairs above depth T (about one leaf per node) are dealt out by a shuffle:
every fingerprint goes to its own node and, as a visitor, to the smaller nodes
within the budget, so each node pair meets in one task, which traverses the
rest of the two subtries.  Two tries share the work: when two fingerprints differ
in at most D bits, one half of the bits holds at most D // 2 of them, so a trie
over each order of the halves allows only D // 2 in its first 32 levels, and no
link is lost.  Nodes with very many fingerprints are dealt out again at a greater
depth.  Tasks return spanning forests of the links they find, not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

HALF = 32
HEAVY_NODE = 65_536
DEEPER = 8
CHUNK_ROWS = 262_144
SLICE_PAIRS = 1_048_576


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles (XXH64, seed 42), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 65_536):
        hashes = np.array([digest(line[a:b - 1], 42) for a, b in zip(starts[at:min(n, at + 65_536)], ends[at + shingle - 1:])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed long."""
    cols = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema[:-1]] + ["fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return cols.mapInArrow(run, schema)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _budget(depth: int, distance: int) -> int:
    """Differing bits allowed in the first ``depth`` levels."""
    return distance // 2 if depth <= HALF else distance


def _rotated(fps: np.ndarray, order: int) -> np.ndarray:
    return fps if order == 0 else (fps << np.uint64(HALF)) | (fps >> np.uint64(HALF))


def deal(fps: DataFrame, depth: int, distance: int) -> DataFrame:
    """fps(fp) → (trie, node, leaf): each leaf at its own node of ``depth`` and at the smaller nodes within the budget."""
    budget = _budget(depth, distance)
    flips = [sum(1 << b for b in bits) for k in range(budget + 1) for bits in itertools.combinations(range(depth), k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in np.array_split(whole, max(1, len(whole) * len(flips) // SLICE_PAIRS)):
                for order in (0, 1):
                    leaf = _rotated(part, order)
                    own = leaf >> np.uint64(64 - depth)
                    nodes, leaves = [], []
                    for flip in flips:
                        node = own ^ np.uint64(flip)
                        here = node <= own
                        nodes.append(node[here])
                        leaves.append(leaf[here])
                    node, leaf = np.concatenate(nodes), np.concatenate(leaves)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), order, np.int32)), pa.array(node.view(np.int64)),
                                                      pa.array(leaf.view(np.int64))], names=["trie", "node", "leaf"])

    return fps.select("fp").mapInArrow(run, "trie int, node long, leaf long")


def traverse(leaves: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk node pairs down to leaf pairs within ``distance`` bits.

    ``leaves`` are sorted within each node; ``pairs`` holds (first, end) of node
    one, (first, end) of node two and the differing bits so far.  Yields the
    positions of linked leaves.  The walk is depth first over slices, so its
    memory does not grow with the number of links.
    """
    stack = [(depth, pairs)]
    while stack:
        depth, (lo1, hi1, lo2, hi2, k) = stack.pop()
        if len(lo1) > SLICE_PAIRS:
            for at in range(0, len(lo1), SLICE_PAIRS):
                stack.append((depth, tuple(x[at:at + SLICE_PAIRS] for x in (lo1, hi1, lo2, hi2, k))))
            continue
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        a, b = lo1[single], lo2[single]
        near = (a != b) & (_popcount(leaves[a] ^ leaves[b]) <= distance)
        if near.any():
            yield a[near], b[near]
        lo1, hi1, lo2, hi2, k = (x[~single] for x in (lo1, hi1, lo2, hi2, k))
        if not len(lo1) or depth >= 64:
            continue
        ones = np.concatenate([[0], np.cumsum((leaves >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        same = lo1 == lo2
        allowed = _budget(depth + 1, distance)
        parts = []
        for a_lo, a_hi, b_lo, b_hi, more, once in ((lo1, mid1, lo2, mid2, 0, False), (mid1, hi1, mid2, hi2, 0, False),
                                                   (lo1, mid1, mid2, hi2, 1, False), (mid1, hi1, lo2, mid2, 1, True)):
            on = (a_hi > a_lo) & (b_hi > b_lo) & (k + more <= allowed)
            if once:
                on &= ~same
            parts.append((a_lo[on], a_hi[on], b_lo[on], b_hi[on], k[on] + more))
        stack.append((depth + 1, tuple(np.concatenate(x) for x in zip(*parts))))


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among n leaves."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    one, two = [], []
    for a, b in links:
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                one.append(x)
                two.append(y)
    return one, two


def _join_nodes(trie: np.ndarray, node: np.ndarray, leaf: np.ndarray, depth: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the leaves of whole nodes, as fingerprints; rows of a node need not be sorted."""
    node = node.view(np.uint64)
    prefix = leaf >> np.uint64(64 - depth)
    order = np.lexsort((leaf, node, trie))
    trie, node, leaf, prefix = trie[order], node[order], leaf[order], prefix[order]
    new_node = np.concatenate([[True], (node[1:] != node[:-1]) | (trie[1:] != trie[:-1])])
    new_run = new_node | np.concatenate([[True], prefix[1:] != prefix[:-1]])
    first = np.flatnonzero(new_run)
    end = np.concatenate([first[1:], [len(leaf)]])
    node_of_run = np.cumsum(new_node)[first]
    home = prefix[first] == node[first]  # the smallest prefix of its node, so its first run if there at all
    home_run = np.full(node_of_run[-1] + 1, -1)
    home_run[node_of_run[home]] = np.flatnonzero(home)
    mine = home_run[node_of_run]
    meets = mine >= 0
    one, two = mine[meets], np.flatnonzero(meets)
    pairs = (first[one], end[one], first[two], end[two], _popcount(prefix[first[one]] ^ prefix[first[two]]))
    a, b = _forest(len(leaf), traverse(leaf, pairs, depth, distance))
    back = np.where(trie == 1, (leaf << np.uint64(HALF)) | (leaf >> np.uint64(HALF)), leaf)
    return back[a], back[b]


def _links(dealt: DataFrame, depth: int, distance: int) -> DataFrame:
    """(trie, node, leaf) → links (a, b) between fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def join(table: np.ndarray) -> pa.RecordBatch:
            a, b = _join_nodes(table[0], table[1], table[2].view(np.uint64), depth, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]))
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:  # whole nodes only; the last may go on in the next batch
                table = np.concatenate(held, axis=1)
                last = (table[0] == table[0, -1]) & (table[1] == table[1, -1])
                if not last.all():
                    yield join(table[:, ~last])
                    held, rows = [table[:, last]], int(last.sum())
                else:
                    held = [table]
        if rows:
            yield join(np.concatenate(held, axis=1))

    return dealt.repartition("trie", "node").sortWithinPartitions("trie", "node").mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, distance: int = 2, heavy_node: int = HEAVY_NODE, start_depth: int | None = None) -> DataFrame:
    """fps(fp, distinct) → links (a, b) whose components are those of all pairs at most ``distance`` bits apart."""
    depth = start_depth or min(HALF, max(8, fps.count().bit_length()))
    dealt, found = deal(fps, depth, distance), None
    while True:
        heavy = materialize(dealt.groupBy("trie", "node").count().where(F.col("count") > heavy_node).select("trie", "node"), "trie-heavy")
        deepen = depth < 64 - DEEPER and not heavy.isEmpty()
        links = materialize(_links(dealt.join(heavy, ["trie", "node"], "left_anti") if deepen else dealt, depth, distance), "trie-links")
        found = links if found is None else found.unionByName(links)
        if not deepen:
            return found
        # The leaves of heavy nodes again, deeper, at the nodes below the heavy ones.
        leaves = dealt.join(heavy, ["trie", "node"], "left_semi")
        fp = F.when(F.col("trie") == 1, F.shiftleft("leaf", HALF).bitwiseOR(F.shiftrightunsigned("leaf", 64 - HALF))).otherwise(F.col("leaf"))
        again = deal(materialize(leaves.select(fp.alias("fp")).distinct(), "trie-deeper"), depth + DEEPER, distance)
        above = heavy.withColumnRenamed("node", "_above")
        dealt = again.withColumn("_above", F.shiftrightunsigned("node", DEEPER)).join(above, ["trie", "_above"], "left_semi").select("trie", "node", "leaf")
        depth += DEEPER


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``keep``, fp (signed), group_fp, fingerprint (16 hex digits), component_id.

    group_fp is one fingerprint of the component, the same for all its documents.
    component_id is the smallest id of the documents that links of at most
    ``distance`` differing bits reach.

    Defined results: a null or empty text has fingerprint zero and is linked like
    any other; a null id never becomes a component's id unless all are null;
    repeated rows are in one component; an empty table gives no rows; columns not
    named are ignored.
    """
    marked = materialize(with_fingerprints(docs, text_col, shingle, (id_col, *keep)), "simhash")
    leaves = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")), "simhash-leaves")
    roots = connected_components(near_links(leaves.select("fp"), distance)).withColumnRenamed("node", "fp")
    linked = materialize(roots.join(leaves, "fp"), "simhash-linked")
    groups = materialize(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-groups")
    of_leaf = leaves.join(linked.select("fp", "root"), "fp", "left").join(groups, "root", "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("group_fp"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = marked.join(materialize(of_leaf, "simhash-components"), F.col("fp") == F.col("_fp"))
    return out.select(id_col, *keep, "fp", "group_fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
