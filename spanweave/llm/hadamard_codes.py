"""Product-quantized vector codes by an integer Walsh-Hadamard transform.

Vectors become integers (components scaled and floored), are cut into equal
consecutive parts, and every part position gets a codebook of its own, refined
by a fixed number of rounds.  The nearest entry is found in the transform
domain: parts and entries are padded with zeros to a power of two and
transformed with additions only, squared differences are summed up coefficient
by coefficient in sequency order (few sign changes, hence most of the energy,
first), and an entry leaves as soon as its partial sum passes a distance that
some entry is known to reach.  A sum over all coefficients is the squared
distance times the padded width (Parseval), so the division is exact; nothing
is rounded, and integers too wide for 64 bits are carried as Python integers.

Work is narrow: each round is one pass over the vectors in which every task adds
up its own parts per entry; only these sums (their number is the codebooks'
size, whatever the number of vectors) are shuffled and reach the driver.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped; shorter vectors are padded with zeros to the longest kept
one, whose length is rounded up to a multiple of the number of parts; entries are
seeded by the smallest ids (null ids last, equal ids by their vectors), and fewer
vectors than entries give a smaller codebook; repeated rows count each; an empty
table gives no rows; an error beyond a long is null, as is the sum of its label;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LIMB = 40  # bits of the digits that sums are shuffled in
BROADCAST_LABELS = 100_000
SALTS = 16
LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """Parts per vector, entries per codebook (at most 256), refining rounds, and the scale of the components."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


# --- transform ----------------------------------------------------------------

def sequency_order(width: int) -> np.ndarray:
    """Rows of the natural-order Hadamard matrix of size ``width`` by their number of sign changes."""
    row = np.ones((1, 1), np.int8)
    while len(row) < width:
        row = np.block([[row, row], [row, -row]])
    return np.argsort((np.diff(row, axis=1) != 0).sum(axis=1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows of ``x``, padded with zeros, in sequency order."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width), x.dtype)
    y[:, :x.shape[1]] = x
    half = 1
    while half < width:
        pairs = y.reshape(len(x), -1, 2, half)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
        half *= 2
    return y[:, sequency_order(width)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of ``entries``, squared distance) of each row of ``x``; ties go to the lower index."""
    width = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * 2 * width * (width * most) ** 2 >= LONG_MAX:
        x, entries = x.astype(object), entries.astype(object)
    a, b = transform(x), transform(entries)
    first = (a[:, :1] - b[:, 0]) ** 2
    # A distance that is reached: that of the entry nearest in the first coefficient.
    bound = ((a - b[np.argmin(first, axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])  # by row, then entry
    total = first[row, entry]
    for k in range(1, a.shape[1]):
        total = total + (a[row, k] - b[entry, k]) ** 2
        alive = total <= bound[row]
        row, entry, total = row[alive], entry[alive], total[alive]
    starts = np.searchsorted(row, np.arange(len(x)))  # the bound's own entry stays in every row
    least = np.minimum.reduceat(total, starts) if len(x) else total
    at = np.flatnonzero(total == least[row])
    at = at[np.searchsorted(row[at], np.arange(len(x)))]
    return entry[at], total[at] // a.shape[1]


# --- vectors ------------------------------------------------------------------

def _integers(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """Rows of floor(scale × component), padded with zeros to ``length``; Python integers where 64 bits don't do."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if np.abs(flat).max(initial=0.0) * scale < 1 << 31:
        out = np.zeros((len(sizes), length), np.int64)
        out[row, at] = np.floor(flat * scale).astype(np.int64)
    else:
        out = np.zeros((len(sizes), length), object)
        for r, k, v in zip(row.tolist(), at.tolist(), flat.tolist()):
            numerator, denominator = v.as_integer_ratio()
            out[r, k] = numerator * scale // denominator
    return out


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(_id, _label, _v) of the rows whose vector is whole."""
    v = F.col(vector_col).cast("array<double>")
    whole: Callable[[Column], Column] = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.where(v.isNotNull() & F.forall(v, whole)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), v.alias("_v"))


def _codes(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), one column per part."""
    width = books.shape[2]
    found = [nearest(vectors[:, p * width:(p + 1) * width], books[p]) for p in range(len(books))]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


# --- codebooks ----------------------------------------------------------------

def _sums(kept: DataFrame, books: np.ndarray, s: Settings) -> DataFrame:
    """(slot, limb, digit): sums of the parts per entry and position, and in the last position their number."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), object)
        for batch in batches:
            x = _integers(batch.column(0), parts * width, s.scale)
            codes, _ = _codes(x, books)
            for p in range(parts):
                own = np.zeros((entries, width + 1), x.dtype)
                np.add.at(own, codes[:, p], np.concatenate([x[:, p * width:(p + 1) * width], np.ones((len(x), 1), x.dtype)], axis=1))
                sums[p] += own.astype(object)
        slots, limbs, digits = [], [], []
        for slot, value in enumerate(sums.ravel().tolist()):
            sign, value, limb = (1 if value > 0 else -1), abs(value), 0
            while value:
                slots.append(slot)
                limbs.append(limb)
                digits.append(sign * (value & ((1 << LIMB) - 1)))
                value, limb = value >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(limbs, pa.int32()), pa.array(digits, pa.int64())], names=["slot", "limb", "digit"])

    return kept.select("_v").mapInArrow(run, "slot int, limb int, digit long").groupBy("slot", "limb").agg(F.sum("digit").alias("digit"))


def _narrow(books: np.ndarray) -> np.ndarray:
    """64-bit integers where they do, so that Python integers stay the exception."""
    return books.astype(np.int64) if all(abs(x) < 1 << 31 for x in books.ravel().tolist()) else books


def _refine(kept: DataFrame, books: np.ndarray, s: Settings) -> np.ndarray:
    """The codebooks after one round: entries become the floored means of their parts, unused ones stay."""
    sums = np.zeros((*books.shape[:2], books.shape[2] + 1), object)
    flat = sums.reshape(-1)
    for slot, limb, digit in _sums(kept, books, s).collect():
        flat[slot] += digit << (LIMB * limb)
    n = sums[:, :, -1:]
    return _narrow(np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books.astype(object)))


def train(kept: DataFrame, s: Settings) -> np.ndarray:
    """Codebooks (part, entry, position) of the vectors ``kept`` (_id, _label, _v), which are not empty."""
    longest = kept.agg(F.max(F.size("_v"))).first()[0]
    width = max(1, -(-longest // s.parts))
    seeds = kept.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(s.entries).select("_v").collect()
    first = _integers(pa.array([r[0] for r in seeds], pa.list_(pa.float64())), s.parts * width, s.scale)
    books = _narrow(first.reshape(len(seeds), s.parts, width).transpose(1, 0, 2).astype(object))
    for _ in range(s.rounds):
        books = _refine(kept, books, s)
    return books


def digest(books: np.ndarray) -> str:
    """Lower-case hex SHA-256 of all components in decimal, by part, entry and position, joined with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


# --- codes --------------------------------------------------------------------

def encode(kept: DataFrame, books: np.ndarray, s: Settings) -> DataFrame:
    """(_id, _label, code, error) of every kept vector."""
    shared = kept.sparkSession.sparkContext.broadcast(books)  # parts × entries × width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            codes, errors = _codes(_integers(batch.column(2), books.shape[0] * books.shape[2], s.scale), books)
            whole = codes.astype(np.uint8).tobytes().hex()
            step = 2 * s.parts
            text = [whole[i:i + step] for i in range(0, len(whole), step)]
            total = [e if e <= LONG_MAX else None for e in errors.astype(object).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(total, pa.int64())],
                                             names=["_id", "_label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds the errors' sum over equal labels; a large set of labels is joined by sort and merge, the hot ones salted."""
    # One null error makes its label's sum null.
    sums = materialize(coded.groupBy(F.col("_label").alias("_of")).agg(F.expr("CASE WHEN count(error) = count(*) THEN try_sum(error) END").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("_label").eqNullSafe(F.col("_of")), "left")
    salted = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    big = coded.withColumn("_r", F.pmod(F.xxhash64("_id", "code"), F.lit(SALTS)).cast("int"))
    return big.join(salted.hint("merge"), F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_r") == F.col("_s")), "left")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """``id_col``, code, error, label_error, codebooks_sha256 of every kept vector (see the module's text)."""
    if not 0 < settings.entries <= 256:
        raise ValueError("a code digit names one of at most 256 entries")
    kept = _kept(vectors, id_col, vector_col, label_col)
    out = [F.col("_id").alias(id_col), "code", "error", "label_error", "codebooks_sha256"]
    if kept.isEmpty():
        return kept.select("_id", *[F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]).select(*out)
    books = train(kept, settings)
    coded = materialize(encode(kept, books, settings), "hadamard-codes")
    return _with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest(books))).select(*out)


def compress_sql(s: Settings = Settings()) -> str:
    """DuckDB statement of :func:`compress` over the table embeddings (vectors of one length, a multiple of the parts)."""
    def assign(name: str, book: str) -> str:
        return f"""{name}_d AS (SELECT c.vec_id, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN {book} b ON c.p = b.p AND c.i = b.i GROUP BY ALL),
{name} AS (SELECT vec_id, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM {name}_d GROUP BY ALL)"""

    rounds = []
    for k in range(s.rounds):
        rounds.append(assign(f"a{k}", f"book{k}"))
        rounds.append(f"""m{k} AS (SELECT a.p, a.e, c.i, sum(c.x)::BIGINT AS t, count(*) AS n FROM a{k} a JOIN cells c ON a.vec_id = c.vec_id AND a.p = c.p GROUP BY ALL),
book{k + 1} AS (SELECT b.p, b.e, b.i, CASE WHEN m.n IS NULL THEN b.x ELSE (m.t - ((m.t % m.n) + m.n) % m.n) // m.n END AS x FROM book{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)""")
    body = ",\n".join([*rounds, assign("z", f"book{s.rounds}")])
    return f"""
WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
flat AS (SELECT vec_id, len(v) // {s.parts} AS w, unnest(range(len(v))) AS j, unnest(v) AS y FROM kept),
cells AS (SELECT vec_id, (j // w)::BIGINT AS p, (j % w)::BIGINT AS i, floor({s.scale} * y::DOUBLE)::BIGINT AS x FROM flat),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {s.entries}),
book0 AS (SELECT p, e, i, x FROM cells JOIN seeds USING (vec_id)),
{body},
coded AS (SELECT vec_id, string_agg(lpad(to_base(e, 16), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{s.rounds})
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), sha"""
