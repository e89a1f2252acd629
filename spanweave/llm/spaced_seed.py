"""Benchmark decontamination with spaced seeds.

A fixed mask selects some of the tokens of a window and ignores the others, so a
substituted token in an ignored place does not spoil the hash.  The hashes of all
benchmark windows are joined with those of all windows of the documents, and
around every hit the two texts are laid side by side: a document is contaminated
by an item when some ``WINDOW`` tokens in a row that hold the hit agree in 80 %
or more (the whole item, if it is shorter).

Shape: one scan of the documents, which never leave their partition.  The seeds
are those of the benchmark, not of the corpus; they are broadcast in blocks of at
most ``MAX_BLOCK`` seeds, one scan and one job per block, so the broadcast is bounded
however large the benchmark is.  Only verified hits are shuffled, combined map-side.
Windows are unrolled by a generator and hashed in generated code.  No Python.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, words

# Offsets of the selected tokens.  Any 13 tokens with at most two substituted
# hold an intact placement of one of these (tests/llm checks all cases).
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8))
# Besides these, for items of 8 to 12 words, which are verified on their own width:
# with them, any substitutions that the verifier accepts leave a placement intact.
SHORT_MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 3, 4, 5), (0, 1, 5, 6, 8))
# For items of 5 to 7 words, of which 80 % allows one substitution: any one leaves a placement intact.
TINY_MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
WINDOW = 13
SIMILARITY = 0.8
MIN_ITEM_WORDS = 5
MAX_BLOCK = 1_000_000


def token_hashes(text: Column) -> Column:
    """A hash per word of the text, ASCII letters lower-cased."""
    return F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))


def _window_hash(tokens: Column, at: Column, i: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(i), *[F.get(tokens, at + o) for o in mask])


def _window_hashes(tokens: Column, n: Column, at: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """The hashes of the masks placed at ``at``; null where a mask runs past the end."""
    return F.array(*[F.when(at + mask[-1] < n, _window_hash(tokens, at, i, mask)) for i, mask in enumerate(masks)])


def _unrolled(df: DataFrame, masks: tuple[tuple[int, ...], ...], keep: tuple[str, ...]) -> DataFrame:
    """df(tokens, …) → ``keep``, tokens, at, seed: a row for every window of every mask.

    ``*_outer`` with a filter on the generated column keeps the optimizer from
    copying the tokenization into a filter below the generator.
    """
    shortest = min(m[-1] for m in masks)
    last = F.size("tokens") - 1 - shortest
    starts = df.select(*keep, "tokens", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    hashed = starts.select(*keep, "tokens", "at", F.explode_outer(_window_hashes(F.col("tokens"), F.size("tokens"), F.col("at"), masks)).alias("seed"))
    return hashed.where("seed is not null")


def _seeds(items: DataFrame, i: int, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(seed, item_no, q) of one mask; short masks are for the items of 8 to 12 words, tiny ones for those of 5 to 7."""
    n, span, short = F.size("tokens"), masks[i][-1] + 1, min(m[-1] + 1 for m in MASKS)
    if masks[i] in TINY_MASKS:
        fit = items.where(n.between(max(span, MIN_ITEM_WORDS), short - 1))
    elif masks[i] in SHORT_MASKS:
        fit = items.where(n.between(max(span, short), WINDOW - 1))
    else:
        fit = items.where(n >= span)
    at = fit.select("item_no", "tokens", F.explode(F.sequence(F.lit(0), n - span)).alias("q"))
    return at.select(_window_hash(F.col("tokens"), F.col("q"), i, masks[i]).alias("seed"), "item_no", "q")


def masks_for(lengths: list[int], masks: tuple[tuple[int, ...], ...] = MASKS) -> tuple[tuple[int, ...], ...]:
    """The masks, the short ones if an item is shorter than the window, and the tiny ones if one is shorter than every mask."""
    shortest = min(m[-1] + 1 for m in masks)
    return masks + (SHORT_MASKS if any(shortest <= n < WINDOW for n in lengths) else ()) + (TINY_MASKS if any(n < shortest for n in lengths) else ())


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", max_block: int = MAX_BLOCK) -> DataFrame:
    """Contaminated documents: id, text_key (MD5 of the text), item_id, equal_words, window_words, first_word.

    One row per document text and item, with the best window.

    Defined results: null or empty texts and items with fewer than five words
    match nothing; an item of 5 to 7 words may differ in one, as 80 % allows;
    repeated documents of one id and text give one row; a null id is an id; empty
    tables give no rows; other columns, whatever their names, are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text)).alias("tokens"))
    items = materialize(items.where(F.size("tokens") >= MIN_ITEM_WORDS).distinct().withColumn("item_no", F.monotonically_increasing_id()), "seed-items")
    lengths = [r[0] for r in items.select(F.size("tokens").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]  # at most eight
    masks = masks_for(lengths)
    seeds = materialize(functools.reduce(DataFrame.unionByName, [_seeds(items, i, masks) for i in range(len(masks))]).distinct(), "seeds")
    blocks = max(1, math.ceil(seeds.count() / max_block))

    # The text's key, not the text, goes with every window and hit.
    text = F.col(text_col)
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"), token_hashes(text).alias("tokens"))
    found = []
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == block
        # About max_block seeds, and the items they come from, which have no more tokens than that.
        hits = _unrolled(tokens, masks, ("doc_id", "text_key")).join(F.broadcast(seeds.where(mine)), "seed")
        item = items.where(mine).select("item_no", "item_id", F.col("tokens").alias("item_tokens"))
        of_block = _best(_verified(hits.join(F.broadcast(item), "item_no")))
        # A block is a job of its own: in one plan the broadcasts of all blocks would be held at once.
        found.append(of_block if blocks == 1 else materialize(of_block, "seed-hits"))
    best = found[0] if blocks == 1 else _best(functools.reduce(DataFrame.unionByName, found))
    return best.select("doc_id", "text_key", "item_id", F.col("hit.equal").alias("equal_words"), F.col("hit.width").alias("window_words"),
                       (-F.col("hit.before")).alias("first_word"))


def _best(hits: DataFrame) -> DataFrame:
    """The best window of each document text and item."""
    return hits.groupBy("doc_id", "text_key", "item_id").agg(F.max("hit").alias("hit"))


def _verified(hits: DataFrame) -> DataFrame:
    """Lay document and item side by side around each hit and keep those with a window that agrees enough."""
    shift, m = F.col("at") - F.col("q"), F.size("item_tokens")
    low = F.greatest(F.lit(0), -shift, F.col("q") - (WINDOW - 1))
    high = F.least(m, F.size("tokens") - shift, F.col("q") + 2 * WINDOW)  # exclusive
    laid = hits.select("doc_id", "text_key", "item_id", shift.alias("shift"), low.alias("low"), high.alias("high"), F.least(F.lit(WINDOW), m).alias("width"),
                       F.transform(F.sequence(low, high - 1), lambda j: (F.get("tokens", j + shift) == F.get("item_tokens", j)).cast("int")).alias("same"))
    starts = F.when(F.col("high") - F.col("low") >= F.col("width"), F.sequence(F.lit(0), F.col("high") - F.col("low") - F.col("width")))
    sums = F.transform(starts, lambda s: F.struct(
        F.aggregate(F.slice("same", s + 1, F.col("width")), F.lit(0), lambda a, x: a + x).alias("equal"),
        F.col("width").alias("width"), (-(F.col("low") + F.col("shift") + s)).alias("before")))
    # Rows of one hit are few; the outer generator is filtered on what it makes.
    made = laid.select("doc_id", "text_key", "item_id", F.array_max(sums).alias("hit"))
    return made.where(F.col("hit.equal") >= F.ceil(F.col("hit.width") * SIMILARITY))


def remove_contaminated(docs: DataFrame, overlaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents (id and text) named in ``overlaps``; columns as they are."""
    gone = materialize(overlaps.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct(), "seed-gone")
    # What is removed grows with the documents: never broadcast.
    return docs.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("__gone_id")) & (F.md5(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__gone_key")), "left_anti")
