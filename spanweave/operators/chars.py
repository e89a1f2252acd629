"""Page text → cleaned lines → kept characters → blocks.

Plan shape: a page is one input row, and every page-wide quantity (footer
latch, title, running character indices) is computed inside that row with
array expressions before anything is exploded.  The whole path from text to
the character table is therefore narrow: no shuffle, no window, no join.
Lines are exploded first, characters last, and every row carries its own
coordinates (page_id, line_id, offset) and indices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PAGE, TextParams
from ..functions.arrays import prefix_sum
from ..functions.text import (
    WS_CLASS, clean_line, let, footer_trigger, is_whitespace_cp, kept_count, normalize_newlines,
    split_lines_expr, title_expr,
)


def page_frame(pages: DataFrame, p: TextParams) -> DataFrame:
    """One row per page: title, n_lines, and an array of per-line structs.

    line struct: line_id, line (cleaned), line_len, kept_n, char_base,
    kept_base, in_body.  ``kept_n`` counts kept characters (truncated to the
    block capacity in line mode); the bases are exclusive running sums.

    Per-element lambdas below only touch lambda variables: a projected column
    referenced inside a lambda can be inlined by the optimizer and would then
    be re-evaluated for every element.  Page-level values enter through
    ``arrays_zip`` or ``let`` (evaluated once per row).
    """
    norm = normalize_newlines(F.col("text"))
    raw = split_lines_expr(F.col("text"))
    clean = F.transform(raw, clean_line) if p.blank_patterns else raw
    base = pages.select(
        *PAGE,
        title_expr(norm, p.title_marker).alias("title"),
        clean.alias("_clean"),
    )
    # 1-based index of the first footer line, 0 when the page has none.
    trig = F.transform("_clean", lambda l: footer_trigger(l, p.footer_regex, p.footer_headings))
    base = base.select(
        *PAGE, "title", "_clean",
        F.array_position(trig, True).cast("int").alias("_cut"),
        F.transform("_clean", lambda l: F.length(l)).alias("_len"),
        F.transform("_clean", kept_count).alias("_kc"),
    )
    header_last = p.header_last

    def body_flags(cut: Column) -> Column:
        return F.transform(
            F.col("_len"),
            lambda _, i: (i > F.lit(header_last)) & ((cut == 0) | (i < cut - 1)),
        )

    base = base.select(
        *PAGE, "title", "_clean", "_cut", "_len",
        let(F.col("_cut"), body_flags).alias("_body"),
        F.col("_kc"),
    )
    cap = F.lit(p.capacity)
    base = base.select(
        *PAGE, "title", "_clean", "_cut", "_len", "_body",
        F.zip_with(
            "_kc", "_body",
            lambda n, b: F.when(b, F.least(n, cap) if p.mode == "line" else n).otherwise(F.lit(0)),
        ).alias("_kept"),
    )
    base = base.select(
        *PAGE, "title", "_clean", "_cut", "_len", "_body", "_kept",
        prefix_sum(F.col("_len")).alias("_len_end"),
        prefix_sum(F.col("_kept")).alias("_kept_end"),
    )
    zipped = F.arrays_zip("_clean", "_len", "_kept", "_len_end", "_kept_end", "_body")
    lines = F.transform(
        zipped,
        lambda s, i: F.struct(
            i.cast("int").alias("line_id"),
            s["_clean"].alias("line"),
            s["_len"].cast("int").alias("line_len"),
            s["_kept"].cast("int").alias("kept_n"),
            (s["_len_end"] - s["_len"]).alias("char_base"),
            (s["_kept_end"] - s["_kept"]).alias("kept_base"),
            s["_body"].alias("in_body"),
        ),
    )
    return base.select(
        *PAGE, "title",
        F.size("_clean").cast("int").alias("n_lines"),
        F.coalesce(F.try_element_at("_kept_end", F.lit(-1)), F.lit(0).cast("bigint")).alias("n_kept"),
        (F.col("_cut") - 1).alias("footer_line"),
        lines.alias("lines"),
    )


def page_info(pages: DataFrame, p: TextParams) -> DataFrame:
    """page_id, category, title, n_lines — no cleaning needed, one row per page."""
    return pages.select(
        *PAGE,
        title_expr(normalize_newlines(F.col("text")), p.title_marker).alias("title"),
        F.size(split_lines_expr(F.col("text"))).cast("int").alias("n_lines"),
    )


def clean_lines(pages: DataFrame, p: TextParams) -> DataFrame:
    """One row per cleaned line with its page-wide indices and filters.

    The ``_outer`` generators matter: for a plain generator the optimizer
    infers ``size(array) > 0`` and pushes it below the projections, which
    copies the whole cleaning expression into a filter and runs it twice.
    """
    return frame_lines(page_frame(pages, p))


def frame_lines(frame: DataFrame) -> DataFrame:
    return frame.select(*PAGE, F.inline_outer("lines")).where(F.col("line_id").isNotNull())


def explode_chars(lines: DataFrame) -> DataFrame:
    """Every raw character of every cleaned line, kept or not.

    char_idx: page-wide running index over all raw characters (incl. newline).
    """
    return lines.select(
        *PAGE, "line_id", "char_base",
        F.posexplode_outer(F.split("line", "")).alias("offset", "ch"),
    ).where(F.col("offset").isNotNull()).select(
        *PAGE, "line_id",
        F.col("offset").cast("int").alias("offset"),
        (F.col("char_base") + F.col("offset")).alias("char_idx"),
        "ch",
    )


def _ranked_words(line: Column) -> Column:
    """Words of a line as (word, gaps, rank): whitespace characters and kept characters before it."""
    def ranked(words: Column) -> Column:
        return let(prefix_sum(F.transform(words, lambda w: F.length(w))), lambda ends: F.transform(words, lambda w, i: F.struct(
            w.alias("word"), i.cast("int").alias("gaps"), (F.get(ends, i) - F.length(w)).cast("int").alias("rank"))))

    return let(F.split(line, WS_CLASS, -1), ranked)


def _word_chars(body: DataFrame, p: TextParams) -> DataFrame:
    """Kept characters without context: lines → words → characters.

    The lambdas run per word; a character is a plain generated row, whose rank and
    offset follow from those of its word (every whitespace character is one gap).
    """
    words = body.select(*PAGE, "line_id", "char_base", "kept_base", F.explode_outer(_ranked_words(F.col("line"))).alias("_w"))
    words = words.where(F.col("_w.word") != "").select(
        *PAGE, "line_id", "char_base", "kept_base", *[F.col(f"_w.{c}").alias(f"_{c}") for c in ("word", "gaps", "rank")])
    every = words.select(*PAGE, "line_id", "char_base", "kept_base", "_gaps", "_rank", F.posexplode_outer(F.split("_word", "")).alias("_i", "ch"))
    out = every.where(F.col("_i").isNotNull()).select(
        *PAGE, "line_id", "char_base", "kept_base", "ch",
        (F.col("_rank") + F.col("_i")).alias("_k"), (F.col("_rank") + F.col("_gaps") + F.col("_i")).alias("offset"))
    return out.where(F.col("_k") < p.capacity) if p.mode == "line" else out


def kept_lines(lines: DataFrame) -> DataFrame:
    """The lines that hold kept characters."""
    return lines.where(F.col("in_body") & (F.col("kept_n") > 0))


def kept_chars(lines: DataFrame, p: TextParams, context: int = 0) -> DataFrame:
    """Kept characters with new_char_idx, block_id and block_idx.

    Per line: the words are ranked by the kept characters before them, then spelled
    out (``_word_chars``), so new_char_idx = kept_base + rank (no window).
    Line mode keeps only the first ``capacity`` characters (dropped characters get
    no index — the running sums already count the truncated numbers).
    ``context`` > 0 adds the raw neighbours ctx_m1.., ctx_p1.. ('' past the line):
    the line is split once into code points, and the (offset, char) structs of
    non-whitespace characters are kept.  Everything such a row needs is inside its
    struct before the explode, so exploded rows never carry the line's array (that
    would copy it once per char).
    """
    cap = p.capacity
    body = kept_lines(lines)
    exploded = _context_chars(body, p, context) if context else _word_chars(body, p)
    ctx_cols = [f"ctx_{n}{j}" for j in range(1, context + 1) for n in ("m", "p")]
    out = exploded.select(
        *PAGE, "line_id", "offset",
        (F.col("char_base") + F.col("offset")).alias("char_idx"),
        "ch",
        (F.col("kept_base") + F.col("_k")).alias("new_char_idx"),
        "_k", *ctx_cols,
    )
    if p.mode == "line":
        out = out.withColumn("block_id", F.col("line_id").cast("bigint")) \
            .withColumn("block_idx", F.col("_k"))
    else:
        out = out.withColumn("block_id", F.expr(f"new_char_idx div {cap}").cast("bigint")) \
            .withColumn("block_idx", F.pmod(F.col("new_char_idx"), F.lit(cap)).cast("int"))
    return out.drop("_k")


def _context_chars(body: DataFrame, p: TextParams, context: int) -> DataFrame:
    """Kept characters with their raw neighbours."""
    def items(arr: Column) -> Column:
        def one(c: Column, o: Column) -> Column:
            fields = [o.alias("offset"), c.alias("ch"), F.ascii(c).alias("cp")]
            for j in range(1, context + 1):
                fields.append(F.coalesce(F.get(arr, o - j), F.lit("")).alias(f"ctx_m{j}"))
                fields.append(F.coalesce(F.get(arr, o + j), F.lit("")).alias(f"ctx_p{j}"))
            return F.struct(*fields)

        return F.filter(F.transform(arr, one), lambda s: ~is_whitespace_cp(s["cp"]))

    kept = let(F.split("line", ""), items)
    if p.mode == "line":
        kept = F.slice(kept, 1, p.capacity)
    exploded = body.select(
        *PAGE, "line_id", "char_base", "kept_base",
        F.posexplode_outer(kept).alias("_k", "_c"),
    ).where(F.col("_k").isNotNull())
    ctx_cols = [F.col(f"_c.ctx_{n}{j}").alias(f"ctx_{n}{j}") for j in range(1, context + 1) for n in ("m", "p")]
    return exploded.select(
        *PAGE, "line_id", "char_base", "kept_base", F.col("_c.ch").alias("ch"), F.col("_k").cast("int").alias("_k"),
        F.col("_c.offset").cast("int").alias("offset"), *ctx_cols,
    )


def page_chars(pages: DataFrame, p: TextParams) -> DataFrame:
    """pages → kept character table (the usual entry point)."""
    return kept_chars(clean_lines(pages, p), p)


def block_stats_narrow(frame: DataFrame, p: TextParams) -> DataFrame:
    """Block statistics straight from the page / line grain (no character rows).

    Char mode: blocks are fixed slices of the page's kept characters, so the
    page's kept count alone gives every block.  Line mode: one block per body
    line with kept characters.
    """
    cap = p.capacity
    if p.mode == "line":
        ln = frame.select(*PAGE, F.inline_outer("lines")).where(
            F.col("in_body") & (F.col("kept_n") > 0))
        return ln.select(
            *PAGE, F.col("line_id").cast("bigint").alias("block_id"),
            F.col("kept_n").cast("bigint").alias("n_chars"),
            F.col("kept_base").alias("first_idx"),
            (F.col("kept_base") + F.col("kept_n") - 1).alias("last_idx"),
        )
    nb = F.expr(f"(n_kept + {cap - 1}) div {cap}")
    # Filters only on the generated column: a filter on n_kept would be pushed
    # below the generator and copy the whole cleaning expression into it.
    b = frame.select(*PAGE, "n_kept", nb.alias("_nb")).select(
        *PAGE, "n_kept",
        F.explode_outer(F.when(F.col("_nb") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)))
        .alias("block_id"),
    ).where(F.col("block_id").isNotNull())
    return b.select(
        *PAGE, "block_id",
        F.least(F.lit(cap).cast("bigint"), F.col("n_kept") - F.col("block_id") * cap).alias("n_chars"),
        (F.col("block_id") * cap).alias("first_idx"),
        (F.least(F.col("n_kept"), (F.col("block_id") + 1) * cap) - 1).alias("last_idx"),
    )
