"""Column expressions for line cleaning and character classes.

Everything here is a plain ``pyspark.sql.functions`` expression and can be used
both on a line column and inside ``transform`` lambdas over an array of lines.
On a column it is part of the generated code; inside higher-order functions
Spark 4.1 evaluates it interpreted (``transform``, ``filter``, ``aggregate`` and
``zip_with`` are fallbacks of the code generator), still without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the original task's -----------------------
# Blanking patterns, applied in this order to every line; all matches of a
# pattern are replaced by blanks as long as the pattern's FIRST match.
URL_PATTERN = r"「?(https?|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]+[-A-Za-z0-9+&@#/%=~_|][-A-Za-z0-9+&@#/%=~_|]+[-A-Za-z0-9+&@#/%=~_|]*?"
HOST_PATTERN = r"((http|ftp|https)://)*(([a-zA-Z0-9\._-]+\.[a-zA-Z]{2,6})|([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}))(:[0-9]{1,4})*(/[a-zA-Z0-9\&%_\./-~-]*)?"
FILE_PATTERN = r"ファイル:(.+?\..{3})"
NAV_PHRASE = "移動先:\t\t\t\t\t案内、\t\t\t\t\t検索"
CREDIT_PHRASE = "出典: フリー百科事典『ウィキペディア（Wikipedia）』"
# Line starting with this character is a footnote and is blanked whole.
FOOTNOTE_PREFIX = "^"
# Python's str whitespace (what ``\s`` matches on str patterns), as code points.
WHITESPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
)
# The same set as a regex class (Java and RE2 both accept it).
WS_CLASS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\p{Z}]"
# ------------------------------------------------------------------------------

# Java's "." stops at \r, U+0085, U+2028, U+2029 unless UNIX_LINES is on;
# Python's (and RE2's) stops only at \n.
JAVA_DOT = "(?d)"
LINE_SPLIT = r"[^\n]*\n|[^\n]+"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body`` (no re-evaluation).

    Higher-order-function lambdas get no common-subexpression elimination, so a
    value used twice would be computed twice; binding it to a lambda variable
    keeps the expression linear in size.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# A literal every match of the pattern contains: lines without it skip the regex.
REQUIRED_LITERAL = {URL_PATTERN: "://", HOST_PATTERN: ".", FILE_PATTERN: "ファイル:"}
# A cheap pattern that every match holds, for lines with the literal: a host has a
# dot before two letters or before a digit, which the full stops of prose are not.
REQUIRED_PATTERN = {HOST_PATTERN: r"\.(?:[a-zA-Z]{2}|[0-9])"}


def blank_regex(line: Column, pattern: str) -> Column:
    """Replace every match by blanks of the first match's length.

    The replace only runs when the search found a match, and patterns with a
    required literal or pattern are skipped on lines without it (exact: such
    lines cannot match).
    """
    java = JAVA_DOT + pattern
    need = REQUIRED_LITERAL.get(pattern)

    def body(x: Column) -> Column:
        def search(y: Column) -> Column:
            first = F.regexp_extract(y, java, 0)
            return let(first, lambda m: F.when(m == "", y).otherwise(
                F.regexp_replace(y, F.lit(java), F.repeat(F.lit(" "), F.length(m)))))
        if need is None:
            return search(x)
        none = F.instr(x, need) == 0
        if pattern in REQUIRED_PATTERN:
            none = none | ~x.rlike(REQUIRED_PATTERN[pattern])
        return F.when(none, x).otherwise(search(x))

    return let(line, body)


def blank_literal(line: Column, phrase: str) -> Column:
    """Literal phrases have a fixed match length: plain replace, no regex."""
    return F.replace(line, F.lit(phrase), F.lit(" " * len(phrase)))


def blank_caret(line: Column) -> Column:
    return let(
        line,
        lambda x: F.when(x.startswith(FOOTNOTE_PREFIX), F.repeat(F.lit(" "), F.length(x))).otherwise(x),
    )


def clean_line(line: Column) -> Column:
    """The six blanking steps, each on the previous result."""
    x = blank_caret(line)
    x = blank_regex(x, URL_PATTERN)
    x = blank_regex(x, HOST_PATTERN)
    x = blank_regex(x, FILE_PATTERN)
    x = blank_literal(x, NAV_PHRASE)
    x = blank_literal(x, CREDIT_PHRASE)
    return x


def footer_trigger(clean: Column, footer_regex: str, headings) -> Column:
    """A cleaned line that starts the footer (it and all later lines go)."""
    hit = F.lit(False)
    if footer_regex:
        hit = clean.rlike(JAVA_DOT + footer_regex)
    if headings:
        hit = hit | clean.isin(list(headings))
    return hit


def is_whitespace_cp(cp: Column) -> Column:
    cond = F.lit(False)
    for lo, hi in WHITESPACE_RANGES:
        cond = cond | ((cp == lo) if lo == hi else cp.between(lo, hi))
    return cond


def kept_count(line: Column) -> Column:
    """Number of non-whitespace code points in a line."""
    return F.length(F.regexp_replace(line, F.lit(WS_CLASS), F.lit("")))


def kept_cps(line: Column) -> Column:
    """Code points of the non-whitespace characters of a line that holds some."""
    return F.transform(F.split(F.regexp_replace(line, F.lit(WS_CLASS), F.lit("")), ""), lambda c: F.ascii(c))


def normalize_newlines(text: Column) -> Column:
    """Universal newlines: \\r\\n and lone \\r become \\n (text-mode reads)."""
    return F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))


def split_lines_expr(text: Column) -> Column:
    """Lines keep their \\n; no empty trailing line; only \\n splits."""
    return F.coalesce(
        F.regexp_extract_all(normalize_newlines(text), F.lit(LINE_SPLIT), F.lit(0)),
        F.array().cast("array<string>"),
    )


def title_expr(norm_text: Column, marker: str) -> Column:
    """Prefix of the first line that contains ``marker`` (null if none).

    The first occurrence of a newline-free marker in the text lies on the first
    line containing it, so no line split is needed.
    """
    if "\n" in marker:
        raise ValueError("title marker must not contain a newline")
    pos = F.instr(norm_text, marker)
    return F.when(
        pos > 0,
        F.substring_index(F.substring(norm_text, F.lit(1), pos - 1), "\n", -1),
    )
