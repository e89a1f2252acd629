"""Independent DuckDB statements of the same rules (the correctness oracle).

These are written the "obvious" way — windows and row_number over exploded
characters, a dense tag matrix, per-cell expansion of every span — so they
check the narrow, sparse Spark plans rather than mirror them.  Only the
fixed values (patterns, class, fixture rules) are shared.
"""

from __future__ import annotations

from ..config import TextParams, fixture_params
from ..functions.text import (
    CREDIT_PHRASE, FILE_PATTERN, HOST_PATTERN, NAV_PHRASE, URL_PATTERN, WS_CLASS,
)
from ..sources import fixtures as fx


def q(s: str) -> str:
    """SQL string literal; newlines become chr(10)."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits)


def raw_lines_cte() -> str:
    return r"""raw_lines AS (
  SELECT page_id, category, CAST(unnest(range(len(l))) AS INTEGER) AS line_id, unnest(l) AS line
  FROM (SELECT doc_id AS page_id, source AS category,
               regexp_extract_all(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'),
                                  '[^\n]*\n|[^\n]+') AS l
        FROM documents)
)"""


def blank_sql(col: str, pattern: str) -> str:
    p = q(pattern)
    return f"regexp_replace({col}, {p}, repeat(' ', length(regexp_extract({col}, {p}))), 'g')"


def clean_ctes(steps=("caret", "url", "host", "file", "phrases"), src="raw_lines") -> str:
    """c0..: one CTE per blanking step; the last is ``clean``."""
    ctes = [f"c_0 AS (SELECT page_id, category, line_id, line AS l FROM {src})"]
    i = 0
    for s in steps:
        prev = f"c_{i}"
        i += 1
        if s == "caret":
            e = "CASE WHEN starts_with(l, '^') THEN repeat(' ', length(l)) ELSE l END"
        elif s == "url":
            e = blank_sql("l", URL_PATTERN)
        elif s == "host":
            e = blank_sql("l", HOST_PATTERN)
        elif s == "file":
            e = blank_sql("l", FILE_PATTERN)
        elif s == "phrases":
            e = (f"replace(replace(l, {q(NAV_PHRASE)}, {q(' ' * len(NAV_PHRASE))}), "
                 f"{q(CREDIT_PHRASE)}, {q(' ' * len(CREDIT_PHRASE))})")
        else:
            raise ValueError(s)
        ctes.append(f"c_{i} AS (SELECT page_id, category, line_id, {e} AS l FROM {prev})")
    ctes.append(f"clean AS (SELECT page_id, category, line_id, l AS line FROM c_{i})")
    return ",\n".join(ctes)


def trigger_sql(p: TextParams, col: str = "line") -> str:
    parts = []
    if p.footer_regex:
        parts.append(f"regexp_matches({col}, {q(p.footer_regex)})")
    if p.footer_headings:
        parts.append(f"{col} IN ({', '.join(q(h) for h in p.footer_headings)})")
    return " OR ".join(parts) if parts else "false"


def body_ctes(p: TextParams) -> str:
    """clean → body (in_body flag) → rawchars (every raw char) → kept."""
    ws = q("^" + WS_CLASS + "$")
    cap = p.capacity
    if p.mode == "line":
        kept_filter = f"""kept_l AS (
  SELECT * FROM kept_0
  QUALIFY row_number() OVER (PARTITION BY page_id, line_id ORDER BY "offset") <= {cap}
)"""
        block = f"""CAST(line_id AS BIGINT) AS block_id,
         CAST(row_number() OVER (PARTITION BY page_id, line_id ORDER BY "offset") - 1 AS INTEGER) AS block_idx"""
    else:
        kept_filter = "kept_l AS (SELECT * FROM kept_0)"
        block = f"""CAST((row_number() OVER (PARTITION BY page_id ORDER BY line_id, "offset") - 1) // {cap} AS BIGINT) AS block_id,
         CAST((row_number() OVER (PARTITION BY page_id ORDER BY line_id, "offset") - 1) % {cap} AS INTEGER) AS block_idx"""
    return f"""trig AS (
  SELECT page_id, min(line_id) FILTER (WHERE {trigger_sql(p)}) AS cut FROM clean GROUP BY page_id
),
body AS (
  SELECT c.page_id, c.category, c.line_id, c.line,
         (c.line_id > {p.header_last} AND (t.cut IS NULL OR c.line_id < t.cut)) AS in_body,
         coalesce(sum(length(c.line)) OVER (PARTITION BY c.page_id ORDER BY c.line_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_base
  FROM clean c JOIN trig t USING (page_id)
),
rawchars_0 AS (
  SELECT page_id, line_id, in_body, char_base, line, unnest(range(length(line))) AS o FROM body
),
rawchars AS (
  SELECT page_id, line_id, CAST(o AS INTEGER) AS "offset", CAST(char_base + o AS BIGINT) AS char_idx,
         substring(line, CAST(o AS INTEGER) + 1, 1) AS ch, in_body
  FROM rawchars_0
),
kept_0 AS (
  SELECT * FROM rawchars WHERE in_body AND NOT regexp_matches(ch, {ws})
),
{kept_filter},
kept AS (
  SELECT page_id, line_id, "offset", char_idx, ch,
         CAST(row_number() OVER (PARTITION BY page_id ORDER BY line_id, "offset") - 1 AS BIGINT) AS new_char_idx,
         {block}
  FROM kept_l
)"""


def prefixed_lines_cte() -> str:
    """raw_lines with the fixture prefixes."""
    whens = " ".join(f"WHEN {k} THEN {q(text)}" for k, text in fx.FIXTURE_PREFIXES.items())
    return f"""prefixed AS (
  SELECT page_id, category, line_id, CASE (page_id + line_id) % {fx.PREFIX_MOD} {whens} ELSE '' END || line AS line FROM raw_lines
)"""


def anno_cte(pred: bool = False) -> str:
    """Fixture gold spans (or the perturbed predictions) from raw lines."""
    parts = []
    for k, (name, pattern) in enumerate(fx.ATTRIBUTE_PATTERNS):
        p = q(pattern)
        parts.append(f"""SELECT category, page_id, {q(name)} AS attribute, line_id AS sl, so, line_id AS el,
         CAST(so + length(m) AS INTEGER) AS eo, m AS text,
         (CAST(line_id AS BIGINT) * 4 + {k}) * {fx.MATCH_STEP} + i AS anno_seq
  FROM (SELECT category, page_id, line_id, i, ms[i + 1] AS m,
               CAST(list_sum(list_transform(between[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) AS INTEGER) AS so
        FROM (SELECT category, page_id, line_id, ms, between, unnest(range(len(ms))) AS i
              FROM (SELECT category, page_id, line_id, regexp_extract_all(line, {p}) AS ms, regexp_split_to_array(line, {p}) AS between
                    FROM raw_lines)))""")
    x = fx.EXTRA_SEQ
    parts += [
        f"SELECT source, doc_id, 'cap', 1, 2, 2, 6, NULL, {x} FROM documents WHERE doc_id % {fx.MULTI_LINE_MOD} = 0",
        f"SELECT source, doc_id, 'accent-word', 1, 0, 1, 8, NULL, {x + 1} FROM documents WHERE doc_id % {fx.OVERLAP_MOD} = 0",
        f"SELECT source, doc_id, 'number', 1, 5, 1, 5, NULL, {x + 2} FROM documents WHERE doc_id % {fx.EMPTY_MOD} = 0",
        f"SELECT source, doc_id, 'number', 1, 8, 2, 3, NULL, {x + 3} FROM documents WHERE doc_id % {fx.EMPTY_MOD} = 0",
        f"SELECT source, doc_id + {fx.MISSING_PAGE_SHIFT}, 'cap', 0, 0, 0, 3, NULL, 0 FROM documents "
        f"WHERE doc_id % {fx.MISSING_PAGE_MOD} = 0",
    ]
    body = "\n  UNION ALL\n  ".join(parts)
    gold = f"""gold_anno AS (
  {body}
)"""
    if not pred:
        return gold + ",\nanno AS (SELECT * FROM gold_anno)"
    return gold + f""",
anno AS (
  SELECT category, page_id, attribute, sl, so, el,
         CASE WHEN (page_id + sl) % {fx.PRED_SHORTEN_MOD} = 0 THEN eo - 1 ELSE eo END AS eo, text, anno_seq
  FROM gold_anno WHERE (page_id + sl) % {fx.PRED_DROP_MOD} <> 0
)"""


def splits_cte(src: str = "anno") -> str:
    return f"""splits AS (
  SELECT category, page_id, CASE WHEN r <= {fx.N_TRAIN} THEN 'train' WHEN r <= {fx.N_TRAIN + fx.N_VALID} THEN 'valid' ELSE 'test' END AS tvt
  FROM (SELECT category, page_id, row_number() OVER (PARTITION BY category ORDER BY md5('0:' || CAST(page_id AS VARCHAR)), page_id) AS r
        FROM (SELECT DISTINCT category, page_id FROM {src}))
)"""


def cells_ctes(prefix: str = "") -> str:
    """Expand every span of ``{prefix}anno`` cell by cell and resolve overlaps."""
    a = f"{prefix}anno"
    return f"""{prefix}cells_0 AS (
  SELECT page_id, attribute, anno_seq, sl, so, eo, unnest(range(sl, el + 1)) AS line_id
  FROM {a} WHERE so < eo AND sl <= el
),
{prefix}cells_1 AS (
  SELECT page_id, attribute, anno_seq, sl, so, line_id, unnest(range(so, eo)) AS o FROM {prefix}cells_0
),
{prefix}cells AS (
  SELECT c.page_id, CAST(c.line_id AS INTEGER) AS line_id, CAST(c.o AS INTEGER) AS "offset", c.attribute,
         c.anno_seq, CASE WHEN c.line_id = c.sl AND c.o = c.so THEN 'B' ELSE 'I' END AS bio,
         r.ch, k.new_char_idx
  FROM {prefix}cells_1 c
  JOIN rawchars r ON r.page_id = c.page_id AND r.line_id = c.line_id AND r."offset" = c.o
  LEFT JOIN kept k ON k.page_id = c.page_id AND k.line_id = c.line_id AND k."offset" = c.o
),
{prefix}labels AS (
  SELECT l.*, coalesce(r.ch, '') AS prev_ch FROM (
    SELECT page_id, attribute, arg_max(new_char_idx, anno_seq) AS new_char_idx, arg_max(bio, anno_seq) AS bio,
           line_id, "offset", arg_max(ch, anno_seq) AS ch
    FROM {prefix}cells WHERE new_char_idx IS NOT NULL
    GROUP BY page_id, line_id, "offset", attribute) l
  LEFT JOIN rawchars r ON r.page_id = l.page_id AND r.line_id = l.line_id AND r."offset" = l."offset" - 1
)"""


ATTRS = """attrs AS (SELECT DISTINCT a.category, a.attribute FROM gold_anno a),
"""


def dense_spans_ctes(prefix: str = "") -> str:
    """Dense tag matrix (kept chars × attributes), lag, running start count."""
    return ATTRS + f"""{prefix}dense AS (
  SELECT k.page_id, a.attribute, k.new_char_idx, k.line_id, k."offset", k.ch, coalesce(t.bio, 'O') AS bio
  FROM kept k JOIN documents d ON d.doc_id = k.page_id JOIN attrs a ON a.category = d.source
  LEFT JOIN {prefix}labels t ON t.page_id = k.page_id AND t.attribute = a.attribute
                           AND t.new_char_idx = k.new_char_idx
),
{prefix}trans AS (
  SELECT *, lag(bio, 1, 'O') OVER (PARTITION BY page_id, attribute ORDER BY new_char_idx) AS prev_bio
  FROM {prefix}dense
),
{prefix}numbered AS (
  SELECT *, sum(CASE WHEN bio = 'B' OR (bio = 'I' AND prev_bio = 'O') THEN 1 ELSE 0 END)
              OVER (PARTITION BY page_id, attribute ORDER BY new_char_idx ROWS UNBOUNDED PRECEDING) AS span_no
  FROM {prefix}trans
),
{prefix}spans AS (
  SELECT page_id, attribute, min(new_char_idx) AS start_idx, max(new_char_idx) AS end_idx,
         arg_min(line_id, new_char_idx) AS start_line, arg_min("offset", new_char_idx) AS start_offset,
         arg_max(line_id, new_char_idx) AS end_line, arg_max("offset", new_char_idx) + 1 AS end_offset,
         string_agg(ch, '' ORDER BY new_char_idx) AS text
  FROM {prefix}numbered WHERE bio <> 'O'
  GROUP BY page_id, attribute, span_no
)"""


def title_cte(p: TextParams) -> str:
    m = q(p.title_marker)
    return f"""titles AS (
  SELECT d.doc_id AS page_id, t.title
  FROM documents d LEFT JOIN (
    SELECT page_id, arg_min(substring(line, 1, instr(line, {m}) - 1), line_id) AS title
    FROM raw_lines WHERE instr(line, {m}) > 0 GROUP BY page_id) t ON t.page_id = d.doc_id
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def base(p: TextParams | None = None) -> str:
    """raw_lines, clean steps, body/rawchars/kept."""
    p = p or fixture_params()
    return ",\n".join([raw_lines_cte(), clean_ctes(), body_ctes(p)])
