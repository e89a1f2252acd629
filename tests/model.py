"""
model in the tests.  Small and slow on purpose: one page at a time."""

from __future__ import annotations

import io
import re

from spanweave.functions.text import (
    CREDIT_PHRASE, FILE_PATTERN, HOST_PATTERN, NAV_PHRASE, URL_PATTERN,
)


def read_lines(text: str) -> list[str]:
    """What a text-mode read gives: universal newlines, lines keep '\\n'."""
    return io.StringIO(text, newline=None).readlines()


def blank(line: str, pattern: str) -> str:
    first = re.search(pattern, line)
    if first is None:
        return line
    return re.sub(pattern, " " * len(first.group()), line)


def clean(line: str) -> str:
    if line.startswith("^"):
        line = " " * len(line)
    for pat in (URL_PATTERN, HOST_PATTERN, FILE_PATTERN, re.escape(NAV_PHRASE), re.escape(CREDIT_PHRASE)):
        line = blank(line, pat)
    return line


def is_kept(ch: str) -> bool:
    return re.match(r"\S", ch) is not None


def triggers(line: str, p) -> bool:
    hit = bool(p.footer_regex) and re.search(p.footer_regex, line) is not None
    return hit or line in p.footer_headings


def page_chars(text: str, p) -> list[dict]:
    """Kept characters of one page with their indices and block positions."""
    lines = [clean(x) for x in read_lines(text)]
    cut = next((i for i, x in enumerate(lines) if triggers(x, p)), None)
    out, k, base = [], 0, 0
    cap = p.capacity
    for i, line in enumerate(lines):
        body = i > p.header_last and (cut is None or i < cut)
        in_line = 0
        for o, ch in enumerate(line):
            if not (body and is_kept(ch)):
                continue
            if p.mode == "line" and in_line >= cap:
                continue
            blk, bidx = (i, in_line) if p.mode == "line" else (k // cap, k % cap)
            out.append(dict(line_id=i, offset=o, char_idx=base + o, ch=ch, new_char_idx=k,
                            block_id=blk, block_idx=bidx))
            k += 1
            in_line += 1
        base += len(line)
    return out


def cells(annotations: list[dict]) -> dict:
    """(line, offset, attribute) → tag; later annotations overwrite earlier ones."""
    tags = {}
    for a in annotations:
        sl, so, el, eo = a["sl"], a["so"], a["el"], a["eo"]
        for li in range(sl, el + 1):
            for o in range(so, eo):
                first = li == sl and o == so
                tags[(li, o, a["attribute"])] = "B" if first else "I"
    return tags


def decode(seq: list[str]) -> list[tuple[int, int]]:
    """Dense tag sequence → (first, last) positions of every span."""
    spans, cur = [], None
    for i, t in enumerate(seq):
        if t == "B" or (t == "I" and cur is None):
            if cur is not None:
                spans.append(tuple(cur))
            cur = [i, i]
        elif t == "I":
            cur[1] = i
        elif cur is not None:
            spans.append(tuple(cur))
            cur = None
    if cur is not None:
        spans.append(tuple(cur))
    return spans


def page_spans(text: str, annotations: list[dict], attributes: list[str], p) -> set:
    """Gold spans decoded from the labels on kept characters (with coordinates and text)."""
    chars = page_chars(text, p)
    tags = cells(annotations)
    out = set()
    for attr in attributes:
        seq = [tags.get((c["line_id"], c["offset"], attr), "O") for c in chars]
        for s, e in decode(seq):
            cs, ce = chars[s], chars[e]
            text_ = "".join(c["ch"] for c in chars[s:e + 1])
            out.add((attr, s, e, cs["line_id"], cs["offset"], ce["line_id"], ce["offset"] + 1, text_))
    return out
