"""Token counts by a compiled finite-state tokenizer.

A byte-pair tokenizer file is compiled into two deterministic machines:

*  The splitter reads character classes (one character of lookahead for
   contractions is folded into the class) and marks where words start.
*  The counter reads a word's bytes, the last one as a symbol of its own, and its
   transitions carry emitted-token counts.  Of every prefix, the last token is
   determined: it is the only token that ends there and may follow the last token
   of the prefix before it.  A state therefore holds, for each position from which
   a longer token may still come, the place in the token trie, the last token
   there and the count relative to the current one; a transition's count is the
   change, possibly negative.  The last symbol of a word leads back to the start.
   States are made when they are first reached and kept by the worker; beyond a
   bound of states the table is begun anew.

Texts are cut into chunks of equal length that run in step.  Each chunk of the
splitter is a map from any entry state to its exit state; the maps compose in a
parallel prefix scan, which gives every chunk its entry.  A counter chunk's map is
constant from its first word end on; its exit is the entry of the next chunk's
first, unfinished word, and what lies before that word end is run with it.

Defined results: a null text counts as empty, with no tokens; special token
strings in a text are one token each; repeated rows count each; empty tables give
no rows; long texts are cut at white space, which no token crosses; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 19
CHUNK = 256
MOST_STATES = 1 << 17
SCALAR_CHUNKS = 16  # so few chunks inside long words run one by one
_OFFSET, _SHIFT = 128, 256  # a cell is next state × _SHIFT + count + _OFFSET

# Character classes of the splitter; a contraction's apostrophe by the letters that follow.
SPACE, LETTER, NUMBER, OTHER, CONTRACTS_1, CONTRACTS_2 = range(6)
# Its states: between words, in letters, in other characters, one or two characters of a contraction left.
_BETWEEN, _IN_LETTERS, _IN_OTHERS, _LEFT_1, _LEFT_2 = range(5)
SPLIT_REGEX = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the pattern that the splitter states


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word starts) by state and class."""
    step, starts = np.zeros((5, 6), np.int8), np.zeros((5, 6), bool)
    for state in (_BETWEEN, _IN_LETTERS, _IN_OTHERS):
        step[state] = [_BETWEEN, _IN_LETTERS, _BETWEEN, _IN_OTHERS, _LEFT_1, _LEFT_2]
        starts[state] = [False, state != _IN_LETTERS, True, state != _IN_OTHERS, True, True]
    step[_IN_OTHERS, CONTRACTS_1:], starts[_IN_OTHERS, CONTRACTS_1:] = _IN_OTHERS, False
    step[_LEFT_1], step[_LEFT_2] = _BETWEEN, _LEFT_1
    return step, starts


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan of state maps (rows): row i becomes the composition of rows 0 to i."""
    maps, far = maps.copy(), 1
    while far < len(maps):
        maps[far:] = np.take_along_axis(maps[far:], maps[:-far], axis=1)  # first the earlier rows, then the later
        far *= 2
    return maps


class Splitter:
    """Character classes and lower case as the tokenizer's own normalizer and splitter have them, learnt per distinct character."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.kind = np.full(0x110000, -1, np.int8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.longer: dict[int, str] = {}
        self.step, self.starts = _splitter()

    def _learn(self, points: np.ndarray) -> None:
        cut = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        for p in points.tolist():
            c = chr(p)
            low = self.tokenizer.normalizer.normalize_str(c)
            low = c if low == " " else low  # white space is left as it is; it is in no word
            if len(low) == 1:
                self.lower[p] = ord(low)
            else:
                self.longer[p] = low
            for x in {c, *low}:
                alone, letter, other = cut(x), cut("a" + x), cut("!" + x)
                self.kind[ord(x)] = SPACE if not alone else LETTER if letter == 1 else OTHER if other == 1 else NUMBER

    def lowered(self, text: str) -> np.ndarray:
        """Code points of the normalized text."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        new = points[self.kind[points] < 0]
        if len(new):
            self._learn(np.unique(new))
        if self.longer and np.isin(points, list(self.longer)).any():
            points = np.frombuffer("".join(self.longer.get(ord(c), c) for c in text).encode("utf-32-le"), np.uint32)
        return self.lower[points]

    def words(self, points: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character; white space is in no word."""
        kind = self.kind[points]
        at = np.flatnonzero(points == ord("'"))
        if len(at):
            after = np.concatenate([points, np.zeros(2, np.uint32)])
            one, two = after[at + 1], after[at + 2]
            kind[at[np.isin(one, [ord(c) for c in "stmd"])]] = CONTRACTS_1
            kind[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = CONTRACTS_2
        chunks = -(-len(kind) // CHUNK)
        grid = np.zeros(chunks * CHUNK, np.int8)
        grid[:len(kind)] = kind
        grid = grid.reshape(chunks, CHUNK)
        maps = np.tile(np.arange(5, dtype=np.int8), (chunks, 1))
        for j in range(CHUNK):
            maps = self.step[maps, grid[:, j, None]]
        state = np.concatenate([[_BETWEEN], scan_maps(maps)[:-1, _BETWEEN]])
        out = np.zeros(grid.shape, bool)
        for j in range(CHUNK):
            out[:, j] = self.starts[state, grid[:, j]]
            state = self.step[state, grid[:, j]]
        return out.reshape(-1)[:len(kind)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The counting transducer of a byte-level BPE vocabulary with word-end symbols (byte + 256)."""

    def __init__(self, model: dict):
        letters, end = byte_letters(), model["end_of_word_suffix"]
        ids = model["vocab"]

        def symbols(token: str) -> tuple[int, ...]:
            ends = token.endswith(end) and token != end
            own = [letters[c] for c in (token[:-len(end)] if ends else token)]
            return (*own[:-1], own[-1] + 256 * ends)

        self.symbols = {i: symbols(t) for t, i in ids.items()}
        self.single = {s[0]: i for i, s in self.symbols.items() if len(s) == 1}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.trie: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()
        for i, s in self.symbols.items():
            node = 0
            for x in s:
                self.inner.add(node)
                node = self.trie.setdefault((node, x), len(self.trie) + 1)
            self.token_at[node] = i
        self.restart()

    def restart(self) -> None:
        self.follows: dict[tuple[int, int], bool] = {}
        self.column = np.full(512, -1, np.int32)
        self.columns = 0
        self.table = np.full((1024, 64), -1, np.int32)
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}

    def bpe(self, symbols: tuple[int, ...]) -> list[int]:
        """The tokens of a word by merging, the reference that transitions are compiled from."""
        out = [self.single[s] for s in symbols]
        while True:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(out, out[1:])) if p in self.merges), default=None)
            if best is None:
                return out
            k = best[1]
            out[k:k + 2] = [self.merges[out[k], out[k + 1]][1]]

    def _may_follow(self, before: int, token: int) -> bool:
        key = (before, token)
        if key not in self.follows:
            both = [token] if before < 0 else [before, token]
            self.follows[key] = self.bpe(sum((self.symbols[t] for t in both), ())) == both
        return self.follows[key]

    def _compile(self, state: int, symbol: int) -> None:
        going, last, count = [], None, 0
        for node, before, n in self.states[state]:
            child = self.trie.get((node, symbol))
            if child is None:
                continue
            if child in self.inner:
                going.append((child, before, n))
            token = self.token_at.get(child)
            if last is None and token is not None and self._may_follow(before, token):
                last, count = token, n + 1
        if symbol >= 256:
            to = 0
        else:
            key = (*((node, before, n - count) for node, before, n in going), (0, last, 0))
            to = self.number.setdefault(key, len(self.states))
            if to == len(self.states):
                self.states.append(key)
        if to >= len(self.table):
            self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.table.shape[1]), -1, np.int32)])
        self.table[state, self.column[symbol]] = to * _SHIFT + count + _OFFSET

    def _cells(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        cell = self.table[state, self.column[symbol]]
        missing = np.flatnonzero(cell < 0)
        if len(missing):
            for s, x in set(zip(state[missing].tolist(), symbol[missing].tolist())):
                self._compile(s, x)
            cell[missing] = self.table[state[missing], self.column[symbol[missing]]]
        return cell

    def counts(self, stream: np.ndarray) -> np.ndarray:
        """The count that each symbol of a stream of whole words emits."""
        if len(self.states) > MOST_STATES:
            self.restart()
        for x in np.unique(stream[self.column[stream] < 0]).tolist():
            self.column[x], self.columns = self.columns, self.columns + 1
        while self.columns > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
        out = np.zeros(len(stream), np.int64)
        start = np.arange(0, len(stream), CHUNK)
        stop = np.minimum(start + CHUNK, len(stream))
        # Where each chunk's map becomes constant: after its first word end, or at once if the chunk before ends a word.
        ends = np.flatnonzero(stream >= 256)
        reset = np.minimum(ends[np.searchsorted(ends, start)] + 1, stop)
        fresh = np.concatenate([[True], stream[start[1:] - 1] >= 256])
        reset[fresh] = start[fresh]
        exits = self._run(stream, out, reset, stop, np.zeros(len(start), np.int64))
        todo = np.flatnonzero(reset > start)
        known = ~(reset == stop) | fresh
        known[todo[stream[stop[todo] - 1] >= 256]] = True
        exits[stream[stop - 1] >= 256] = 0
        while len(todo):
            ready = known[todo - 1]
            now = todo[ready]
            one_by_one = len(now) <= SCALAR_CHUNKS
            if one_by_one:
                now = todo  # in order, so each finds its entry
            for part in np.split(now, len(now)) if one_by_one else [now]:
                ended = self._run(stream, out, start[part], reset[part], exits[part - 1])
                through = reset[part] == stop[part]
                exits[part[through]] = ended[through]
                known[part] = True
            todo = np.setdiff1d(todo, now, assume_unique=True)
        return out

    def _run(self, stream: np.ndarray, out: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Runs lo to hi of every chunk in step from ``state``; fills in the counts and returns the exit states."""
        if len(lo) == 1:
            now, last = int(state[0]), int(hi[0])
            for i in range(int(lo[0]), last):
                x = int(stream[i])
                cell = int(self.table[now, self.column[x]])
                if cell < 0:
                    self._compile(now, x)
                    cell = int(self.table[now, self.column[x]])
                now, out[i] = cell // _SHIFT, cell % _SHIFT - _OFFSET
            return np.array([now])
        exits, live = state.copy(), np.flatnonzero(lo < hi)
        at, state = lo[live], state[live]
        while len(live):
            cell = self._cells(state, stream[at])
            out[at] = cell % _SHIFT - _OFFSET
            state, at = cell // _SHIFT, at + 1
            over = at == hi[live]
            if over.any():
                exits[live[over]] = state[over]
                live, at, state = live[~over], at[~over], state[~over]
        return exits


class TokenCounter:
    """Counts the tokens of texts with the machines compiled from a tokenizer file's content."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer
        spec = json.loads(content)
        patterns = re.findall(r'"Regex": ?"((?:[^"\\]|\\.)*)"', json.dumps(spec["pre_tokenizer"]))
        if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix") or [json.loads(f'"{p}"') for p in patterns] != [SPLIT_REGEX]:
            raise ValueError("only byte-level BPE files with word ends and the stated splitting pattern are compiled")
        self.splitter, self.counter = Splitter(Tokenizer.from_str(content)), Counter(spec["model"])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else re.compile(r"(?!)")

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        bare = []
        for i, text in enumerate(texts):
            text, found = self.specials.subn("\n", text)
            total[i] += found
            bare.append(text)
        joined = self.splitter.lowered("\n".join(bare))
        if not len(joined):
            return total
        # Lower case may change lengths: texts end at the line feeds that were put between them.
        owner = self._owners(bare, joined)
        starts = self.splitter.words(joined)
        in_word = self.splitter.kind[joined] != SPACE
        last = in_word & np.concatenate([starts[1:] | ~in_word[1:], [True]])
        width = 1 + (joined >= 0x80) + (joined >= 0x800) + (joined >= 0x10000)
        raw = np.frombuffer(joined.tobytes().decode("utf-32-le").encode(), np.uint8)
        end = np.cumsum(width)
        symbol = raw.astype(np.int64)
        symbol[end[last] - 1] += 256
        counts = self.counter.counts(symbol[np.repeat(in_word, width)])
        by_char = np.zeros(len(counts) + 1, np.int64)
        by_char[1:] = np.cumsum(counts)
        upto = np.cumsum(np.where(in_word, width, 0))  # symbols up to each character
        texts_end = np.searchsorted(owner, np.arange(len(texts)), side="right")
        at = by_char[np.concatenate([[0], upto])[texts_end]]
        return total + np.diff(at, prepend=0)

    def _owners(self, bare: list[str], joined: np.ndarray) -> np.ndarray:
        """The text of each character of the normalized join, which has as many line feeds as the texts and what joins them."""
        feeds = np.cumsum([t.count("\n") + 1 for t in bare])  # line feeds up to and including a text's joint
        before = np.cumsum(joined == 0x0A) - (joined == 0x0A)
        return np.searchsorted(feeds, before, side="right")


_HELD: dict[int, TokenCounter] = {}


def _counter(content: str) -> TokenCounter:
    """The compiled tokenizer of this worker, kept from task to task."""
    key = hash(content)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = TokenCounter(content)
    return _HELD[key]


def _pieces(text: str) -> Iterator[str]:
    """``text`` in parts of about PIECE_CHARS, cut before white space."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = re.compile(r"[ \t\n\r]").search(text, at + PIECE_CHARS)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every text (see the module's text)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shared.value)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            held, of, size = [], [], 0

            def flush() -> None:
                np.add.at(n, of, count(held))

            for i, text in enumerate(batch.column(2)):
                for piece in _pieces(text.as_py() or ""):
                    held.append(piece)
                    of.append(i)
                    size += len(piece) + 1
                    if size >= PIECE_CHARS:
                        flush()
                        held, of, size = [], [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], names=["_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("_text"))
    counted = rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", "over_limit")
