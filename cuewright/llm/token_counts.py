"""Exact token counts at every prefix of a text, by dynamic programming over a word-end byte-pair vocabulary.

Within a piece (a word, a digit, a run of marks) byte-pair merging has one property that makes prefixes cheap: of all
tokens that end at a place exactly one can be the last token of the merged prefix, the one that merging keeps apart from
the last token of what stands before it. So the last token and the count of each prefix follow from those of shorter
prefixes, and no prefix is ever encoded. Pieces never cross blanks, so a text's counts are those of its chunks, added up.

The counts are kept as differences, a byte for each code point: what the next code point adds to (or, where it lets tokens
merge, takes from) the count. Truncation and budget questions are answered from these bytes alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# The pre-tokeniser's pattern and the mark of a word's end, as the vocabulary file states them
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_VISIBLE = re.compile(r"[!-~]*")
_SHAPES = re.compile(r"l+|n|m+")
_SPACE, _LETTER, _NUMBER, _MARK = range(4)
#: Stands for a chunk whose steps do not fit into a byte each.
_WIDE = b"\x80"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Walk:
    """Counts at every prefix of normalised text, a code point at a time; can be taken back to any earlier place."""

    def __init__(self, counter: PrefixCounter) -> None:
        self.of, self.raw, self.nodes, self.last, self.count = counter, bytearray(), [0], [-1], [0]
        # for each code point: kind, first byte of its piece, tokens before the piece, tokens so far, whether the piece is
        # closed, bytes so far, and the "'r", "'v" or "'l" that may become a contraction with the tokens before it
        self.places: list[tuple[int, int, int, int, bool, int, tuple[str, int] | None]] = []

    def tokens(self) -> int:
        return self.places[-1][3] if self.places else 0

    def back_to(self, places: int) -> None:
        del self.places[places:]
        size = self.places[-1][5] if self.places else 0
        del self.raw[size:], self.nodes[size + 1 :], self.last[size + 1 :], self.count[size + 1 :]

    def push(self, ch: str) -> None:
        kind = self.of.kind(ch)
        before, start, base, total, closed, size, waits = self.places[-1] if self.places else (_SPACE, 0, 0, 0, True, 0, None)
        if kind == _SPACE:
            self.places.append((_SPACE, size, total, total, True, size, None))
            return
        done, wait = None, None
        if kind == _LETTER and before == _MARK and start == size - 1 and self.raw[start:] == b"'":
            if ch in "stmd":
                done = base + self.of.tokens("'" + ch)
            elif ch in "rvl":
                wait = ("'" + ch, base)
        elif waits and waits[0] + ch in ("'re", "'ve", "'ll"):
            done = waits[1] + self.of.tokens(waits[0] + ch)
        if kind != before or closed or kind == _NUMBER:
            start, base = size, total
        for b in ch.encode():
            self.raw.append(b)
            self.grow(start, b)
        if done is None:
            self.places.append((kind, start, base, base + self.closed(start), False, len(self.raw), wait))
        else:
            self.places.append((kind, start, base, done, True, len(self.raw), None))

    def grow(self, start: int, b: int) -> None:
        """The last token of the merged but unfinished piece that begins at `start`, and its tokens, with one byte more."""
        end, of = len(self.raw), self.of
        node = of.step(0 if end == start + 1 else self.nodes[-1], b)
        at, token = next((end - n, t) for t, n in of.inner[node] if end - n == start or of.fits(self.last[end - n], t))
        self.nodes.append(node)
        self.last.append(token)
        self.count.append(1 if at == start else self.count[at] + 1)

    def closed(self, start: int) -> int:
        """Tokens of the piece from `start` on if it ends here."""
        end, of = len(self.raw), self.of
        at = next(end - n for t, n in of.final[self.nodes[-1]] if end - n == start or of.fits(self.last[end - n], t))
        return 1 if at == start else self.count[at] + 1


class _Lazy(dict):
    """A table that finds its missing values by a rule."""

    def __init__(self, rule: Callable) -> None:
        self.rule = rule

    def __missing__(self, key):
        self[key] = self.rule(key)
        return self[key]


class PrefixCounter:
    """Counts tokens at every prefix; keeps what it has found for about twice `keep` chunks and `keep` pieces."""

    def __init__(self, path: str | None = None, keep: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path or default_vocabulary()), keep
        with open(path or default_vocabulary(), encoding="utf-8") as f:
            stated = json.load(f)
        model, patterns = stated["model"], [p["pattern"].get("Regex") for p in stated["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if patterns != [PATTERN] or model["end_of_word_suffix"] != WORD_END or [a for a in stated["added_tokens"] if a["normalized"] or not a["special"]]:
            raise ValueError("not a word-end byte-pair vocabulary of the known form")
        self.special = re.compile("|".join(re.escape(a["content"]) for a in stated["added_tokens"]) or r"(?!)")
        self._build_automaton(model["vocab"])
        self.size = size = 1 + max(model["vocab"].values())
        self.rank, self.made, self.left, self.right = {}, [-1] * size, [-1] * size, [-1] * size
        for k, pair in enumerate(model["merges"]):
            first, second = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = (model["vocab"][x] for x in (first, second, first + second))
            self.rank[a * size + b] = k
            self.made[whole], self.left[whole], self.right[whole] = k, a, b
        self.apart: dict[int, bool] = {}
        self.kinds: dict[str, int] = _Lazy(self._kind)
        self.shape = _Lazy(self._shape)
        self.lower = _Lazy(lambda c: self.tokenizer.normalizer.normalize_str(chr(c)))
        self.begins: dict[str, bool] = _Lazy(self._begins)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.wide: dict[str, np.ndarray] = {}

    def _build_automaton(self, vocab: dict[str, int]) -> None:
        """An automaton of all tokens' bytes: each node's tokens that end there, the longest first, with their lengths;
        `inner` those that may stand inside a piece, `final` those that end one."""
        byte_of, self.go, deep = _byte_of(), {}, [(0, b"")]
        inner: dict[int, tuple[int, int]] = {}
        final: dict[int, tuple[int, int]] = {}
        for token, number in vocab.items():
            ends = token.endswith(WORD_END) and token != WORD_END
            node, raw = 0, bytes(byte_of[c] for c in (token.removesuffix(WORD_END) if ends else token))
            for k, b in enumerate(raw):
                if node << 8 | b not in self.go:
                    self.go[node << 8 | b] = len(deep)
                    deep.append((len(deep), raw[: k + 1]))
                node = self.go[node << 8 | b]
            (final if ends else inner)[node] = (number, len(raw))
        self.fail, self.inner, self.final, at = [0] * len(deep), [()] * len(deep), [()] * len(deep), {b"": 0}
        for node, raw in sorted(deep[1:], key=lambda x: len(x[1])):
            at[raw] = node
            down = self.fail[node] = self._target(self.fail[at[raw[:-1]]], raw[-1]) if len(raw) > 1 else 0
            self.inner[node] = ((inner[node],) if node in inner else ()) + self.inner[down]
            self.final[node] = ((final[node],) if node in final else ()) + self.final[down]
        self.tree = dict(self.go)

    def _target(self, node: int, b: int) -> int:
        while node << 8 | b not in self.go and node:
            node = self.fail[node]
        return self.go.get(node << 8 | b, 0)

    def step(self, node: int, b: int) -> int:
        found = self.go.get(node << 8 | b)
        if found is None:
            if len(self.go) > len(self.tree) + self.keep:
                self.go = dict(self.tree)
            found = self.go[node << 8 | b] = self._target(self.fail[node], b) if node else 0
        return found

    # --- merging ----------------------------------------------------------------------------------------------------

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the symbols of tokens a and b side by side ends with just these two.

        Goes back in time: of the merges that made the two tokens at the border the later one is undone, and at each
        moment the two must not have been merged with each other before that. Equal merges run from left to right.
        """
        limit, last_of_a = 1 << 60, True
        while True:
            rank = self.rank.get(a * self.size + b)
            if rank is not None and (rank < limit or rank == limit and not last_of_a):
                return False
            if self.made[a] > self.made[b]:
                limit, last_of_a, a = self.made[a], True, self.right[a]
            elif self.made[b] >= 0:
                limit, last_of_a, b = self.made[b], False, self.left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        pair = a * self.size + b
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) > 2 * self.keep:
                self.apart.clear()
            known = self.apart[pair] = self._stay_apart(a, b)
        return known

    def piece(self, text: str) -> bytes:
        """What each code point of a normalised piece adds to its tokens."""
        known = self.pieces.get(text)
        if known is not None:
            return known
        raw, go, apart, size = text.encode(), self.go.get, self.apart.get, self.size
        ends = len(raw) == len(text) or set(accumulate(len(c.encode()) for c in text))
        node, last, count, steps, before = 0, [-1], [0], [], 0
        for end, b in enumerate(raw, 1):
            at = go(node << 8 | b)
            node = self.step(node, b) if at is None else at
            if ends is True or end in ends:
                for token, n in self.final[node]:
                    k = end - n
                    if not k:
                        break
                    fits = apart(last[k] * size + token)
                    if fits or fits is None and self.fits(last[k], token):
                        break
                now = count[k] + 1
                steps.append(now - before)
                before = now
            for token, n in self.inner[node]:
                k = end - n
                if not k:
                    break
                fits = apart(last[k] * size + token)
                if fits or fits is None and self.fits(last[k], token):
                    break
            last.append(token)
            count.append(count[k] + 1)
        if len(self.pieces) > self.keep:
            self.pieces.clear()
        known = self.pieces[text] = self._packed(steps, text)
        return known

    def _packed(self, steps: list[int], text: str) -> bytes:
        try:
            packed = array("b", steps).tobytes()
        except OverflowError:
            packed = _WIDE
        if _WIDE in packed:
            self.wide[text] = np.array(steps, dtype="<i4")
            return _WIDE
        return packed

    def tokens(self, piece: str) -> int:
        """Tokens of a whole piece."""
        return int(self._steps_of(piece, self.piece(piece)).sum(dtype=np.int64))

    def _steps_of(self, text: str, packed: bytes) -> np.ndarray:
        return self.wide[text] if packed is _WIDE else np.frombuffer(packed, dtype=np.int8)

    # --- chunks -----------------------------------------------------------------------------------------------------

    def kind(self, ch: str) -> int:
        """Blank, letter, number or mark, as the vocabulary's own pre-tokeniser sees it."""
        return self.kinds[ch]

    def _kind(self, ch: str) -> int:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        twice = len(cut(ch + ch))
        return _SPACE if not twice else _NUMBER if twice == 2 else _LETTER if len(cut("a" + ch)) == 1 else _MARK

    def _begins(self, ch: str) -> bool:
        """Whether normalisation never joins ch with what stands before it."""
        c = (unicodedata.normalize("NFC", ch) or ch)[0]
        return not (unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cn" or unicodedata.combining(c) or 0x1160 <= ord(c) <= 0x11FF)

    def _shape(self, code: int) -> str:
        """The kind of a code point that normalisation turns into one, whatever stands around it; else x."""
        normal = self.lower[code]
        return ("x", "l", "n", "m")[self.kinds[normal]] if len(normal) == 1 and self.begins[chr(code)] else "x"

    def _walked(self, text: str) -> list[int]:
        """Tokens of each prefix of any text without special strings."""
        walk, out, group, shape, begin = _Walk(self), [], "", "", 0
        normal = self.tokenizer.normalizer.normalize_str
        for ch in text:
            if self.begins[ch]:
                group, shape, begin = ch, "", len(walk.places)
            else:  # a combining mark changes the group it belongs to, and nothing before that
                group += ch
            new, same = normal(group), 0
            while same < min(len(new), len(shape)) and new[same] == shape[same]:
                same += 1
            walk.back_to(begin + same)
            for c in new[same:]:
                walk.push(c)
            shape = new
            out.append(walk.tokens())
        return out

    def _cut(self, chunk: str) -> list[str] | None:
        """The pieces of a chunk whose prefixes are cut at the same places; None for others."""
        if _VISIBLE.fullmatch(chunk):
            return _ASCII_PIECES.findall(chunk.lower()) if "'" not in chunk and "<|" not in chunk else None
        shape = chunk.translate(self.shape)
        if "x" in shape or "'" in chunk or "<|" in chunk:
            return None
        normal = chunk.translate(self.lower)
        return [normal[m.start() : m.end()] for m in _SHAPES.finditer(shape)]

    def _counts(self, text: str) -> list[int]:
        """Tokens of each prefix, by code points, of a text without blanks before or behind it."""
        out, total, at = [], 0, 0
        for m in self.special.finditer(text):
            out += [total + c for c in self._walked(text[at : m.end()])[:-1]]  # an unfinished special string is ordinary text
            total += (self._walked(text[at : m.start()])[-1] if m.start() > at else 0) + 1
            out.append(total)
            at = m.end()
        return out + [total + c for c in self._walked(text[at:])]

    def _learn(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            pieces = self._cut(chunk)
            if pieces is not None:
                found = list(map(self.piece, pieces))
                if not self.wide or not any(f is _WIDE for f in found):
                    found = found[0] if len(found) == 1 else b"".join(found)
                else:
                    pieces = None
            if pieces is None:
                counts = self._counts(chunk)
                found = self._packed(list(map(int.__sub__, counts, [0, *counts])), chunk)
        self.chunks[chunk] = found
        return found

    def steps(self, text: str) -> tuple[np.ndarray, bytes]:
        """What each code point adds to the count, and the same as bytes: their width (1 or 4), then the steps."""
        parts = text.replace("\n", " ").split(" ")  # neither adds a token, wherever it stands
        found = list(map(self.chunks.get, parts))
        if None in found:
            if len(self.chunks) > self.keep:  # what has been met since the last time stays within reach
                self.older, self.chunks = self.chunks, {"": b""}
                known = {p: f for p, f in zip(parts, found, strict=True) if f is not None}
                self.chunks |= known
            chunks = self.chunks.get
            for k, f in enumerate(found):
                if f is None:
                    found[k] = chunks(parts[k]) or self._learn(parts[k])
        if self.wide and any(f is _WIDE for f in found):
            narrow = (self._steps_of(p, f).astype("<i4").tobytes() for p, f in zip(parts, found, strict=True))
            steps = np.frombuffer(np.zeros(1, dtype="<i4").tobytes().join(narrow), dtype="<i4")
            return steps, b"\x04" + steps.tobytes()
        joined = b"\0".join(found)
        return np.frombuffer(joined, dtype=np.int8), b"\x01" + joined


_COUNTERS: dict[str | None, PrefixCounter] = {}


def counter(path: str | None = None) -> PrefixCounter:
    """One counter for each Python worker and vocabulary, so that what it has learned serves later tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_counts(stored: bytes) -> np.ndarray:
    """The token counts of the first 1, 2, ... code points from their stored form."""
    return np.cumsum(np.frombuffer(stored, dtype={1: np.int8, 4: "<i4"}[stored[0]], offset=1), dtype=np.int64)


# --- operators ------------------------------------------------------------------------------------------------------


def count_prefixes(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_chars (code points), n_tokens, and prefix_counts, which holds the exact count of every prefix.

    docs: doc_id, text; other columns are ignored, repeated rows give a row each. A null text is empty: no tokens. Counts
    are those of the tokenizers library with its defaults for special strings in texts, without added tokens. A prefix ends
    behind any code point, also before a combining mark that changes the letter in front of it. One pass, no shuffle; the
    time is linear in a text's length, but for a run of n combining marks in one place, which is normalised n times.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = counter(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1)
            found = [count.steps(t) if t else (np.zeros(0, dtype=np.int8), b"\x01") for t in texts.to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                    pa.array([len(s) for s, _ in found], pa.int64()),
                    pa.array([int(s.sum(dtype=np.int64)) for s, _ in found], pa.int64()),
                    pa.array([b for _, b in found], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_chars", "n_tokens", "prefix_counts"],
            )

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_counts binary")


def _by_row(of: Callable[[np.ndarray, int], int]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("long")
    def udf(stored: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(n) else of(prefix_counts(s), int(n)) for s, n in zip(stored, asked, strict=True)], dtype="Int64")

    return udf


def tokens_of_prefix(stored: Column | str, chars: Column | int) -> Column:
    """Tokens of the first `chars` code points (all of a shorter text's; none for zero or less), null if either is null."""
    of = _by_row(lambda counts, n: int(counts[min(n, len(counts)) - 1]) if n > 0 and len(counts) else 0)
    return of(F.col(stored) if isinstance(stored, str) else stored, chars if isinstance(chars, Column) else F.lit(chars))


def longest_prefix(stored: Column | str, budget: Column | int) -> Column:
    """The largest number of leading code points that have at most `budget` tokens; 0 for a negative budget, null if either
    is null. Counts may fall where a code point lets tokens merge, so shorter prefixes may have more."""
    of = _by_row(lambda counts, n: int(np.max(np.flatnonzero(counts <= n), initial=-1)) + 1 if n >= 0 else 0)
    return of(F.col(stored) if isinstance(stored, str) else stored, budget if isinstance(budget, Column) else F.lit(budget))


def truncate_texts(docs: DataFrame, budget: int, *, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text (the longest beginning of at most `budget` tokens; null stays null), n_tokens (its own)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = counter(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, tokens = batch.column(1).to_pylist(), []
            for k, t in enumerate(texts):
                counts = np.concatenate(([0], np.cumsum(count.steps(t)[0], dtype=np.int64))) if t else np.zeros(1, dtype=np.int64)
                end = int(np.max(np.flatnonzero(counts <= budget), initial=0))
                texts[k] = t[:end] if t else t
                tokens.append(int(counts[end]))
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(tokens, pa.int64())], names=["doc_id", "text", "n_tokens"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, text string, n_tokens long")


def token_budget(docs: DataFrame, *, limit: int, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every whole text."""
    counted = count_prefixes(docs, vocabulary=vocabulary)
    return counted.select("doc_id", "n_bytes", tokens_at_end().alias("n_tokens"), (tokens_at_end() > limit).alias("over_limit"))


def tokens_at_end() -> Column:
    """The count of the longest prefix, the whole text."""
    return F.col("n_tokens")
