"""Fast, exact token ids of whole texts with a public byte-level BPE vocabulary.

The vocabulary's pre-tokeniser starts a new piece at every blank that a non-blank follows, and merges never cross
pieces. A text can therefore be cut at those blanks, each different chunk encoded once by the tokenizers library and
its ids kept, and the ids joined. Texts with runs of blanks, or with other white space after a blank, are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Chunks of which an encoder keeps the ids, by default: about 300 MB in a worker that has met as many twice.
KEEP_CHUNKS = 350_000
#: Stands for chunks whose ids depend on what is before them; no chunk has ids of one byte.
_ODD = b"?"
#: Characters that may end a chunk behind its letters; none of them joins the letters in one piece.
_TAIL = ".,;:!?*#%&$)"


class ChunkEncoder:
    """Encodes texts; keeps the ids of about twice `keep` chunks."""

    def __init__(self, path: str | None = None, keep: int = KEEP_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else np.dtype("<u4")
        self.keep = keep
        self.blank_first = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.blank_first[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.after_blank: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn_heads(self, chunks: set[str]) -> None:
        missing = list(chunks.difference(self.at_start))
        if missing:
            for c, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                self.at_start[c] = np.array(e.ids, dtype=self.dtype).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Encodes new chunks many at a time: in their joined text only each chunk's first token holds a blank."""
        missing, tails = [], []
        for c in chunks:
            core = c.rstrip(_TAIL)
            if not c or c[0].isspace():  # white space next to a blank forms one piece with it
                self.after_blank[c] = _ODD
            elif core != c and core.isalpha():  # letters and what follows them are separate pieces
                tails.append((c, core, c[len(core) :]))
            else:
                missing.append(c)
        self._learn_heads({t for _, _, t in tails})
        missing += {core for _, core, _ in tails}.difference(self.after_blank, missing)
        for at in range(0, len(missing), 2000):
            part = missing[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = np.flatnonzero(self.blank_first[ids])
            if len(starts) != len(part):
                raise ValueError("the vocabulary's pieces do not start at blanks")
            raw, cuts = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
            self.after_blank.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        for c, core, tail in tails:
            self.after_blank[c] = self.after_blank[core] + self.at_start[tail]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's begin in it (one bound more than texts). Null: no ids.

        Arrow cuts the texts and numbers their different chunks; only these are looked up or encoded one by one.
        """
        if len(self.after_blank) > self.keep:  # what has been met since the last time stays within reach
            self.before, self.after_blank = self.after_blank, {}
        if len(self.at_start) > self.keep:
            self.at_start = {"": b""}
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        cuts = parts.offsets.to_numpy()
        cuts = cuts - cuts[0]
        first, chunks = cuts[:-1], parts.flatten().dictionary_encode()
        distinct, at = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = [distinct[k] for k in at[first]]
        self._learn_heads(set(heads))
        found = list(map(self.after_blank.get, distinct))
        if None in found:
            places = [k for k, f in enumerate(found) if f is None]
            new = [distinct[k] for k in places]
            older = list(map(self.before.get, new))
            self.after_blank.update((c, ids) for c, ids in zip(new, older, strict=True) if ids is not None)
            self._learn([c for c, ids in zip(new, older, strict=True) if ids is None])
            for k, c in zip(places, new, strict=True):
                found[k] = self.after_blank[c]
        bytes_of = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        inner = np.ones(len(at), dtype=bool)
        inner[first] = False
        uncertain = bytes_of == len(_ODD)
        odd = np.logical_or.reduceat(uncertain[at] & inner, first) if len(first) else np.zeros(0, dtype=bool)
        own = [self.whole(texts[k].as_py()) if o else self.at_start[h] for k, (h, o) in enumerate(zip(heads, odd.tolist(), strict=True))]
        joined = b"".join(f for f in found if f is not _ODD) if uncertain.any() else b"".join(found)
        bytes_of[uncertain] = 0
        size = np.concatenate((bytes_of, np.fromiter(map(len, own), dtype=np.int64, count=len(own)))) // self.dtype.itemsize
        at[first] = len(found) + np.arange(len(first))
        lengths, begins = size[at], (np.cumsum(size) - size)[at]
        lengths[np.repeat(odd, np.diff(cuts)) & inner] = 0
        ends = np.cumsum(lengths)
        places = np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = np.frombuffer(b"".join([joined, *own]), dtype=self.dtype)[places]
        return ids, np.concatenate(([0], ends))[cuts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text (null: none), in the width of self.dtype."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


_ENCODERS: dict[tuple[str | None, int], ChunkEncoder] = {}


def forget_encoders() -> None:
    """Give back the memory of what encoders have learned, hundreds of megabytes at times."""
    _ENCODERS.clear()


def encoder(path: str | None = None, keep: int = KEEP_CHUNKS) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary, so that what it has learned serves later tasks."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, keep] = ChunkEncoder(path, keep)
    return _ENCODERS[path, keep]
