"""Exact piecewise tokenisation with a bounded memo, on Arrow columns.

Cutting a text in front of a blank that precedes a non-blank never separates characters of one
pre-token in either supported vocabulary, so the ids of a text are the ids of its pieces in order.
Texts are split, coded by a dictionary and looked up as Arrow arrays; only pieces that the memo does
not hold become Python strings.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank that is followed by white space or ends the text keeps to its left neighbour.
_LOOSE_BLANK = r" ([\t-\r\x1c- \x{85}\p{Z}]|\z)"
_CUT = re.compile(r" (?=\S)")
#: Latin letters and one closing mark: one or two pre-tokens in both vocabularies.
_CLOSED_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]\Z")
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: Pieces without blanks and special strings: only the blank before one can open a token that starts with a blank.
_UNBROKEN = "^[^ <]+$"
SLICE_BYTES = 8_000_000


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices_of(group: list[str], chars: int = 5_000_000):
    """Index ranges of a list of texts whose sizes sum to about `chars`."""
    start = total = 0
    for i, text in enumerate(group):
        total += len(text)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(group):
        yield start, len(group)


def batch_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES):
    """Zero-copy slices of a batch whose texts sum to about `size` bytes."""
    total = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        held = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, held + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def split_at_blanks(texts: pa.Array):
    """(rows, list array of pieces) for the texts whose blanks all part pieces, and for the rest."""
    loose = pc.match_substring_regex(texts, _LOOSE_BLANK)
    odd = np.flatnonzero(loose.to_numpy(zero_copy_only=False))
    if not len(odd):
        yield np.arange(len(texts)), pc.split_pattern(texts, " ")
        return
    plain = np.flatnonzero(~loose.to_numpy(zero_copy_only=False))
    if len(plain):
        yield plain, pc.split_pattern(texts.take(plain), " ")
    yield odd, pa.array(map(_CUT.split, texts.take(odd).to_pylist()), pa.list_(pa.string()))


def gathered(store: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans (first, size) of a store, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(store)) < 1 << 31 else np.int64
    at = np.repeat((first - (ends - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return store[at]


class Memo:
    """Values of strings, each a span of numbers or their count alone, held as Arrow and numpy arrays.

    When more than `limit` strings are held, those that the last slice did not use are forgotten.
    """

    def __init__(self, limit: int, learn, dtype=None):
        self.limit, self.learn = limit, learn
        self.words = pa.array([], pa.string())
        self.size = np.zeros(0, dtype=np.int32)
        self.store = None if dtype is None else np.zeros(0, dtype=dtype)

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Places of distinct strings; learn(list of new strings) gives their counts and numbers."""
        found = pc.index_in(words, value_set=self.words)
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        if new.any():
            missing = words.filter(pa.array(new))
            if len(self.words) + len(missing) > self.limit:
                self._forget(at[~new])
                at[~new] = np.arange(len(self.words))
            size, store = self.learn(missing.to_pylist())
            at[new] = np.arange(len(missing)) + len(self.words)
            self.words = pa.concat_arrays([self.words, missing])
            self.size = np.concatenate([self.size, size])
            if self.store is not None:
                self.store = np.concatenate([self.store, store])
        return at

    def _forget(self, kept: np.ndarray) -> None:
        self.words = self.words.take(pa.array(kept))
        if self.store is not None:
            self.store = gathered(self.store, self.first[kept], self.size[kept])
        self.size = self.size[kept]

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.size, dtype=np.int64) - self.size


class PieceEncoder:
    """Ids of texts; the tokenizers library sees each new piece once."""

    def __init__(self, path: str, memo_size: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.leads = np.array([t.startswith("Ġ") for t in tokens])  # a blank opens the token
        self.closes = np.array([t.endswith("</w>") for t in tokens])  # a pre-token ends with the token
        self.after_blank = Memo(memo_size, self._learn, self.dtype)  # pieces that a blank precedes in the text

    def _library(self, group: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
        size = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        return size, np.fromiter((i for ids in found for i in ids), dtype=self.dtype, count=int(size.sum()))

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces go to the library together and are told apart by the tokens that close a word or open with a blank."""
        ids = self._library([" " + " ".join(words[at : at + 1024]) for at in range(0, len(words), 1024)])[1]
        if self.closes.any():
            ends = np.flatnonzero(self.closes[ids])
            marks = np.fromiter((w[-1] in ".," for w in words), dtype=np.int64, count=len(words))
            last = ends[np.cumsum(marks + 1) - 1] + 1
            return np.diff(last, prepend=0).astype(np.int32), ids
        return np.diff(np.flatnonzero(self.leads[ids]), append=len(ids)).astype(np.int32), ids

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        closed = pc.match_substring_regex(pa.array(new, pa.string()), _LETTERS if self.closes.any() else _UNBROKEN).to_numpy(zero_copy_only=False)
        size = np.zeros(len(new), dtype=np.int32)
        parts = []
        for mask, encode, lead in ((closed, self._joined, ""), (~closed, self._library, " ")):
            if mask.any():
                size[mask], ids = encode([lead + new[i] for i in np.flatnonzero(mask)])
                parts.append((mask, ids))
        if len(parts) == 1:
            return size, parts[0][1]
        out = np.empty(int(size.sum()), dtype=self.dtype)
        for mask, ids in parts:
            out[np.repeat(mask, size)] = ids
        return size, out

    def _together(self, split: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as lists of pieces, and how many each text has; `end` closes each text."""
        starts = split.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        flat = split.flatten()
        coded = flat.dictionary_encode()
        memo = self.after_blank
        places = memo.lookup(coded.dictionary)
        head_size, heads = self._library(flat.take(pa.array(starts[:-1])).to_pylist())
        store = np.concatenate([memo.store, heads, end])
        size = np.concatenate([memo.size, head_size, [len(end)]])
        first = np.cumsum(size, dtype=np.int64) - size
        # a text is its head, its other pieces and the end
        texts = len(starts) - 1
        code = np.full(len(flat) + texts, len(size) - 1, dtype=np.int64)
        code[np.arange(len(flat)) + np.repeat(np.arange(texts), np.diff(starts))] = places[coded.indices.to_numpy()]
        code[starts[:-1] + np.arange(texts)] = len(memo.size) + np.arange(texts)
        length = size[code]
        total = np.concatenate([[0], np.cumsum(length)])
        return gathered(store, first[code], length), np.diff(total[starts + np.arange(texts + 1)])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[pa.Array, np.ndarray]:
        """Ids of every text as little-endian bytes, `width` for each id, and the number of ids; the end id closes each."""
        end = np.array([] if end_id is None else [end_id], dtype=self.dtype)
        parts = [(rows, *self._together(split, end)) for rows, split in split_at_blanks(texts)]
        if not parts:
            return pa.array([], pa.binary()), np.zeros(0, dtype=np.int64)
        column = pa.concat_arrays([binary_rows(ids, n * self.width) for _, ids, n in parts])
        counts = np.concatenate([n for _, _, n in parts])
        if len(parts) > 1:
            order = np.argsort(np.concatenate([rows for rows, _, _ in parts]))
            column, counts = column.take(pa.array(order)), counts[order]
        return column, counts


def binary_rows(values: np.ndarray, n_bytes: np.ndarray) -> pa.Array:
    """A binary column of the given sizes over one buffer."""
    offsets = np.concatenate([[0], np.cumsum(n_bytes)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("texts of a slice are longer than a binary column holds")
    return pa.BinaryArray.from_buffers(pa.binary(), len(n_bytes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process, so that its memo outlives a task."""
    return PieceEncoder(path)
