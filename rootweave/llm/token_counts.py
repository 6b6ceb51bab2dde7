"""Token counts by byte-pair merging on a heap and a linked list.

Symbols of a pre-token form a linked list; a heap holds (merge rank, position) of adjacent pairs.
The lowest rank is popped, leftmost first, and merged when both neighbours are still those of that
rank. The count of a pre-token is its initial symbols minus its merges; no identifiers are made.

Null and empty texts have 0 tokens. Rows with a null doc_id are counted like others. Extra columns
are ignored. Texts are taken whole; repeated texts are counted again.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rootweave.llm.common import texts
from rootweave.llm.vocab import _CLOSED_WORD, Memo, batch_slices, split_at_blanks


class HeapMerger:
    """Counts tokens of a vocabulary file of the "BPE with word ends" kind."""

    def __init__(self, path: str, memo_size: int = 1_000_000):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": "\\s+"}:
            raise ValueError("a vocabulary with other normalisation than NFC, single blanks and lower case")
        self.end = model["end_of_word_suffix"] or ""
        self.symbols: dict[str, int] = {}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = self._symbol(left) << 32 | self._symbol(right)
            self.pairs[key] = (rank, self._symbol(left + right))
        self.by_byte = [self._symbol(c) for c in _byte_alphabet()]
        self.by_last_byte = [self._symbol(c + self.end) for c in _byte_alphabet()]
        specials = [regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(specials)) if specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.memo = Memo(memo_size, self._learn)

    def _symbol(self, text: str) -> int:
        return self.symbols.setdefault(text, len(self.symbols))

    def merged_length(self, word: str) -> int:
        """Tokens of one pre-token: initial symbols minus merges."""
        raw = word.encode("utf-8")
        n = len(raw)
        pairs = self.pairs
        symbol = [self.by_byte[b] for b in raw[:-1]] + [self.by_last_byte[raw[-1]]]
        if n == 1:
            return 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [found[0] << 32 | i for i in range(n - 1) if (found := pairs.get(symbol[i] << 32 | symbol[i + 1]))]
        heapify(heap)
        merges = 0
        while heap:
            item = heappop(heap)
            i = item & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = pairs.get(symbol[i] << 32 | symbol[j])
            if not found or found[0] != item >> 32:
                continue  # a neighbour has changed since
            merges += 1
            symbol[i], symbol[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(symbol[i] << 32 | symbol[k]):
                    heappush(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0 and (found := pairs.get(symbol[h] << 32 | symbol[i])):
                heappush(heap, found[0] << 32 | h)
        return n - merges

    def _normalised(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _piece(self, piece: str) -> int:
        if not self.end and piece:
            raise ValueError("a vocabulary without word ends needs its blanks")
        if _CLOSED_WORD.match(piece):
            return self.merged_length(self._normalised(piece[:-1])) + 1
        count, at = 0, 0
        for mark in self.special.finditer(piece) if self.special else ():
            count += 1 + sum(map(self.merged_length, self.pattern.findall(self._normalised(piece[at : mark.start()]))))
            at = mark.end()
        return count + sum(map(self.merged_length, self.pattern.findall(self._normalised(piece[at:]))))

    def _learn(self, new: list[str]) -> tuple[np.ndarray, None]:
        return np.fromiter(map(self._piece, new), dtype=np.int32, count=len(new)), None

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text."""
        out = np.zeros(len(texts), dtype=np.int64)
        for rows, split in split_at_blanks(texts):
            starts = split.offsets.to_numpy().astype(np.int64)
            coded = split.flatten().dictionary_encode()
            at = self.memo.lookup(coded.dictionary)
            counts = self.memo.size[at][coded.indices.to_numpy()].astype(np.int64)
            out[rows] = np.diff(np.concatenate([[0], np.cumsum(counts)])[starts - starts[0]])
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> HeapMerger:
    """One for each worker process, so that its memo outlives a task."""
    return HeapMerger(path)


def _byte_alphabet() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stay, others follow from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _count_batches(batches, path: str, limit: int):
    counter = merger(path)
    for batch in batches:
        for part in batch_slices(batch):
            counts = counter.count(part.column("text"))
            n_bytes = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), n_bytes, pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document; a narrow map without a shuffle."""
    return texts(docs).mapInArrow(
        partial(_count_batches, path=vocabulary, limit=limit),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
