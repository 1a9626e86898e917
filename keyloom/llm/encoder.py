"""Token ids of many texts by a tokenizers file, each distinct chunk encoded once per worker.

For tokenizers that drop white space and lower-case (word-end BPE), a text's ids are those of its
chunks between ASCII white space, one after the other, and a mark after a letter at the end of a
chunk is a chunk of its own. Chunks are looked up in a table; new ones go to the library, plain
words many in one string, because every one of them ends with a word-end token. The table is
emptied when it holds about ``table_bytes``, whatever the number and length of its chunks; a smaller
table encodes common chunks anew more often.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

TABLE_BYTES = 300_000_000
SMALL_TABLE = 64_000_000  # where a worker's memory counts for more than its time
ENTRY_BYTES = 256  # of a chunk besides its bytes and ids, about
JOINED = 500  # plain words of one string
# Words of a-z and the letters of U+00C0 to U+00FF: one piece for every splitter by letters.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_MARK = re.compile(rb"[.,](?<=[a-z].)(?![^ \t-\r])")


class _Numbers(dict):
    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.specials = not special_as_text
        self.table_bytes = table_bytes
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.held = _Numbers(), 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.n_flat = np.zeros(4096, np.uint32), 0

    def _call(self, texts: list[bytes]) -> list[list[int]]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        return [
            e.ids for e in self.tokenizer.encode_batch_fast(decoded, add_special_tokens=False)
        ]

    def _add(self, places: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        total = len(ids)
        self.flat = _room(self.flat, self.n_flat + total)
        self.flat[self.n_flat : self.n_flat + total] = ids
        first = np.concatenate([[0], ends[:-1]])
        self.starts[places], self.lengths[places] = self.n_flat + first, ends - first
        self.n_flat += total
        self.held += 4 * total

    def _learn(self) -> None:
        fresh, n = self.numbers.fresh, len(self.numbers)
        self.starts, self.lengths = _room(self.starts, n), _room(self.lengths, n)
        base = n - len(fresh)
        plain = np.fromiter((_PLAIN.fullmatch(c) is not None for c in fresh), bool, len(fresh))
        words = [fresh[i] for i in np.flatnonzero(plain).tolist()]
        if words:
            joined = [b" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
            ids = np.array([i for part in self._call(joined) for i in part], np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(words):
                self._add(base + np.flatnonzero(plain), ids, ends)
            else:
                plain[:] = False
        rest = np.flatnonzero(~plain)
        if len(rest):
            parts = self._call([fresh[i] for i in rest.tolist()])
            ends = np.cumsum([len(p) for p in parts])
            self._add(base + rest, np.array([i for p in parts for i in p], np.uint32), ends)
        self.held += ENTRY_BYTES * len(fresh) + sum(map(len, fresh))
        fresh.clear()

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, each followed by ``end``, and where each ends."""
        if self.held > self.table_bytes:
            self._empty()
        chunks: list[bytes] = []
        borders = np.empty(len(texts) + 1, np.int64)
        borders[0] = 0
        for k, text in enumerate(texts):
            # Lower-casing is the tokenizer's own; special strings must keep their case.
            own = text if self.specials and b"<|" in text else text.lower()
            chunks += _MARK.sub(rb" \g<0>", own).split()
            borders[k + 1] = len(chunks)
        found = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
        if self.numbers.fresh:
            self._learn()
        lengths = self.lengths[found]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        ends = offsets[borders[1:]] + np.arange(1, len(texts) + 1)
        source = np.repeat(self.starts[found] - offsets[:-1], lengths) + np.arange(offsets[-1])
        ids = np.full(int(offsets[-1]) + len(texts), end, np.uint32)
        inside = np.ones(len(ids), bool)
        inside[ends - 1] = False
        ids[inside] = self.flat[source]
        return ids, ends


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


def of_worker(path: str, special_as_text: bool = False, table_bytes: int = TABLE_BYTES) -> Encoder:
    """The worker's encoder: made once in a Python process, whatever number of tasks it runs."""
    kept = sys.modules.setdefault("_keyloom_encoders", types.ModuleType("_keyloom_encoders"))
    key = f"{path}|{special_as_text}|{table_bytes}"
    if key not in kept.__dict__:
        kept.__dict__[key] = Encoder(path, special_as_text, table_bytes)
    return kept.__dict__[key]
