"""Token ids of many texts by the tokenizers library, with a bounded memory of the ids of space-separated chunks.

Byte-pair merges never cross a pre-token, and for the tokenizers in use no pre-token crosses the edges at which
texts are cut here, so ids of chunks, joined, are the ids of the text; where that isn't sure the whole text goes
to the library at once.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A comma or full stop after no word; it begins with the stop itself, as few characters are one, and then looks back.
_STOP = re.compile(r"[.,](?<=[\W_].)\s")
_KNOWN: dict[str, "ChunkedTokenizer"] = {}
MOST_CHUNKS = 600_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkedTokenizer:
    """encode(texts): flat uint32 ids and the number of ids of each text."""

    def __init__(self, path: str):
        # A task has one core: the library's threads would cost more CPU seconds than they save time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        # Byte-level vocabularies keep a blank with the word after it; the others drop white space altogether.
        self.keeps_blanks = spec["pre_tokenizer"]["type"] == "ByteLevel"
        # Control characters, and for byte-level vocabularies all white space but the blank and the line feed.
        self.odd = re.compile("[\0\1\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]" if self.keeps_blanks else r"[\x00\x01\x1c-\x1f\x85]")
        self.forget()

    def unsure(self, text: str) -> bool:
        """Whether a text may have pre-tokens over the edges at which edged() cuts, or holds a control string of the vocabulary."""
        if any(x in text for x in self.added):
            return True
        if self.keeps_blanks and ("  " in text or "\n\n" in text or " \n" in text or "\n " in text):
            return True
        return bool(self.odd.search(text) or _STOP.search(text))

    def forget(self) -> None:
        """Keep only chunks that came again since they were learnt."""
        if getattr(self, "index", None) and (again := np.flatnonzero(self.hits[: len(self.index)] > 1)).size < MOST_CHUNKS // 2:
            names = list(self.index)
            sizes = self.first[again + 1] - self.first[again]
            to = np.cumsum(sizes)
            kept = self.ids[np.repeat(self.first[again] - (to - sizes), sizes) + np.arange(sizes.sum())]
            self.index = {names[i]: k for k, i in enumerate(again.tolist())}
            self.ids[: len(kept)], self.first[1 : len(to) + 1], self.n_ids = kept, to, len(kept)
            self.hits[:] = 0
            return
        self.index: dict[str, int] = {}
        self.hits = np.zeros(MOST_CHUNKS * 2, np.int32)
        self.ids, self.first, self.n_ids = np.zeros(1 << 20, np.uint32), np.zeros(MOST_CHUNKS * 2, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        """A chunk that starts with \\1 stands as it is; in byte-level vocabularies, others follow a blank."""
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            blank = " " if self.keeps_blanks else ""
            plain = [x[1:] if x[:1] == "\1" else blank + x for x in part]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(found), np.uint32)
            while self.n_ids + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            base = len(self.index)
            if base + len(part) + 1 > len(self.first):
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
                self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
            self.first[base + 1 : base + len(part) + 1] = self.n_ids + np.cumsum([len(x) for x in found])
            self.index.update(zip(part, range(base, base + len(part))))
            self.n_ids += len(flat)

    def edged(self, text: str) -> str:
        """The text with a blank at every edge: at blanks, and before a comma or full stop after a word. Ids of what stands between blanks, joined, are those of the text."""
        if self.keeps_blanks:
            return ("\1" + text).replace(", ", " \1, ").replace(". ", " \1. ").replace(".\n", " \1.\n \1")
        return text.replace("\n", " ").replace(", ", " , ").replace(". ", " . ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > MOST_CHUNKS:
            self.forget()
        whole = [self.unsure(t) for t in texts]
        cut = pc.split_pattern(pa.array(["" if w else self.edged(t) for t, w in zip(texts, whole)], pa.large_string()), " ")
        codes = cut.values.dictionary_encode()
        chunks = codes.dictionary.to_pylist()
        where, edges = codes.indices.to_numpy().astype(np.int64), cut.offsets.to_numpy()[1:]
        for i in np.flatnonzero(whole).tolist():  # its one chunk, so far empty, is the text
            where[edges[i] - 1] = len(chunks)
            chunks.append("\1" + texts[i])
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        if lacking := [chunks[i] for i in np.flatnonzero(at < 0).tolist()]:
            self._learn(list(dict.fromkeys(lacking)))
            at[at < 0] = [self.index[c] for c in lacking]
        where = at[where]
        self.hits[: len(self.index)] += np.bincount(where, minlength=len(self.index)).astype(np.int32)
        first, sizes = self.first[where], self.first[where + 1] - self.first[where]
        to = np.cumsum(sizes)
        flat = self.ids[np.repeat(first - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0)]
        ends = np.where(edges > 0, to[edges - 1], 0) if len(to) else np.zeros(len(texts), np.int64)
        return flat, np.diff(ends, prepend=0)


def chunked(path: str) -> ChunkedTokenizer:
    """One for each Python worker, which keeps it from task to task."""
    if path not in _KNOWN:
        _KNOWN[path] = ChunkedTokenizer(path)
    return _KNOWN[path]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
