"""Texts cut where byte-level tokenizers always cut.

A blank between two characters that are no white space always starts a new
piece, so a text can be encoded chunk by chunk, each with its leading blank, and
a chunk that was seen before need not be encoded again.
"""

from __future__ import annotations

import ctypes
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
# Chunks of a generation, and bytes of texts encoded together.
MOST_CHUNKS, STRETCH = 120_000, 4 << 20
# Marks that are a piece of their own at the end of a chunk, after a letter.
TAILS = ".,;:!?"


def of_worker(name: str, make: Callable):
    """What `make` gives, kept for the later tasks of a Python worker.

    Functions of this package travel by value, so its own modules cannot hold it.
    """
    kept = sys.modules.setdefault("_textvariety_kept", types.ModuleType("_textvariety_kept"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def give_back() -> None:
    """Hand a Python worker's free memory back to the system.

    A worker lives on through later stages, and what its allocators keep counts
    there; where the C library cannot trim, Arrow's pool alone is emptied.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def loose(chunk: str) -> bool:
    """Whether a chunk touches white space besides its single blanks."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class Cache:
    """Encoded chunks: little-endian 32-bit ids by chunk.

    `encode` turns a list of strings into such ids. Chunks are kept in two
    generations of at most `most` each (and what one stretch adds); those not
    asked for in a generation are forgotten, so memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int = MOST_CHUNKS):
        self._encode, self._most = encode, most
        # Chunks after a blank, and those of the generation before.
        self._inner: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        # Chunks at the start of a text.
        self._first: dict[str, bytes] = {}
        self._tails = dict(zip(TAILS, encode(list(TAILS))))

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """The ids of each text, texts of about STRETCH bytes at a time."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        before = np.cumsum([0, *pc.binary_length(texts).to_pylist()])
        start = 0
        while start < len(texts):
            end = max(int(np.searchsorted(before, before[start] + STRETCH)), start + 1)
            yield from self._stretch(texts.slice(start, end - start))
            start = end

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks that follow a blank, words without their last mark."""
        known, before = self._inner, self._before
        for c in chunks & before.keys():
            known[c] = before[c]
        new = chunks - known.keys()
        marked = [c for c in new if c[-1:] in self._tails and c[-2:-1].isalpha() and c[-2] < "\u0250"]
        words = {c[:-1] for c in marked}
        for c in words & before.keys():
            known[c] = before[c]
        asked = sorted((new.difference(marked) | words) - known.keys())
        known.update(zip(asked, self._encode([" " + c for c in asked])))
        for c in marked:
            known[c] = known[c[:-1]] + self._tails[c[-1]]

    def _stretch(self, texts: pa.Array) -> Iterator[bytes]:
        """Words become Python strings once for a stretch, however often they occur."""
        if len(self._inner) > self._most:
            self._inner, self._before = {}, self._inner
            self._first = {}
        cut = pc.split_pattern(texts, " ")
        words = cut.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], ends[:-1]])
        at, distinct = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        del words
        # A text with a part that touches white space is cut by the rule itself.
        odd = [not c or c[0].isspace() or c[-1].isspace() for c in distinct]
        marked = np.flatnonzero(np.logical_or.reduceat(np.array(odd)[at], starts)) if any(odd) else ()
        parts = {int(i): _SINGLE_BLANK.split(texts[int(i)].as_py()) for i in marked}
        new = {c for c, o in zip(distinct, odd) if not o}.union(*(p[1:] for p in parts.values()))
        self._learn(new - self._inner.keys())
        firsts = [distinct[i] for i in at[starts].tolist()]
        for i, p in parts.items():
            firsts[i] = p[0]
        new_firsts = sorted(set(firsts) - self._first.keys())
        self._first.update(zip(new_firsts, self._encode(new_firsts)))
        ids = [b"" if o else self._inner[c] for c, o in zip(distinct, odd)]
        for i, (first, start, end) in enumerate(zip(firsts, starts.tolist(), ends.tolist())):
            if i in parts:
                rest = map(self._inner.__getitem__, parts[i][1:])
            else:
                rest = map(ids.__getitem__, at[start + 1 : end].tolist())
            yield b"".join([self._first[first], *rest])
