"""Words, spans and sets of a batch of texts, as arrays over the batch's bytes.

A prefix polynomial over the lower-cased bytes (wrapping 64-bit arithmetic, odd base) gives the hash of
any span from two prefixes and a power of the base's inverse; nothing is done word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on whole.
AT_ONCE = 1_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i up to n."""
    if len(_tables[0]) <= n:
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, AT_ONCE) + 1, b, np.uint64)
            steps[0] = 1
            _tables[k] = np.cumprod(steps)
    return _tables[0], _tables[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of h over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def portions(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + at_once, "right")) - 1)
        yield begin, data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


class Words:
    """The words of a portion: hash, the text's index, first and last byte's offsets, of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        low = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
        space = (low == 32) | ((low >= 9) & (low <= 13))
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n + 1, bool)
        before[1:] = space
        before |= edge
        after = np.ones(n + 1, bool)
        after[:n] = space
        after |= edge
        self.start = np.flatnonzero(~space & before[:n])
        self.end = np.flatnonzero(~space & after[1:]) + 1
        self.low, self.offsets = low, offsets
        pow_, self._inverse = powers(n)
        self._prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * pow_[:n], out=self._prefix[1:])
        self.hash = self.spans(self.start, self.end)
        #: words of text i are those from first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._prefix[end] - self._prefix[start]) * self._inverse[start])


def text_hash(word: str) -> int:
    """The hash that Words gives a word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hash[0])


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Each text's ascending distinct hashes of runs of ``size`` words.

    Fewer words make one run of all of them; no words make the empty set.
    """
    step = np.uint64(0xA0761D6478BD642F)
    for _, data, offsets in portions(texts):
        w = Words(data, offsets)
        h = w.hash
        run = h[: max(0, len(h) - size + 1)].copy()
        for j in range(1, size):
            run = run * step + h[j : j + len(run)]
        run = mixed(run)
        for a, n in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
            if n >= size:
                yield np.unique(run[a : a + n - size + 1])
            elif n:
                all_of_it = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in h[a : a + n]:
                        all_of_it = all_of_it * step + x
                yield mixed(np.array([all_of_it]))
            else:
                yield np.empty(0, np.uint64)
