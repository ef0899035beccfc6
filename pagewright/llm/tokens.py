"""Exact token ids by the tokenizers library, with encoded pieces remembered.

BPE vocabularies encode each piece of the pre-tokenizer alone, so the ids of a text are those of its
pieces in turn, and a corpus has far fewer distinct pieces than pieces. A batch is cut at single
spaces and dictionary-encoded by Arrow; each distinct word is pre-tokenized once a batch, and only
pieces not met before are given to the library's model. Texts where a cut at a space could change the
pieces (two white-space characters in a row) are pre-tokenized whole, and texts that hold the string of a special
token, which the library makes one id of, are left to the library. The memory is bounded.

Two pre-tokenizers are known: the byte-level one with its usual pattern, and the lower-casing one that
drops white space. For a file with any other pre-tokenizer every text goes to the library whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: The two pre-tokenizers' patterns.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOWERED = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: White space by any library's reading, so that a text without two in a row has none by each reading.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pieces after which the memory starts anew.
REMEMBERED = 700_000
#: Bytes of text that are encoded at once.
AT_ONCE = 4_000_000


def _byte_characters() -> dict[int, str]:
    """Each byte's printable stand-in: itself where Latin-1 prints it, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _rows(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[starts[i] : starts[i] + sizes[i]] in a row, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)], offsets


class Encoder:
    """encode(texts) gives the ids of all texts in a row and the offsets of each."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values())
        self.model = self.whole.model
        split = str(self.whole.pre_tokenizer)
        self.lowered = split.startswith("Sequence") and LOWERED in split.replace("\\\\", "\\")
        self.known = self.lowered or split.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in split
        self.pattern = regex.compile(LOWERED + "| " if self.lowered else BYTE_LEVEL)
        self.table = _byte_characters()
        self.pieces: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.pieces.clear()
        self.ids, self.used = np.empty(1 << 21, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 19, np.int64), np.empty(1 << 19, np.int64)
        if self.lowered:  # a space stands between words and has no ids
            self.pieces[" "], self.starts[0], self.lengths[0] = 0, 0, 0

    def _normal(self, text: str) -> str:
        if not self.lowered:
            return text
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # a final sigma is lowered like any other

    def _slot(self, piece: str) -> int:
        """Where a new piece's ids are, after the model has made them."""
        found = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]
        k, n = len(self.pieces), len(found)
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(n, len(self.ids)), np.uint32)])
        if k == len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + n] = found
        self.starts[k], self.lengths[k] = self.used, n
        self.used += n
        self.pieces[piece] = k
        return k

    def _slots(self, pieces: list[str]) -> np.ndarray:
        get, slot = self.pieces.get, self._slot
        return np.fromiter((slot(x) if k is None else k for x in pieces for k in (get(x),)), np.int64, len(pieces))

    def _encode(self, text: str) -> np.ndarray:
        """Ids of one text by way of its pieces."""
        at = self._slots(self.pattern.findall(self._normal(text)))
        return _rows(self.ids, self.starts[at], self.lengths[at])[0]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and offsets of words, each taken with a space before it."""
        plain = [bool(w) and not (w[0].isspace() or w[-1].isspace()) for w in words]
        pieces = self.pattern.findall(self._normal("".join(" " + w for w, ok in zip(words, plain, strict=True) if ok)))
        at = self._slots(pieces)
        first = np.flatnonzero(np.fromiter((x[0] == " " for x in pieces), bool, len(pieces)))  # a word's first piece
        ids, offsets = _rows(self.ids, self.starts[at], self.lengths[at])
        offsets = np.append(offsets[first], offsets[-1])
        if all(plain):
            return ids, offsets
        known = iter(np.split(ids, offsets[1:-1]) if any(plain) else [])
        found = [next(known) if ok else self._encode(" " + w) for w, ok in zip(words, plain, strict=True)]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts in which a cut at each space changes nothing."""
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        flat, at = self._words(words)
        if not self.lowered:  # a text's first word has no space before it
            heads = code[ends[:-1]]
            first, code[ends[:-1]] = np.unique(heads, return_inverse=True)
            code[ends[:-1]] += len(words)
            own = [self._encode(words[i]) for i in first.tolist()]
            flat = np.concatenate([flat, *own])
            at = np.concatenate([at, at[-1] + np.cumsum([len(x) for x in own])])
        ids, offsets = _rows(flat, at[code], np.diff(at)[code])
        return ids, offsets[ends]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32, offsets int64 with one more entry than texts); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + AT_ONCE, "right")))
            if len(self.pieces) >= REMEMBERED:
                self._forget()
            ids, offsets = self._some(texts.slice(begin, end - begin).cast(pa.string()))
            parts.append(ids)
            counts.append(np.diff(offsets))
            begin = end
        if not parts:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.known:
            found = self._library(texts.to_pylist())
        else:
            matches = lambda pattern, **how: pc.match_substring_regex(texts, pattern, **how).to_numpy(zero_copy_only=False)
            special = matches(self.special, ignore_case=True) if self.special else np.zeros(len(texts), bool)
            odd = special if self.lowered else special | matches(SPACES + "{2}")
            if not odd.any():
                return self._simple(texts)
            if not odd.all():
                ids, offsets = self._simple(texts.filter(pa.array(~odd)))
                simple = iter(np.split(ids, offsets[1:-1]))
            given = zip(texts.to_pylist(), special, odd, strict=True)
            found = [self._library([t])[0] if s else self._encode(t) if o else next(simple) for t, s, o in given]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        return np.concatenate([np.asarray(x, np.uint32) for x in found]), offsets


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file; later tasks of the worker find its memory warm."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
