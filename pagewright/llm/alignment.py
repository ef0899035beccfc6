"""Alignment of two tokenizers' tokens over the same bytes, by a sweep over their ends.

1. Every text is encoded by both. A token's end, the byte offset behind it, is an event. A document's events of one side and one
   window of ``WINDOW`` bytes are one packed row: ids alone, since a vocabulary's table of byte lengths gives the ends.
2. Rows of both sides are united, repartitioned by document and sorted within partitions by document, window and side.
3. A machine streams through them. Its state is the open group: the tokens since the last offset at which tokens of both sides end,
   and running counts and digests of the document. Where both end, a group closes; between two neighbouring ends of any side lies
   exactly one overlapping pair of tokens, a link.
4. The machine writes blocks of documents: results, and for each document its distinct linked id pairs with how often they are linked.
   Each block asks for the counts of its distinct pairs: one row for each (block, pair), joined with the pairs' corpus-wide counts on the
   pair. The answers meet the block again, and give each document its sums.

A frequent pair has one row for each block, not for each document, and no pair's rows outnumber the blocks. Blocks hold a bounded number of
links, but for a longer document. An open group is as long as the texts' tokenizations disagree.

Defined results: texts that are null, empty, or that one of the tokenizers changes have no tokens and zeros; a null id is carried;
rows that repeat are documents of their own; an empty table gives an empty result; further columns are ignored. Documents are named by the
place of their row in the table as it is read, so lost executors read the same names again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pagewright.llm.shared import keep
from pagewright.llm.tokens import REMEMBERED, Encoder, _byte_characters, _rows

#: Bytes of a window of a document.
WINDOW = 1 << 16
#: Bytes of text that are encoded at once.
AT_ONCE = 4_000_000
#: Tokens after which the machine works on what it has read.
TOKENS = 1_000_000
#: Links of a block of documents, about.
LINKS = 2_000_000


def plain_encoder(path: str) -> Encoder:
    """A byte-level encoder to which special tokens' strings are plain text."""
    own = Encoder(path)
    own.special, own.whole.encode_special_tokens = "", True
    return own


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary: one for each character of its piece."""
    own, stand_ins = Tokenizer.from_file(path), set(_byte_characters().values())
    pieces = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())]
    return np.array([len(p) if set(p) <= stand_ins else len(p.encode()) for p in pieces], np.int64)


class Pieces:
    """Exact ids of a byte-fallback piece model, with encoded stretches remembered.

    No piece of such a vocabulary goes on after a space mark that follows another character, so a stretch of spaces and the letters
    behind it is encoded alone. A vocabulary with such a piece is given whole texts.
    """

    def __init__(self, path: str):
        self.own = SentencePieceProcessor(model_file=path)
        n = self.own.get_piece_size()
        pieces = [self.own.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.lead = len(self.own.encode("a"))
        self.stretch = regex.compile(" +[^ ]*")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 21, np.uint16), 0
        self.starts, self.sizes = np.empty(REMEMBERED + 1, np.int64), np.empty(REMEMBERED + 1, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        """Encode and remember stretches; one that the model changes has size -1."""
        encoded = self.own.encode(["a" + s for s in stretches], num_threads=1)
        for s, found in zip(stretches, encoded, strict=True):
            found = found[self.lead :]
            k, n = len(self.known), len(found)
            same = b"".join(map(self.bytes.__getitem__, found)) == s.encode()
            while self.used + n > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            if k == len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
            self.ids[self.used : self.used + n] = found
            self.starts[k], self.sizes[k] = self.used, n if same else -1
            self.used += n
            self.known[s] = k

    def _slots(self, stretches: list[str]) -> np.ndarray:
        self._learn([s for s in dict.fromkeys(stretches) if s not in self.known])
        return np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))

    def _whole(self, text: str) -> tuple[np.ndarray, bool]:
        found = self.own.encode(text)
        return np.array(found, np.uint16), b"".join(map(self.bytes.__getitem__, found)) == (" " + text).encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, their offsets, and whether a text came through unchanged (changed ones have no ids)."""
        if len(self.known) >= REMEMBERED:
            self.forget()
        if not self.apart:
            done = [self._whole(t) for t in texts.to_pylist()]
            parts = [ids if good else ids[:0] for ids, good in done]
            return np.concatenate([np.empty(0, np.uint16), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.array([g for _, g in done], bool)
        odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        coded = split.flatten().dictionary_encode()
        plain = self._slots([" " + w for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy().astype(np.int64)]
        per_plain = np.diff(split.offsets.to_numpy().astype(np.int64))
        strange = [self.stretch.findall(" " + t) for t in texts.filter(pa.array(odd)).to_pylist()]
        others = self._slots([s for x in strange for s in x])
        # put the stretches of plain and of odd texts into the order of the texts
        per = np.empty(len(texts), np.int64)
        per[~odd], per[odd] = per_plain, [len(x) for x in strange]
        ends = np.cumsum(per)
        slots = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        of_odd = np.repeat(odd, per)
        slots[~of_odd], slots[of_odd] = plain, others
        sizes = self.sizes[slots]
        text = np.repeat(np.arange(len(texts)), per)
        good = np.bincount(text, sizes < 0, len(texts)) == 0
        used = good[text]
        ids, at = _rows(self.ids, self.starts[slots[used]], sizes[used])
        counts = np.bincount(text[used], sizes[used], len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)]), good


_held: dict = {}


def _tool(kind, given):
    """The worker's own encoder, table or compressor; later tasks of the worker find it there."""
    if (kind, given) not in _held:
        _held[kind, given] = kind(given)
    return _held[kind, given]


def packed(x: np.ndarray) -> bytes:
    """Low and high bytes apart, compressed."""
    return _tool(zstandard.ZstdCompressor, 3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(_tool(zstandard.ZstdDecompressor, None).decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


EVENTS = "doc long, doc_id {id}, size long, win int, side tinyint, ids binary"


def events(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The end events of both sides, a packed row for each document, window and side; a document without tokens has size 0."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        names = ["doc", "doc_id", "size", "win", "side", "ids"]
        place = TaskContext.get().partitionId() << 33
        a, lengths_a = _tool(plain_encoder, a_path), _tool(byte_lengths, a_path)
        b = _tool(Pieces, b_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            until = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(texts):
                done = until[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(until, done + AT_ONCE, "right")))
                some = texts.slice(begin, end - begin)
                ids_a, at_a = a.encode(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), some, pa.scalar(" ", pa.large_string())))
                ids_b, at_b, good = b.encode(some.cast(pa.string()) if until[end - 1] - done < 1 << 31 else some)
                size = 1 + pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
                ends_a, ends_b = _ends(lengths_a, ids_a, at_a), _ends(b.lengths, ids_b, at_b)
                good &= (size > 1) & (_sums(lengths_a, ids_a, at_a) == size)
                out: list[list] = [[], [], [], [], []]
                for i in range(end - begin):
                    for side, ids, ends, at in ((0, ids_a, ends_a, at_a), (1, ids_b, ends_b, at_b)):
                        if not good[i]:
                            if side == 0:
                                _add(out, i, 0, 0, 0, b"")
                            continue
                        x, w = ids[at[i] : at[i + 1]], (ends[at[i] : at[i + 1]] - 1) // WINDOW
                        cuts = np.flatnonzero(np.diff(w)) + 1
                        for p, q in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True):
                            _add(out, i, int(size[i]), int(w[p]), side, packed(x[p:q].astype(np.uint16)))
                at = np.array(out[0], np.int64)
                kinds = (pa.int64(), pa.int32(), pa.int8(), pa.binary())
                own = [pa.array(v, k) for v, k in zip(out[1:], kinds, strict=True)]
                doc_ids = batch.column(0).slice(begin, end - begin).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(place + begin + at), doc_ids, *own], names)
                begin = end
            place += len(texts)

    return rows.mapInArrow(work, EVENTS.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _add(out: list[list], *values) -> None:
    for held, v in zip(out, values, strict=True):
        held.append(v)


def _ends(lengths: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each token's end within its text."""
    total = np.concatenate([[0], np.cumsum(lengths[ids])])
    return total[1:] - np.repeat(total[at[:-1]], np.diff(at))


def _sums(lengths: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(lengths[ids])])
    return np.diff(total[at])


class Digits:
    """Ids in decimal, each with the mark that follows it, as one run of bytes."""

    def __init__(self):
        n = np.arange(1 << 16)
        self.size = 1 + (n >= 10).astype(np.int64) + (n >= 100) + (n >= 1000) + (n >= 10_000)
        powers = 10 ** np.clip(self.size[:, None] - 1 - np.arange(5), 0, None)
        self.table = (n[:, None] // powers % 10 + 48).astype(np.uint8)

    def text(self, ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes, and the end of each id's part."""
        size = self.size[ids]
        grid = np.concatenate([self.table[ids], np.zeros((len(ids), 1), np.uint8)], 1)
        grid[np.arange(len(ids)), size] = marks
        return grid[np.arange(6) <= size[:, None]].tobytes(), np.cumsum(size + 1)


class Sweep:
    """The machine. Documents follow each other on one line of offsets, so a document's end closes its last group."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], pairs_of: int):
        self.lengths, self.pairs_of, self.digits = lengths, pairs_of, Digits()
        self.docs: list[list] = []  # [doc_id, begin, end] of documents that are not done
        self.waiting: tuple[list, list] = ([], [])  # ids that are read and not yet swept
        self.last = [0, 0]  # where each side's swept tokens end
        self.base, self.doc = 0, None
        self.open: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.held = 0
        self.running: dict | None = None  # of a document that goes on

    def read(self, doc: int, doc_id, size: int, side: int, ids: bytes) -> None:
        if doc != self.doc:
            self.docs.append([doc_id, self.base, self.base + size])
            self.base, self.doc = self.base + size, doc
        if size:
            x = unpacked(ids, np.uint16)
            self.waiting[side].append(x)
            self.held += len(x)

    def sweep(self) -> tuple[list[dict], np.ndarray]:
        """Close all groups that are complete: results of the documents done, and (document, pair, times) of these."""
        ids, ends = [], []
        for side in (0, 1):
            x = np.concatenate([self.open[side], *self.waiting[side]]).astype(np.int64)
            ids.append(x)
            ends.append(self.last[side] + np.cumsum(self.lengths[side][x]))
            self.waiting[side].clear()
        common = np.intersect1d(*ends, assume_unique=True)
        closed = [int(np.searchsorted(e, common[-1], "right")) if len(common) else 0 for e in ends]
        self.open = tuple(x[k:] for x, k in zip(ids, closed, strict=True))
        (a, end_a), (b, end_b) = ((x[:k], e[:k]) for x, e, k in zip(ids, ends, closed, strict=True))
        reach = int(common[-1]) if len(common) else self.last[0]
        # which documents these tokens belong to; empty ones have none
        stop = np.array([d[2] for d in self.docs], np.int64)
        at_a, at_b, at_g = (np.searchsorted(e, stop, "right") for e in (end_a, end_b, common))
        bounds = np.union1d(end_a, end_b)
        at_l = np.searchsorted(bounds, stop, "right")
        pair = a[np.searchsorted(end_a, bounds)] * self.pairs_of + b[np.searchsorted(end_b, bounds)]
        text, cut = self._text(a, end_a, b, end_b, common)
        closing = np.searchsorted(common, stop, "right")  # a document's groups in the text
        out, first = [], [0] * 5
        finished = int(np.searchsorted(stop, reach, "right")) if len(stop) else 0
        order = []
        for i in range(len(self.docs)):
            now = [int(at_a[i]), int(at_b[i]), int(at_g[i]), int(at_l[i]), int(cut[closing[i]])]
            if now == first and i >= finished:
                break
            r = self.running or {"doc_id": self.docs[i][0], "n": np.zeros(4, np.int64), "sha": hashlib.sha256(), "pairs": []}
            self.running = None
            r["n"] += np.subtract(now[:4], first[:4])
            done, size = i < finished, self.docs[i][2] - self.docs[i][1]
            r["sha"].update(text[first[4] : now[4] - (1 if done and size else 0)])  # no mark after the last group
            if done:
                r["hex"] = r["sha"].hexdigest() if size else ""
                out.append(r)
                order.append((first[3], now[3], r.pop("pairs")))
            else:
                r["pairs"].append(np.unique(pair[first[3] : now[3]], return_counts=True))
                self.running = r
            first = now
        self.docs = self.docs[finished:]
        self.last, self.held = [reach, reach], sum(map(len, self.open))
        return out, _tallied(pair, order)

    def _text(self, a, end_a, b, end_b, common) -> tuple[bytes, np.ndarray]:
        """All groups' text, each with a mark behind it, and where each group begins in it, and the end."""
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        upto_a = np.searchsorted(group_a, np.arange(len(common) + 1))  # tokens of groups before
        upto_b = np.searchsorted(group_b, np.arange(len(common) + 1))
        n = len(a) + len(b)
        ids, marks = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[np.arange(len(a)) + upto_b[group_a]] = a
        ids[np.arange(len(b)) + upto_a[group_b + 1]] = b
        marks[upto_a[1:] + upto_b[:-1] - 1], marks[upto_a[1:] + upto_b[1:] - 1] = ord("|"), ord(";")
        text, ends = self.digits.text(ids, marks)
        return text, np.concatenate([[0], ends])[upto_a + upto_b]


def _tallied(pair: np.ndarray, order: list) -> np.ndarray:
    """(document, pair, times), three rows of numbers, of documents whose pairs are pair[first:last] and the tallies held."""
    keys, times = [], []
    spans = [(k, p, q) for k, (p, q, _) in enumerate(order) if q > p]
    if spans:
        lo, hi = spans[0][1], spans[-1][2]
        doc = np.repeat([k for k, _, _ in spans], [q - p for _, p, q in spans])
        keys.append(doc << 36 | pair[lo:hi])
        times.append(np.ones(hi - lo, np.int64))
    for k, (_, _, held) in enumerate(order):
        for codes, n in held:
            keys.append(np.int64(k) << 36 | codes)
            times.append(n)
    if not keys:
        return np.empty((3, 0), np.int64)
    if len(keys) == len(spans[:1]):  # no tallies held
        key, n = np.unique(keys[0], return_counts=True)
    else:
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, np.concatenate(times)).astype(np.int64)
    return np.stack([key >> 36, key & ((1 << 36) - 1), n])


def swept(rows: DataFrame, a_path: str, b_path: str, pairs_of: int) -> DataFrame:
    """Blocks of documents. A block's own row (pair null) has its results as arrays, and the documents' pairs as packed places among the
    block's distinct pairs; its further rows (pair, n) say how many of its documents link a pair."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches):
        machine = Sweep((_tool(byte_lengths, a_path), _tool(Pieces, b_path).lengths), pairs_of)
        block, docs, tallies, links = TaskContext.get().partitionId() << 32, [], [], 0
        id_arrow = None
        for batch in batches:
            id_arrow = batch.column("doc_id").type
            columns = [batch.column(c).to_pylist() for c in ("doc", "doc_id", "size", "side", "ids")]
            for row in zip(*columns, strict=True):
                if row[0] != machine.doc and (machine.held > TOKENS or len(machine.docs) > 20_000):
                    links += _keep(machine, docs, tallies)
                    if links > LINKS or len(docs) > 50_000:
                        yield _block(block, docs, tallies, id_arrow)
                        block, docs, tallies, links = block + 1, [], [], 0
                elif machine.held > 4 * TOKENS and row[3] == 0:  # a long document: a window is complete
                    links += _keep(machine, docs, tallies)
                machine.read(*row)
        if id_arrow is not None:
            _keep(machine, docs, tallies)
            yield _block(block, docs, tallies, id_arrow)

    schema = (
        f"block long, pair long, n int, doc_ids array<{id_type}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "groups_sha256 array<string>, held array<long>, places binary, times binary"
    )
    return rows.repartition("doc").sortWithinPartitions("doc", "win", "side").mapInArrow(work, schema)


def _keep(machine: Sweep, docs: list, tallies: list) -> int:
    found, tally = machine.sweep()
    tally[0] += len(docs)
    docs += found
    tallies.append(tally)
    return int(tally[2].sum())


def _block(block: int, docs: list[dict], tallies: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
    doc, pair, times = np.concatenate(tallies, 1) if tallies else np.empty((3, 0), np.int64)
    codes, place, n = np.unique(pair, return_inverse=True, return_counts=True)
    counts = np.bincount(doc, minlength=len(docs))
    numbers = np.stack([d["n"] for d in docs], 1) if docs else np.empty((4, 0), np.int64)
    k = len(codes)
    one = lambda values: pa.array([values] + [None] * k)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k + 1, block)), pa.array([None, *codes.tolist()], pa.int64()), pa.array([0, *n.tolist()], pa.int32()),
            pa.array([[d["doc_id"] for d in docs]] + [None] * k, pa.list_(id_type)), *(one(x.tolist()).cast(pa.list_(pa.int64())) for x in numbers),
            pa.array([[d["hex"] for d in docs]] + [None] * k, pa.list_(pa.string())), one(counts.tolist()).cast(pa.list_(pa.int64())),
            pa.array([packed(place.astype(np.uint32))] + [None] * k, pa.binary()), pa.array([packed(times.astype(np.uint32))] + [None] * k, pa.binary()),
        ],
        ["block", "pair", "n", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "places", "times"],
    )


def aligned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(results by document, pair counts): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a, b, docs, best."""
    pairs_of = SentencePieceProcessor(model_file=b_path).get_piece_size()
    if max(pairs_of, Tokenizer.from_file(a_path).get_vocab_size()) > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    blocks = keep(swept(events(df, a_path, b_path, id_col, text_col), a_path, b_path, pairs_of), "swept")
    asked = blocks.filter("pair is not null").select("block", "pair", "n")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("docs")).withColumn("a", F.expr(f"pair div {pairs_of}"))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # an id has at most the other vocabulary's partners
    counts = keep(counts.join(most, "a").select("pair", "a", F.expr(f"pair % {pairs_of}").alias("b"), "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")
    answers = asked.select(F.col("block").alias("asker"), "pair").join(counts.select("pair", "docs", "best"), "pair")
    columns = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "places", "times"]
    id_type = df.schema[id_col].dataType.simpleString()

    def settle(own: pa.Table, answer: pa.Table) -> pa.Table:
        row = {c: own.column(c)[0] for c in columns}
        answer = answer.sort_by("pair")
        docs, best = (answer.column(c).to_numpy() for c in ("docs", "best"))
        place = unpacked(row["places"].as_py(), np.uint32) if answer.num_rows else np.empty(0, np.uint32)
        times = unpacked(row["times"].as_py(), np.uint32).astype(np.int64) if answer.num_rows else np.empty(0, np.int64)
        held = np.array(row["held"].as_py(), np.int64)
        upto = np.concatenate([[0], np.cumsum(held)])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((times * best[place], times * docs[place]) if len(place) else (times, times))]
        n_best, count_sum = (np.diff(x[upto]) for x in sums)
        values = {c: row[c].values for c in columns[:6]} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.table(values)

    schema = f"doc_ids {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    own = blocks.filter("pair is null").select("block", *columns)
    result = own.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(settle, schema)
    return result.withColumnRenamed("doc_ids", "doc_id"), counts.select("a", "b", "docs", "best")
