"""Log-likelihoods of whole documents under a gated recurrent language model fitted on the corpus.

1. Texts are tokenised in portions; a portion keeps its distinct words (64-bit hashes) once, with their
   counts in training documents, and its texts as codes into them.
2. The counts of all words of all training documents are summed by a shuffle of (portion, word) rows, and
   brought back to the portions; no vocabulary passes through the driver but the most frequent words.
3. Each portion's texts become symbols where its codes and counts meet.
4. The network is fitted on all training documents, dealt by hash to shards of about ``SHARD_TOKENS`` words:
   one shard first, then all shards side by side from there, their parameters averaged.
5. Each portion's symbols are scored.

The chance of a text is the product of its words' and its end's. Words are in the network's head, or repeated
(a form class by their first two bytes, then their share of its counts), or rare; the rare class is shared
between words seen once and those never seen by the counts of words seen once and twice.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; null, empty and blank
texts are their end alone; without training documents the network keeps its first weights; rows that
repeat score alike; null ids count as the empty text in the hash; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import gru
from pagewright.llm.hashes import Words, mixed, portions
from pagewright.llm.shared import crc_of_id, keep

#: Bytes of text of a portion.
PORTION = 12_000_000
#: Words of a shard of the training documents.
SHARD_TOKENS = 2_000_000
#: Sums of parameters that the driver adds up.
NODES = 8
#: Words of a text's part in training; scoring runs through whole texts.
PART = 4096
LOG10 = math.log(10)


def tokenised(df: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """One row for each portion."""
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")
    )

    def encode(batches):
        task, k = TaskContext.get().partitionId() << 24, 0
        shrink = zstandard.ZstdCompressor(level=1).compress
        ids, held, hashes, forms, sizes, held_bytes = [], [], [], [], [], 0

        def portion():
            word, code = np.unique(np.concatenate(hashes), return_inverse=True)
            form = np.zeros(len(word), np.int8)
            form[code] = np.concatenate(forms)
            n = np.concatenate(sizes)
            train = np.repeat(~np.concatenate(held), n)
            counts = np.bincount(code[train], minlength=len(word))
            row = {
                "portion": task + k, "doc_ids": pa.concat_arrays(ids).to_pylist(), "held_out": np.concatenate(held), "sizes": n.astype(np.int32),
                "codes": shrink(code.astype(np.uint32).tobytes()), "words": word.astype(np.int64), "forms": form, "counts": counts.astype(np.int32),
            }
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in ENCODED], schema=ENCODED)

        for b in batches:
            out_of = b.column(1).to_numpy(zero_copy_only=False)
            for begin, data, offsets in portions(b.column(2)):
                w = Words(data, offsets)
                ids.append(b.column(0).slice(begin, len(w.counts)))
                held.append(out_of[begin : begin + len(w.counts)])
                hashes.append(w.hash)
                first_two = mixed(w.spans(w.start, np.minimum(w.start + 2, w.end)))
                forms.append((first_two % np.uint64(gru.FORMS)).astype(np.int8))
                sizes.append(w.counts)
                held_bytes += len(data)
                if held_bytes >= PORTION:
                    yield portion()
                    ids, held, hashes, forms, sizes, held_bytes = [], [], [], [], [], 0
                    k += 1
        if sizes:
            yield portion()

    return rows.mapInArrow(
        encode, "portion long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, codes binary, words array<long>, forms array<tinyint>, counts array<int>"
    )


ENCODED = pa.schema([
    ("portion", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()),
    ("words", pa.list_(pa.int64())), ("forms", pa.list_(pa.int8())), ("counts", pa.list_(pa.int32())),
])


class Counts:
    """What the driver knows of the corpus: totals, the head words, and the form classes' totals."""

    def __init__(self, vocabulary: DataFrame, documents: int):
        sums = vocabulary.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
        words, distinct, self.once, twice = (int(x or 0) for x in sums)
        self.documents = documents
        self.tokens, self.distinct = words + documents, distinct + (documents > 0)
        self.head = vocabulary.filter("c > 1").orderBy(F.desc("c"), "word").limit(gru.HEAD - 1).select("word", "c", "form").collect()
        self.forms = np.zeros(gru.FORMS)
        for r in vocabulary.filter("c > 1").groupBy("form").agg(F.sum("c").alias("n")).collect():
            self.forms[r.form] = r.n
        for r in self.head:
            self.forms[r.form] -= r.c
        self.unseen = self.once / (self.once + 2 * twice) if self.once else 1.0

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def shares(self, symbol: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural log of each word's share of its class, where that is fixed."""
        out = np.zeros(len(symbol))
        form = (symbol >= gru.HEAD) & (symbol < gru.RARE)
        out[form] = np.log(c[form] / self.forms[symbol[form] - gru.HEAD])
        rare = symbol == gru.RARE
        known = np.log((1 - self.unseen) / self.once) if self.once and self.unseen < 1 else 0.0
        out[rare] = np.where(c[rare] > 0, known, math.log(self.unseen))
        return out


def fitted(coded: DataFrame, counts: Counts) -> dict:
    """The network's parameters, fitted on every training text."""
    spark = coded.sparkSession
    start = gru.started(np.array([counts.documents, *(r.c for r in counts.head)], float), counts.forms, counts.once)
    if not counts.documents:
        return start
    shards = max(1, round(counts.tokens / SHARD_TOKENS))

    def fit_from(rows: DataFrame, flat: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast(flat)

        def fit(key, pdf):
            pdf = pdf.sort_values(["hash", "doc_id", "at"])
            got = [np.frombuffer(s, np.int16) for s in pdf["symbols"]]
            order = np.random.default_rng(int(key[0])).permutation(len(got))
            texts = [got[i].astype(np.int64) for i in order]
            p = gru.packed(gru.train(gru.unpacked(held.value), texts))
            return pd.DataFrame({"node": [int(key[0]) % NODES], "n": [sum(map(len, texts))], "params": [p.tobytes()]})

        return rows.groupBy("shard").applyInPandas(fit, "node int, n long, params binary")

    def averaged(fits: DataFrame) -> np.ndarray:
        def add(key, pdf):
            total = sum(np.frombuffer(x, np.float32) * np.float64(n) for x, n in zip(pdf["params"], pdf["n"], strict=True))
            return pd.DataFrame({"n": [int(pdf["n"].sum())], "params": [total.tobytes()]})

        rows = keep(fits.groupBy("node").applyInPandas(add, "n long, params binary"), "averages").collect()  # NODES at most
        n = sum(r.n for r in rows)
        return (sum(np.frombuffer(bytes(r.params)) for r in rows) / n).astype(np.float32) if n else gru.packed(start)

    parts = training_parts(coded, shards)
    flat = averaged(fit_from(parts.filter("shard = 0"), gru.packed(start)))
    if shards > 1:
        flat = averaged(fit_from(parts.repartition(spread_over(shards), "shard"), flat))
    return gru.unpacked(flat)


def spread_over(groups: int) -> int:
    """Partitions for so many groups: two for each, in large tables fewer, with the root of their number, so that a task takes many in turn."""
    return max(1, min(2 * groups, 64 * math.isqrt(max(1, groups))))


def training_parts(coded: DataFrame, shards: int) -> DataFrame:
    """shard, hash, doc_id, at and symbols (16 bits each) of every part of every training text; a part's shard is drawn by its hash."""

    def cut(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for r in range(b.num_rows):
                symbols = np.frombuffer(grow(b.column(3)[r].as_py()), np.int16)
                ids, held, sizes = (b.column(i)[r].values for i in range(3))
                ends = np.cumsum(sizes.to_numpy())
                doc, at, own = [], [], []
                for i in np.flatnonzero(~held.to_numpy(zero_copy_only=False)).tolist():
                    begin, end = int(ends[i - 1]) if i else 0, int(ends[i])
                    for k in range(begin, end, PART):
                        doc.append(i)
                        at.append(k - begin)
                        own.append(symbols[k : min(k + PART, end)].tobytes())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc, pa.int64())), pa.array(at, pa.int32()), pa.array(own, pa.binary())], ["doc_id", "at", "symbols"])

    own = coded.select("doc_ids", "held_out", "sizes", "symbols").mapInArrow(cut, "doc_id long, at int, symbols binary")
    rank = F.xxhash64("doc_id", "at", "symbols")
    return own.select(F.pmod(rank, F.lit(shards)).cast("int").alias("shard"), rank.alias("hash"), "doc_id", "at", "symbols")


CODED = (
    "doc_ids array<long>, held_out array<boolean>, sizes array<int>, symbols binary, known array<long>, base array<double>, share array<double>"
)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = df.sparkSession
    held_out = crc_of_id(id_col) % 5 == 1 if held_out is None else held_out
    encoded = keep(tokenised(df, id_col, text_col, held_out), "encoded")
    each = encoded.select("portion", F.explode(F.arrays_zip("words", "forms", "counts")).alias("w")).select(
        "portion", F.col("w.words").alias("word"), F.col("w.forms").alias("form"), F.col("w.counts").alias("n")
    )
    counted = keep(each.groupBy("word").agg(F.sum("n").alias("c"), F.first("form").alias("form")), "counted")
    trained = encoded.select(F.sum(F.size(F.filter("held_out", lambda x: ~x))).alias("n")).first().n or 0
    counts = Counts(counted, int(trained))
    head = spark.createDataFrame([(r.word, i + 1) for i, r in enumerate(counts.head)], "word long, place int")
    symbol = F.when(F.col("place").isNotNull(), F.col("place")).when(F.col("c") > 1, F.col("form") + F.lit(gru.HEAD)).otherwise(F.lit(gru.RARE))
    vocabulary = counted.join(F.broadcast(head), "word", "left").select("word", "c", symbol.cast("short").alias("symbol"))  # HEAD rows at most
    held = spark.sparkContext.broadcast(counts)

    portions_ = max(1, encoded.count())
    spread = spread_over(portions_)
    known = each.select("portion", "word").join(vocabulary, "word").select(F.col("portion").alias("of"), "word", "c", "symbol").repartition(spread, "of")
    texts = encoded.select("portion", "doc_ids", "held_out", "sizes", "codes", "words").repartition(spread, "portion")

    def code(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts = held.value
        r = left.iloc[0]
        code = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["codes"]), np.uint32)
        order = np.argsort(right["word"].to_numpy().view(np.uint64))  # words are in this order in the portion
        c, symbol = right["c"].to_numpy()[order], right["symbol"].to_numpy()[order].astype(np.int64)
        n = np.asarray(r["sizes"], np.int64)
        last = np.cumsum(n + 1) - 1  # a text's end, after its words
        is_word = np.ones(int(n.sum()) + len(n), bool)
        is_word[last] = False
        first = last - n
        symbols = np.zeros(len(is_word), np.int16)
        symbols[is_word] = symbol[code]

        def sums(of_word: np.ndarray, of_end: float) -> np.ndarray:
            x = np.full(len(is_word), float(of_end))
            x[is_word] = of_word[code]
            return np.add.reduceat(x, first)

        return pd.DataFrame({
            "doc_ids": [[None if x is None or x != x else int(x) for x in r["doc_ids"]]], "held_out": [np.asarray(r["held_out"], bool)],
            "sizes": [(n + 1).astype(np.int32)], "symbols": [zstandard.ZstdCompressor(level=1).compress(symbols.tobytes())],
            "known": [sums(c > 0, counts.documents > 0).astype(np.int64)], "base": [sums(counts.base(c), counts.base(np.array(counts.documents)))],
            "share": [sums(counts.shares(symbol, c), 0.0)],
        })

    coded = keep(texts.groupBy("portion").cogroup(known.groupBy("of")).applyInPandas(code, CODED), "coded")
    params = spark.sparkContext.broadcast(fitted(coded, counts))

    def scored(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k in range(b.num_rows):
                ids, held_out, sizes, known, base, share = (b.column(i)[k].values for i in (0, 1, 2, 4, 5, 6))
                symbols = np.frombuffer(grow(b.column(3)[k].as_py()), np.int16).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy())])
                score = np.add.reduceat(gru.score(params.value, symbols, offsets).astype(float), offsets[:-1]) + share.to_numpy()
                n = pa.array(np.full(len(ids), held.value.tokens))
                yield pa.RecordBatch.from_arrays([ids, held_out, sizes.cast(pa.int64()), known, n, base, pa.array(score / LOG10)], [x.split()[0] for x in SCORES.split(", ")])

    return coded.mapInArrow(scored, SCORES)
