"""Importance resampling towards a target corpus, over inverted postings partitioned by bucket.

Features of a text are its runs of one to ``LONGEST`` words; each falls into one of ``buckets`` buckets by its checksum.

1. Texts become inverted postings: a row for each bucket and block of documents, with the documents' places in the block
   and how often each holds the bucket. A block has at most ``BLOCK`` documents and a few megabytes of text, so a row is bounded
   and a bucket that every document holds has as many rows as any other.
2. Counts of both corpora are grouped by bucket, a row each, and meet there: a bucket's gain is computed from its own
   two counts. Gains are one row a bucket, at most ``buckets``, so they may be broadcast.
3. Postings are shuffled to (group of buckets, salt of blocks). Each task turns postings into gains times counts and adds them up
   by document before they go on, so a document is sent once for each group of buckets, not once for each posting.
4. Sums are reduced by document; the mean gain is the document's weight. Noise from a hash of the id is added
   (Gumbel's, so the highest scores are a draw without replacement), and the highest scores are drawn.

Ranks need no sorted whole: scores are integers in a range that is bounded by the logarithms of the counts (some 10^5 values), so a
count for each score gives the rank at which it begins; within one score rows are ranked by id. The noise spreads even equal
texts, no score holds over 1 / 2718 of the distinct ids.

Defined results: a null text has no words, a document without words has weight 0; a null id counts as the empty text in the hash and
comes after any other id; rows that repeat are ranked side by side; empty corpora give weights of 0 or an empty result; further columns
are ignored. Blocks are named by the task that makes them, and are written before they are shuffled: a lost executor
costs tasks, not the agreement of blocks.
"""

from __future__ import annotations

from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.hashes import portions
from pagewright.llm.shared import keep

#: Documents of a block at most; places in it fit 15 bits.
BLOCK = 1 << 15
#: Bytes of text of a block; a longer text is a block of its own.
AT_ONCE = 4_000_000
#: Groups of buckets that postings are partitioned by, before salts.
GROUPS = 16
#: Features that a task of the shuffled postings should get.
PER_TASK = 4_000_000
#: Letters and digits of ASCII, lower-cased, and all bytes beyond ASCII; any other byte ends a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(words: list[bytes], counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and every pair of neighbours; counts[i] words are document i's."""
    doc = np.repeat(np.arange(len(counts)), counts)
    one = list(map(crc32, words))
    two = np.fromiter(map(crc32, map(b" ".__add__, islice(words, 1, None)), one), np.int64, max(0, len(words) - 1))
    within = doc[1:] == doc[:-1]
    bucket = np.concatenate([np.array(one, np.int64), two[within]]) % buckets
    return bucket, np.concatenate([doc, doc[1:][within]])


def inverted(df: DataFrame, text_col: str, id_col: str | None = None, buckets: int = 10_000, block_rows: int = BLOCK) -> DataFrame:
    """Postings (bucket, block, n, docs, counts); a block's row of bucket -1 holds its ids and words of each document."""
    one = df.select(F.col(text_col).cast("string").alias("text"), *([F.col(id_col).alias("id")] if id_col else []))
    id_type = one.schema["id"].dataType.simpleString() if id_col else "long"

    def work(batches):
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for begin, data, offsets in _blocks(b.column(0), block_rows):
                low, at = data.tobytes().translate(_WORDS), offsets.tolist()
                words: list[bytes] = []
                counts = np.empty(len(at) - 1, np.int64)
                for i in range(len(counts)):
                    found = low[at[i] : at[i + 1]].split()
                    counts[i] = len(found)
                    words += found
                bucket, doc = features(words, counts, buckets)
                key, times = np.unique(bucket * BLOCK + doc, return_counts=True)
                bucket, doc = key // BLOCK, key % BLOCK
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.empty(0, np.int64)
                starts = np.concatenate([[0], first, [len(key)]]).astype(np.int32)  # the block's own row has no postings
                total = np.add.reduceat(times, first) if len(first) else first
                n = len(first)
                own = np.concatenate([[0], np.full(n + 1, len(counts))]).astype(np.int32)
                ids = b.column(1).slice(begin, len(counts)) if id_col else pa.nulls(len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([[-1], bucket[first]]).astype(np.int32)), pa.array(np.full(n + 1, block)),
                        pa.array(np.concatenate([[0], total]).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(doc.astype(np.int16))),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(times.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(own), ids), pa.ListArray.from_arrays(pa.array(own), pa.array(counts)),
                    ],
                    ["bucket", "block", "n", "docs", "counts", "ids", "words"],
                )
                block += 1

    schema = f"bucket int, block long, n long, docs array<smallint>, counts array<int>, ids array<{id_type}>, words array<long>"
    return one.mapInArrow(work, schema)


def _blocks(texts: pa.Array, rows: int):
    for part in range(0, len(texts), rows):
        for begin, data, offsets in portions(texts.slice(part, rows), AT_ONCE):
            yield part + begin, data, offsets


def bucket_gains(held: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of each bucket that the corpus ``held`` has; both are postings."""
    both = held.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(wanted.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    own = keep(both.filter("bucket >= 0").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = own.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = f"(t + 1D) * ({total.s}D + {buckets}) / ((s + 1D) * ({total.t}D + {buckets}))"
    return own.filter("s > 0").select("bucket", F.expr(f"cast(floor(1000 * ln({ratio})) as long)").alias("gain"))


def importance(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of its features' gains) of every row of ``df``."""
    postings = keep(inverted(df, text_col, id_col, buckets), "postings")
    gains = bucket_gains(postings, inverted(target, target_text, None, buckets), buckets)
    n = postings.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    salts = max(1, -(-n // (GROUPS * PER_TASK)))
    place = F.col("bucket") % GROUPS * F.lit(salts) + F.pmod(F.xxhash64("block"), F.lit(salts))
    shuffled = postings.filter("bucket >= 0").select("bucket", "block", "docs", "counts").repartitionById(GROUPS * salts, place.cast("int"))
    each = shuffled.join(F.broadcast(gains), "bucket").select("block", "gain", F.inline(F.arrays_zip("docs", "counts")))
    sums = each.groupBy("block", F.col("docs").cast("int").alias("place")).agg(F.sum(F.col("gain") * F.col("counts")).alias("total"))
    rows = postings.filter("bucket = -1").select("block", F.posexplode(F.arrays_zip("ids", "words")).alias("place", "own"))
    rows = rows.select("block", "place", F.col("own.ids").alias("doc_id"), F.col("own.words").alias("n_words"))
    scored = rows.join(sums, ["block", "place"], "left").withColumn("n_features", F.expr("greatest(2 * n_words - 1, 0L)"))
    weight = F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)")
    return scored.select("doc_id", "n_words", "n_features", weight.alias("weight"))


def drawn(weighted: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank; rank is null where the row is not among the highest scores."""
    spark = weighted.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.expr("cast(floor(-1000 * ln(-ln((h + 0.5D) / 4294967296D))) as long)")
    columns = ["doc_id", "n_features", "weight", "score"]
    scored = weighted.withColumn("h", h).withColumn("score", F.col("weight") + noise)
    scored = keep(scored.select(*columns, (F.col("n_words") >= least_words).alias("may")), "scored")
    per = sorted(((r.score, r.n) for r in scored.filter("may").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    quota = percent * sum(n for _, n in per) // 100
    before, above = [], 0
    for score, n in per:
        if above >= quota:
            break
        before.append((score, above))
        above += n
    begins = spark.createDataFrame(before, "score long, above long")  # one row for each score: integers within the logarithms of the counts
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    top = scored.filter("may").join(F.broadcast(begins), "score").withColumn("rank", F.col("above") + F.row_number().over(order))
    low = scored.join(F.broadcast(begins.withColumn("drawable", F.lit(True))), "score", "left").filter("not may or drawable is null")
    rank = F.expr(f"if(rank <= {quota}, cast(rank as long), null)").alias("rank")
    return top.select(*columns, rank).unionByName(low.select(*columns, F.lit(None).cast("long").alias("rank")))

