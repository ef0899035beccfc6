"""A counterfactual-regularised toxicity classifier.

A text is the set of its words and of their first four and five bytes, each hashed to ``BUCKETS`` features.
Features whose counts in toxic and other training texts differ beyond chance carry their log ratio of
odds; a logistic regression then weighs these. For every training text that names an identity group, the
text with each such term swapped for the next of its kind is made too, and the squared change of the
score is penalised, so that naming one group rather than another does not move the score.

The fit sees at most ``SAMPLE`` labelled rows, drawn by id before any text is read; one task gets their features,
never their texts. The weights (BUCKETS numbers) are broadcast and every whole text is scored where it lies.

Defined results: null, empty and blank texts have no features and score the intercept; without both labels
among the training rows every score is the share of toxic ones (0 without any); a label given twice for a
document counts twice, nulls do not count; rows that repeat score alike and count as often in the fit; further
columns are ignored, and kept by ``not_toxic`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.hashes import Words, mixed, portions, text_hash
from pagewright.llm.sampling import bounded_sample, marked, texts_of
from pagewright.llm.shared import crc_of_id, fresh, keep

BUCKETS = 1 << 18
#: Most labelled rows that the fit sees.
SAMPLE = 16_000
THRESHOLD = 0.3
COUNTERFACTUAL = 4.0
#: Standard deviations from chance from which a feature counts.
BEYOND = 4.5
PREFIXES = (4, 5)
#: Kinds of identity terms; a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def word_features(w: Words) -> np.ndarray:
    """Features of each word: itself and its first bytes (the word again where it is as short)."""
    cols = [w.hash]
    for n in PREFIXES:
        cols.append(mixed(w.spans(w.start, np.minimum(w.start + n, w.end)) + np.uint64(n)))
    return (np.stack(cols, 1) >> np.uint64(40)).astype(np.int64) % BUCKETS


def term_features(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    return word_features(Words(data, np.array([0, len(data)])))[0]


def presence(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, by text."""
    f = word_features(w)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    keys = np.unique((text[:, None] * BUCKETS + f).ravel())
    return keys // BUCKETS, keys % BUCKETS


def swapped(w: Words, text: np.ndarray, feature: np.ndarray, kinds) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By text with identity terms: features that go, features that come."""
    to = {text_hash(a): (term_features(a), term_features(b)) for kind in kinds for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}
    known = np.fromiter(to, np.uint64, len(to))
    out = {}
    for i in np.unique(np.searchsorted(w.first, np.flatnonzero(np.isin(w.hash, known)), "right") - 1).tolist():
        own = w.hash[w.first[i] : w.first[i + 1]]
        pairs = [to[int(h)] for h in np.unique(own[np.isin(own, known)])]
        gone, come = (np.unique(np.concatenate(x)) for x in zip(*pairs, strict=True))
        out[i] = np.setdiff1d(gone, come), np.setdiff1d(come, feature[text == i])
    return out


def features_of(texts: pa.Array, kinds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text its features, and those that go and come when its identity terms are swapped."""
    none = np.empty(0, np.int32)
    for _, data, offsets in portions(texts):
        w = Words(data, offsets)
        text, feature = presence(w)
        swaps = swapped(w, text, feature, kinds)
        ends = np.searchsorted(text, np.arange(len(w.counts) + 1))
        for i in range(len(w.counts)):
            gone, come = swaps.get(i, (none, none))
            yield feature[ends[i] : ends[i + 1]].astype(np.int32), gone.astype(np.int32), come.astype(np.int32)


def chosen(there: np.ndarray, both: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Each feature's log ratio of odds, 0 where its count in toxic texts is no further from chance than ``BEYOND``.

    Chance is that of the rows drawn; the odds compare rates within each label, however many of it were drawn.
    """
    expected = both * (n1 / n)
    spread = np.sqrt(np.maximum(expected * (1 - n1 / n), 0.25))
    odds = np.log((there + 0.5) / (n1 + 1)) - np.log((both - there + 0.5) / (n - n1 + 1))
    return np.where(np.abs(there - expected) > BEYOND * spread, odds, 0.0)


def descend(rows: list[tuple], toxic: np.ndarray, stands_for: np.ndarray, scale: np.ndarray, counterfactual: float) -> tuple[float, np.ndarray]:
    """(intercept, a weight for each feature) from the rows' (features, gone, come)."""
    n = len(rows)
    kept = [[x[scale[x] != 0] for x in r] for r in rows]
    row = np.repeat(np.arange(n), [len(r[0]) for r in kept])
    used, col = np.unique(np.concatenate([r[0] for r in kept]), return_inverse=True)
    own = scale[used]
    number = np.full(BUCKETS, -1, np.int64)
    number[used] = np.arange(len(used))
    swaps = [r for r in kept if len(r[1]) or len(r[2])]  # where no feature that counts moves, nothing is penalised
    change_row, change_col, change = [], [], []
    for k, (_, gone, come) in enumerate(swaps):
        for features, sign in ((gone, -1.0), (come, 1.0)):
            at = number[features]
            at = at[at >= 0]
            change_row.append(np.full(len(at), k))
            change_col.append(at)
            change.append(np.full(len(at), sign))
    change_row, change_col, change = (np.concatenate(x) if x else np.empty(0, int) for x in (change_row, change_col, change))
    change = change * own[change_col]
    values = own[col]
    share = stands_for / stands_for.sum()
    weight, bias, m_w, v_w, m_b, v_b = np.zeros(len(used)), prior(float(share @ toxic)), 0.0, 0.0, 0.0, 0.0
    for step in range(1, 301):  # Adam over the whole sample
        score = bias + np.bincount(row, values * weight[col], n)
        slope = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - toxic) * share
        grad = np.bincount(col, values * slope[row], len(used)) + 1e-4 * weight
        if swaps:
            moved = np.bincount(change_row, change * weight[change_col], len(swaps))
            grad += 2 * counterfactual * np.bincount(change_col, change * moved[change_row], len(used)) / len(swaps)
        g_b = slope.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * grad, 0.99 * v_w + 0.01 * grad**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.99 * v_b + 0.01 * g_b**2
        one, two = 1 - 0.9**step, 1 - 0.99**step
        weight = weight - 0.05 * (m_w / one) / (np.sqrt(v_w / two) + 1e-8)
        bias = bias - 0.05 * (m_b / one) / (np.sqrt(v_b / two) + 1e-8)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = weight * own
    return float(bias), out


def prior(share: float) -> float:
    return float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))


def counted(features: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each feature the toxic texts and all texts that have it."""
    all_of = [np.concatenate([f for f, y in zip(features, toxic, strict=True) if y >= least] or [np.empty(0, np.int32)]) for least in (1, 0)]
    return tuple(np.bincount(x, minlength=BUCKETS) for x in all_of)


def fit(texts: pa.Array, toxic: np.ndarray, kinds=IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL, stands_for: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(intercept, a weight for each feature); each text counts as ``stands_for`` labelled rows (1 each by default)."""
    n, n1 = len(toxic), int(toxic.sum())
    if n1 in (0, n):
        return prior(n1 / n if n else 0.0), np.zeros(BUCKETS, np.float32)
    rows = list(features_of(texts, kinds))
    scale = chosen(*counted([r[0] for r in rows], toxic), n, n1)
    return descend(rows, toxic, np.ones(n) if stands_for is None else stands_for, scale, counterfactual)


def scores(texts: pa.Array, bias: float, weights: np.ndarray) -> np.ndarray:
    """The model's chance of toxicity for each text."""
    out = np.empty(len(texts))
    for begin, data, offsets in portions(texts):
        w = Words(data, offsets)
        f = word_features(w)
        n, score = len(w.counts), np.full(len(w.counts), bias)
        some = np.flatnonzero((weights[f] != 0).any(1))  # few features weigh anything
        if len(some):
            text = np.searchsorted(w.first, some, "right") - 1
            keys = np.unique((text[:, None] * BUCKETS + f[some]).ravel())
            score += np.bincount(keys // BUCKETS, weights[keys % BUCKETS], n)
        out[begin : begin + n] = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    return out


def toxicity_model(
    labelled: DataFrame, texts: DataFrame | None = None, most: int = SAMPLE, kinds=IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL
) -> tuple[float, np.ndarray]:
    """Fit on at most ``most`` rows of ``labelled``: (doc_id, text, toxic), or (doc_id, mark, toxic) with ``texts`` (doc_id, mark, text).

    The sample is drawn from ids, marks and labels; only its texts are then fetched, and made into features where
    they lie. The counts of features are summed by a shuffle, and one task fits on the features that count. A
    sampled row stands for as many rows as its label has for each sampled one, so that scores keep the rate of
    toxic rows of all of ``labelled``.
    """
    if texts is None:
        labelled, texts = marked(labelled, "toxic"), labelled.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    keys = keep(labelled.groupBy("doc_id", "mark", "toxic").agg(F.count("*").alias("copies")), "labelled")
    drawn = keep(bounded_sample(keys, "toxic", most, ["doc_id", "mark"]), "drawn")
    totals = {r.toxic: r.n for r in keys.groupBy("toxic").agg(F.sum("copies").alias("n")).collect()}  # two labels
    held = {r.toxic: (r.n, r.copies) for r in drawn.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()}
    if len(held) < 2:
        return prior(totals.get(1, 0) / max(1, sum(totals.values()))), np.zeros(BUCKETS, np.float32)
    names = ["doc_id", "mark", "toxic", "copies"]

    def extracted(batches):
        for b in batches:
            rows = list(features_of(b.column(4), kinds))
            made = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], [*names, "features", "gone", "come"])

    found = texts_of(texts, drawn).select(*names, "text")
    shape = found.drop("text").schema.add("features", "binary").add("gone", "binary").add("come", "binary")
    once = found.mapInArrow(extracted, shape).groupBy("doc_id", "mark", "toxic").agg(*[F.first(c).alias(c) for c in ("copies", "features", "gone", "come")])
    rows = keep(once, "features")  # a document that is there twice is one row

    def sums(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            total += counted([np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()], b.column(0).to_numpy())
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["feature", "there", "both"])

    counts = rows.select("toxic", "features").mapInArrow(sums, "feature long, there long, both long")
    counts = counts.groupBy("feature").agg(F.sum("there").alias("there"), F.sum("both").alias("both")).toArrow()  # BUCKETS rows at most
    there, both = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    there[counts["feature"].to_numpy()], both[counts["feature"].to_numpy()] = counts["there"].to_numpy(), counts["both"].to_numpy()
    scale = rows.sparkSession.sparkContext.broadcast(chosen(there, both, sum(n for n, _ in held.values()), held[1][0]))

    def fewer(batches):
        for b in batches:
            own = [[np.frombuffer(x, np.int32) for x in b.column(k).to_pylist()] for k in (4, 5, 6)]
            cut = [pa.array([x[scale.value[x] != 0].tobytes() for x in f], pa.binary()) for f in own]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cut], b.schema.names)

    def task(batches):
        t = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        toxic = t["toxic"].to_numpy().astype(float)
        copies = t["copies"].to_numpy().astype(float)
        stands_for = copies * np.where(toxic > 0, totals[1] / held[1][1], totals[0] / held[0][1])
        own = zip(*([np.frombuffer(x, np.int32) for x in t[k].to_pylist()] for k in ("features", "gone", "come")), strict=True)
        bias, weights = descend(list(own), toxic, stands_for, scale.value, counterfactual)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([weights.tobytes()], pa.binary())], ["bias", "weights"])

    some = rows.select(*names, "features", "gone", "come").mapInArrow(fewer, shape)
    model = keep(some.repartition(1).mapInArrow(task, "bias double, weights binary"), "toxicity-model").first()
    return model.bias, np.frombuffer(bytes(model.weights), np.float32)


def score_toxicity(df: DataFrame, model: tuple[float, np.ndarray], text_col: str = "text", out: str = "score") -> DataFrame:
    """df with the column ``out`` added, in place of one of that name."""
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def scored(batches):
        for b in batches:
            rest = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores(b.column(b.num_columns - 1), *held.value))], [*b.schema.names[:-1], out])

    text = F.col(text_col).cast("string")
    own = [c for c in df.columns if c.lower() != out.lower()]
    rows = df.select(*[F.col(f"`{c}`") for c in own], text.alias(fresh(df, "text")[0]))
    schema = df.select(*[F.col(f"`{c}`") for c in own]).schema.add(out, "double")
    return rows.mapInArrow(scored, schema)


def fitted(df: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray]:
    """The model of labelled documents that are not held out (crc32 of the id modulo 4 is not 2)."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    texts = df.select("doc_id", F.col("text").cast("string").alias("text")).filter(crc_of_id() % 4 != 2)
    return toxicity_model(marked(texts).join(own, "doc_id"), texts.select("doc_id", F.xxhash64("text").alias("mark"), "text"))


def toxicity(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``df``."""
    model = fitted(df, labels)
    rows = df.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "text")
    return score_toxicity(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def not_toxic(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the classifier does not reject, with their columns."""
    (out,) = fresh(df, "toxicity")
    scored = score_toxicity(df, fitted(df, labels), out=out)
    return scored.filter(F.col(out) < threshold).drop(out)
