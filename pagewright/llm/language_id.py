"""Language identification in two steps: the family first, then the languages within it.

A text is a vector of hashed runs of one, two and three bytes (lower-cased), square roots of shares. Families
come from a table of language codes; a code that is not in it is a family of its own. A linear
one-versus-rest support vector machine picks the family, one-versus-one machines vote on the language within
it. Every machine is fitted in a task of its own on a bounded sample (``SAMPLE`` rows in all, shared evenly
by the languages); weights are broadcast, a few numbers per pair of related languages. The sample is drawn from
ids, hashes and languages before any text moves, and a drawn text goes on as its profile, never longer than BUCKETS.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and when nothing can be
learned; null languages teach nothing; ties of votes go to the larger sum of margins, then to the language
that sorts first; rows that repeat are answered alike; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.hashes import portions
from pagewright.llm.sampling import bounded_sample, marked, texts_of
from pagewright.llm.shared import crc_of_id, keep

BUCKETS = 4096
SAMPLE = 4_000
UNKNOWN = "und"
#: Language families by code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), f"only {lang}")


def profiles(texts: pa.Array) -> np.ndarray:
    """One row of BUCKETS numbers (and a constant) for each text, of length 1 before the constant."""
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)
    out[:, BUCKETS] = 1
    for begin, data, offsets in portions(pc.utf8_lower(pc.fill_null(texts, ""))):
        n = len(offsets) - 1
        text = np.repeat(np.arange(n), np.diff(offsets))
        b = data.astype(np.uint32)
        counts = np.zeros(n * BUCKETS)
        run = b.copy()
        for size in (1, 2, 3):
            if size > 1:
                run = run[:-1] * np.uint32(257) + b[size - 1 :]
            h = ((run + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(20)
            own = text[: len(h)]
            same = own == text[size - 1 :]
            counts += np.bincount(own[same] * BUCKETS + h[same], minlength=n * BUCKETS)
        counts = np.sqrt(counts.reshape(n, BUCKETS))
        counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
        out[begin : begin + n, :BUCKETS] = counts
    return out


def packed(profile: np.ndarray) -> bytes:
    """The buckets of a profile that are not 0, then their numbers."""
    at = np.flatnonzero(profile[:BUCKETS])
    return at.astype(np.uint16).tobytes() + profile[at].tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The profiles of packed rows."""
    out = np.zeros((len(rows), BUCKETS + 1), np.float32)
    out[:, BUCKETS] = 1
    for r, row in enumerate(rows):
        n = len(row) // 6
        out[r, np.frombuffer(row, np.uint16, n)] = np.frombuffer(row, np.float32, n, 2 * n)
    return out


def machine(x: np.ndarray, sign: np.ndarray, cost: float = 30.0, steps: int = 150) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by accelerated gradient descent."""
    w = np.zeros(x.shape[1], np.float32)
    look, t = w.copy(), 1.0
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32) * cost
    rate = 1 / (1 + 4 * cost)
    for _ in range(steps):
        short = np.maximum(0, 1 - sign * (x @ look))
        new = look - rate * (look - 2 * (x.T @ (weight * sign * short)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = (new + (t - 1) / t_new * (new - w)).astype(np.float32)
        w, t = new.astype(np.float32), t_new
    return w


class Machines:
    """All weights. families: names; inner: per family its languages, and its pairs' weights in order."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.families = sorted({family_of(x) for x in languages})
        self.inner = {f: sorted(x for x in languages if family_of(x) == f) for f in self.families}
        none = np.zeros(BUCKETS + 1, np.float32)
        self.outer = np.stack([weights.get(f"family {f}", none) for f in self.families], 1) if languages else None
        self.pairs = {f: np.stack([weights.get(f"pair {a} {b}", none) for a, b in combinations(own, 2)], 1) if len(own) > 1 else None for f, own in self.inner.items()}

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = texts.cast(pa.large_string())
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.outer is None:
            return names, score
        for at in range(0, len(texts), 512):
            here = texts.slice(at, 512)
            x = profiles(here)
            outer = x @ self.outer
            chosen = outer.argmax(1)
            sure = 1 / (1 + np.exp(-4 * outer.max(1))) if len(self.families) > 1 else np.ones(len(here))
            for k, f in enumerate(self.families):
                rows = np.flatnonzero((chosen == k) & letters[at : at + 512])
                if not len(rows):
                    continue
                own = self.inner[f]
                best, held = np.zeros(len(rows), int), np.ones(len(rows))
                if len(own) > 1:
                    margin = x[rows] @ self.pairs[f]
                    votes, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
                    for j, (a, b) in enumerate(combinations(range(len(own)), 2)):
                        votes[:, a] += margin[:, j] >= 0
                        votes[:, b] += margin[:, j] < 0
                        sums[:, a] += np.clip(margin[:, j], -1, 1)
                        sums[:, b] -= np.clip(margin[:, j], -1, 1)
                    best = (votes + sums / (4 * len(own))).argmax(1)
                    held = 1 / (1 + np.exp(-4 * sums[np.arange(len(rows)), best] / (len(own) - 1)))
                for r, j, s in zip(rows.tolist(), best.tolist(), held.tolist(), strict=True):
                    names[at + r], score[at + r] = own[j], sure[r] * s
        return names, score


def language_machines(labelled: DataFrame, most: int = SAMPLE) -> Machines:
    """Fit on at most ``most`` rows of ``labelled`` (doc_id, text, lang); a row that is there twice is one row."""
    spark = labelled.sparkSession
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    names = ["doc_id", "mark", "lang"]
    drawn = keep(bounded_sample(marked(known, "lang").distinct(), "lang", most, ["doc_id", "mark"]), "drawn")

    def profiled(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                made = pa.array([packed(x) for x in profiles(part.column(3).cast(pa.large_string()))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], made], [*names, "profile"])

    found = texts_of(known.select("doc_id", F.xxhash64("text").alias("mark"), "text"), drawn).select(*names, "text")
    once = found.mapInArrow(profiled, found.drop("text").schema.add("profile", "binary")).groupBy(*names).agg(F.first("profile").alias("profile"))
    rows = keep(once, "language-sample")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    families = {f: [x for x in languages if family_of(x) == f] for f in {family_of(x) for x in languages}}
    jobs = [(f"family {f}", x, 1 if x in own else -1) for f, own in families.items() for x in languages if len(families) > 1]
    jobs += [(f"pair {a} {b}", x, s) for own in families.values() for a, b in combinations(own, 2) for x, s in ((a, 1), (b, -1))]
    if not jobs:
        return Machines(languages, {})
    tasks = spark.createDataFrame(jobs, "job string, lang string, sign int")

    def trained(key, pdf):
        pdf = pdf.sort_values(["doc_id", "mark"])
        return pa_frame(key[0], machine(unpacked(pdf["profile"].tolist()), pdf["sign"].to_numpy(np.float32)))

    def pa_frame(job, w):
        import pandas as pd

        return pd.DataFrame({"job": [job], "weights": [w.tobytes()]})

    made = rows.join(F.broadcast(tasks), "lang").groupBy("job").applyInPandas(trained, "job string, weights binary")
    return Machines(languages, {r.job: np.frombuffer(bytes(r.weights), np.float32) for r in keep(made, "machines").collect()})


def identify(df: DataFrame, machines: Machines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    held = df.sparkSession.sparkContext.broadcast(machines)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def predicted(batches):
        for b in batches:
            names, score = held.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")


def language_id(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learns from rows that are not held out."""
    held_out = crc_of_id() % 4 == 2
    learn = df.filter(~held_out).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(df, language_machines(learn)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
