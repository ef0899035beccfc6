"""Similarity joins and longest common substrings against plain loops."""

import random
import time
from itertools import combinations

import pytest
from pagewright.functions.text import longest_common_length
from pagewright.operators import similarity
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, old[j + 1] + 1, old[j] + (x != y)))
    return row[-1]


def test_longest_common_against_all_substrings():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 14))) for _ in range(2))
        want = max((j - i for i in range(len(a) + 1) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
        assert longest_common_length(a, b) == want, (a, b)


def test_longest_common_of_a_long_body():
    rng = random.Random(6)
    body = "".join(rng.choices("abcdefghij klmno", k=1_000_000))
    heard = body[500_000:500_300] + "".join(rng.choices("xyz", k=2000)) + body[7000:7400]
    began = time.time()
    assert longest_common_length(heard, body) == 400
    assert longest_common_length("a" * 20_000 + "b", "a" * 60_000) == 20_000
    assert time.time() - began < 10  # a second alone; others may use the cores


@pytest.mark.parametrize("most", [3, 5000])
@pytest.mark.parametrize("measure, least", [("jaccard", 0.5), ("jaccard", 1.0), ("dice", 0.7)])
def test_similar_sets(spark, measure, least, most):
    rng = random.Random(7)
    texts = [" ".join(["the", *rng.sample("a b c d e f g h".split(), rng.randint(0, 5))]) for _ in range(60)] + ["the"] * 3 + ["", "the a", "a the"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {(r.a, r.b): r.similarity for r in similarity.similar_sets(df, "t", F.filter(F.split("t", " "), lambda x: x != ""), least, measure, most).collect()}
    want = {}
    for a, b in combinations(sorted(set(texts)), 2):
        x, y = set(a.split()), set(b.split())
        s = (len(x & y) / len(x | y) if measure == "jaccard" else 2 * len(x & y) / (len(x) + len(y))) if x and y else 0
        if s >= least:
            want[a, b] = s
    assert got == pytest.approx(want) and len(want) > 1


@pytest.mark.parametrize("most", [2, 5000])
def test_similar_texts(spark, most):
    rng = random.Random(8)
    texts = {"chapter " + "".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(40)} | {"", "x", "CHAPTER ab"}
    df = spark.createDataFrame([(t, i) for i, t in enumerate(sorted(texts))], "title string, pos int")
    rows = similarity.similar_texts(df.select("title"), df, 0.85, most).collect()
    got = {(r.title, r.near): r.similarity for r in rows}
    want = {(a, b): s for a in texts for b in texts if a != b and (s := 1 - distance(a.lower(), b.lower()) / max(len(a), len(b))) >= 0.85}
    assert len(rows) == len(got) and got == pytest.approx(want) and len(want) > 10


def test_similar_texts_are_met_once_and_in_many_tasks(spark):
    """Titles of few words share most pieces; their pairs are not made distinct, and the join's tasks are as many as are asked for."""
    words = ["large ring", "small ring", "hot bolt", "cold bolt"]
    texts = [f"{w} {k} Brand#{b}" for w in words for k in ("LARGE", "PROMO") for b in range(7, 18)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "title string, pos int")
    found = similarity.similar_texts(df.select("title"), df)
    rows = [(r.title, r.near) for r in found.collect()]
    want = {(a, b) for a in texts for b in texts if a != b and 1 - distance(a.lower(), b.lower()) / max(len(a), len(b)) >= 0.85}
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "Aggregate [title" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert similarity.split_join(df, df.withColumnRenamed("pos", "at"), ["title"]).rdd.getNumPartitions() == 4


def test_split_join_equals_a_join(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(50)] + [(9, 1), (None, 2)], "k int, x int")
    right = spark.createDataFrame([(i % 3, -i) for i in range(40)] + [(8, 1), (None, 2)], "k int, y int")
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "x", "y").collect())
    assert rows(similarity.split_join(left, right, ["k"], 4)) == rows(left.join(right, "k"))
