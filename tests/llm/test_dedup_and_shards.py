import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
from pagewright.llm import near_join as paths
from pagewright.llm.exact_dedup import absorb, deduplicated, digest, exact_dedup
from pagewright.llm.near_join import by_blocks, cut_by_balls, leaves_of, near_deduplicated, near_join, runs_for
from pagewright.llm.sharding import shard_by_bytes


def test_exact_dedup_against_a_dictionary(odd, none):
    rows = odd.collect()
    found = exact_dedup(odd).collect()
    texts = Counter(digest(r.text) for r in rows)
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(texts)
    best = {}
    for r in rows:
        best[digest(r.text)] = max(best.get(digest(r.text), -1), -1 if r.doc_id is None else r.doc_id)
    for r in found:
        assert r.group_size == texts[r.text_sha256] and (r.keep_id if r.keep_id is not None else -1) == best[r.text_sha256]
    assert exact_dedup(none).count() == 0
    kept = deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len(texts) and deduplicated(none).count() == 0
    # a heavy digest: more rows than the summary's share, with few counters
    assert sorted(map(tuple, exact_dedup(odd, counters=2).select("doc_id", "kept").collect()), key=str) == sorted(((r.doc_id, r.kept) for r in found), key=str)


def test_misra_gries_keeps_what_is_frequent():
    held: dict = {}
    stream = ["a"] * 400 + [f"x{i}" for i in range(500)] + ["a"] * 100
    for i in range(0, len(stream), 50):
        held = absorb(held, list(Counter(stream[i : i + 50]).items()), 9)
        assert len(held) <= 9
    assert held["a"] >= 500 - len(stream) / 10


def brute(rows):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] | sets[j])
        if not both or len(sets[i] & sets[j]) / both >= 0.8:
            links[i] += 1
            links[j] += 1
            parent[max(top(i), top(j))] = min(top(i), top(j))
    return links, len({top(i) for i in range(len(rows))})


def test_near_join_against_all_pairs(spark, odd, none, small):
    for df in (odd, small):
        rows = df.collect()
        links, classes = brute(rows)
        found = near_join(df).collect()
        assert sorted((str(r.doc_id), n) for r, n in zip(rows, links, strict=True)) == sorted((str(r.doc_id), r.n_links) for r in found)
        kept = near_deduplicated(df)
        assert kept.columns == df.columns and kept.count() == classes
    assert near_join(none).count() == 0 and near_deduplicated(none).count() == 0


def test_near_join_over_blocks(spark):
    """One large group of near copies is cut into blocks and counted whole."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 50], f"new{i}", *base[i % 50 + 1 :]])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, _ = brute(df.collect())
    found = {r.doc_id: r.n_links for r in near_join(df, leaf=8, block=16).collect()}
    assert found == dict(enumerate(links))


def variant(rng, base, edits):
    words = list(base)
    for i in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}x{i}"
    return " ".join(words)


def test_near_join_by_balls(spark):
    """Two templates whose variants lie within and outside of the balls of pivots, with copies: links as by all pairs."""
    rng = random.Random(3)
    bases = [[f"{a}{i}" for i in range(150)] for a in "ab"]
    texts = [variant(rng, bases[k % 5 == 0], rng.choice([0, 1, 1, 1, 2, 3, 4, 6])) for k in range(240)]
    texts += texts[:20] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    rows = df.collect()
    links, classes = brute(rows)
    found = near_join(df, leaf=8, block=16).collect()
    assert {r.doc_id: n for r, n in zip(rows, links, strict=True)} == {r.doc_id: r.n_links for r in found}
    assert len({r.class_id for r in found}) == classes == near_deduplicated(df, leaf=8, block=16).count()


def test_a_ball_is_not_compared(spark):
    """Variants of one template that all lie in one ball: every pair is counted, none is compared."""
    made = spark.createDataFrame([(p, i, 3000) for p in (1, 2) for i in range(3000)], "path long, rep long, n long")
    owned = spark.range(2990).selectExpr("id AS rep", "7L AS ball")
    cut = cut_by_balls(made, owned, 64)
    met = by_blocks(cut, made.select("rep").distinct(), 64, lambda rows: [(len(rows), rows[0]["path"])], ["path", "lo", "hi", "block", "rep"], "n long, path long").collect()
    # the ten others meet each of the ball's blocks and themselves
    assert sum(r.n for r in met) == 2 * (2990 + 47 * 10 + 10) and max(r.n for r in met) <= 160
    whole = cut_by_balls(made, spark.range(3000).selectExpr("id AS rep", "7L AS ball"), 64)
    assert not by_blocks(whole, made.select("rep").distinct(), 64, lambda rows: [(len(rows),)], ["path", "lo", "hi", "rep"], "n long").collect()
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(i, variant(rng, base, 1)) for i in range(2500)], "doc_id long, text string").repartition(4)
    found = near_join(df).collect()
    assert len(found) == 2500 and all(r.n_links == 2499 and r.class_id == 0 for r in found)


def test_near_join_finds_pairs_at_the_threshold(spark):
    """10,000 sets with 500 planted pairs whose similarity is 0.80 to 0.85."""
    rng = random.Random(5)
    texts, pairs = [], 0
    for k in range(500):
        n = rng.randrange(60, 120)
        words = [f"p{k}w{i}" for i in range(n)]
        # with a tail of t words of its own: n - 4 of n - 4 + t shingles are shared
        t = rng.randrange(math.ceil((n - 4) * (1 / 0.85 - 1)), math.floor((n - 4) / 4) + 1)
        assert 0.8 <= (n - 4) / (n - 4 + t) <= 0.85
        texts += [" ".join(words), " ".join(words + [f"q{k}w{i}" for i in range(t)])]
        pairs += 1
    texts += [" ".join(rng.choice("red green blue bird tree cat mat sun moon sea".split()) for _ in range(40)) for _ in range(9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_join(df).collect()}
    assert [found[i] for i in range(2 * pairs)] == [(i - i % 2, 1) for i in range(2 * pairs)]


def test_paths_are_made_once_and_follow_the_group(spark, monkeypatch):
    """Below the first level no table of paths makes them anew for its sizes and its members, and a group four times as large makes some four times the rows."""
    plans, made = {}, {}

    def noted(df, name, keep=paths.keep):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Generate")
        out = keep(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(paths, "keep", noted)
    rng = np.random.default_rng(6)
    template = rng.integers(0, 1 << 32, paths.COORDINATES, dtype=np.uint32)
    rows = []
    for i in range(800):
        own = rng.integers(0, 1 << 32, paths.COORDINATES, dtype=np.uint32)
        rows.append((i, bytearray(np.where(rng.random(paths.COORDINATES) < 0.6, template, own).tobytes())))
    totals = []
    for n in (200, 800):
        plans.clear(), made.clear()
        leaves_of(spark.createDataFrame(rows[:n], "rep long, sample binary"), 8, 4, 8)
        assert sum(k.startswith("paths-") for k in plans) == 4
        assert not any(v for k, v in plans.items() if k.startswith("paths-") and k != "paths-1")
        totals.append(sum(v for k, v in made.items() if k.startswith("steps-")))
    assert 200 < totals[0] and totals[1] < 6 * totals[0]


def test_runs_reach_the_recall():
    assert runs_for(0.9, 0.8, 2) < runs_for(0.9999, 0.8, 2) < runs_for(0.9999, 0.8, 4)


def test_shards_are_even_and_gapless(odd, none, small):
    for df in (odd, small):
        rows = shard_by_bytes(df, 8).collect()
        sizes, slots = Counter(), {}
        for r in rows:
            sizes[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(rows) == df.count() and set(sizes) <= set(range(8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(sizes.values()) <= sum(sizes.values()) / 8 + max(r.size for r in rows)
    assert shard_by_bytes(none, 8).count() == 0


def test_digest_lowers_ascii_only():
    assert digest("ÀB") == hashlib.sha256("Àb".encode()).hexdigest() and digest(None) == digest("")
