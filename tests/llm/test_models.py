import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pagewright.llm import gru, toxicity
from pagewright.llm.fingerprints import Marks, Prefixes, anchors, code_points, edited_fingerprints, edited_text, likeness
from pagewright.llm.hashes import Words, text_hash
from pagewright.llm.language_id import language_id
from pagewright.llm.lm_scoring import lm_scores


def test_word_hashes_depend_on_the_word_alone():
    data = "Ab  cd\tAB é".encode()
    w = Words(np.frombuffer(data, np.uint8), np.array([0, 3, len(data)]))
    assert w.counts.tolist() == [1, 3] and w.hash[0] == w.hash[2] == text_hash("ab") and w.hash[3] == text_hash("é")


def test_languages_are_told_apart(spark, odd, none):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.lang_pred for r in language_id(odd).collect()}
    assert by_id[4] == by_id[5] == by_id[None] == "und" and set(by_id.values()) <= {"und", "en", "de", "fr"}
    assert language_id(none).count() == 0


def test_toxicity_and_its_edge_cases(spark, odd, none, labels):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = toxicity.toxicity(df, labels).join(labels, "doc_id").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.6 * sum(r.toxic for r in rows)
    assert toxicity.toxicity(odd, labels).count() == odd.count() and toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.not_toxic(odd, labels).columns == odd.columns


def test_swapping_identity_terms_moves_the_score_less():
    texts, toxic = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(" ".join(["some", f"n{i % 7}", "women" if bad or i % 5 == 0 else "men", *(["vile", "scum"] if bad and i % 8 else []), "say", "things"]))
        toxic.append(float(bad))
    gap = []
    for strength in (0.0, 20.0):
        model = toxicity.fit(pa.array(texts), np.array(toxic), counterfactual=strength)
        s = toxicity.scores(pa.array(["women say things", "men say things", "vile scum say things"]), *model)
        gap.append(abs(s[0] - s[1]))
    assert gap[1] < 0.5 * gap[0] and s[2] > 0.5


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.started(np.arange(1, 200)[::-1].astype(float), np.ones(gru.FORMS), 5).items()}
    x, y, h = rng.integers(0, gru.RARE, (5, 3)), rng.integers(0, 190, (5, 3)), rng.normal(size=(3, gru.HIDDEN))
    x[2, 1] = gru.START

    def loss(q):
        state, total = h, 0.0
        for t in range(5):
            state = gru._step(q, x[t], state * (x[t] != gru.START)[:, None])[0]
            total -= gru.log_chances(q, state, y[t]).sum()
        return total / x.size

    g, _ = gru._gradients(p, x, y, h)
    for k in gru.SHAPES:
        at = tuple(np.argwhere(np.abs(g[k]) > 1e-4)[0])
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-5
        up = loss(q)
        q[k][at] -= 2e-5
        assert (up - loss(q)) / 2e-5 == pytest.approx(g[k][at], rel=1e-3, abs=1e-6), k


def test_state_runs_through_texts_side_by_side():
    p = gru.started(np.arange(1, 100)[::-1].astype(float), np.ones(gru.FORMS), 5)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 99, n) for n in (1, 50, 3, 17)]
    offsets = np.cumsum([0, *map(len, texts)])
    found = gru.score(p, np.concatenate(texts), offsets, at_once=20)
    for i, t in enumerate(texts):
        alone = gru.score(p, t, np.array([0, len(t)]))
        assert np.allclose(found[offsets[i] : offsets[i + 1]], alone, atol=1e-4)


def test_lm_scores_against_counts(spark, odd, none):
    rows = odd.collect()
    held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1 for r in rows]
    words = [(r.text or "").encode().lower().split() + [None] for r in rows]
    c = Counter(w for h, k in zip(held, words, strict=True) if not h for w in k)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), len(k), sum(c[w] > 0 for w in k), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k), 5)) for r, k in zip(rows, words, strict=True))
    found = lm_scores(odd).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in found) == want
    assert {r.train_tokens for r in found} == {n} and all(r.score < 0 for r in found)
    assert lm_scores(none).count() == 0


def test_spans_and_extensions():
    text = code_points("abcabcabdabcabc")
    p = Prefixes(text)
    assert p.equal(0, 3, 5) and not p.equal(0, 3, 6)
    assert p.common(np.array([0, 0, 1]), np.array([3, 9, 2]), np.array([12, 6, 13])).tolist() == [5, 6, 0]


def test_edited_fingerprints(odd, none):
    import hashlib

    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    texts = [r.text or "" for r in rows]
    want = Counter((r.doc_id, len(t), hashlib.sha256(edited_text(t, texts[(i + 1) % len(texts)]).encode()).hexdigest()) for i, (r, t) in enumerate(zip(rows, texts, strict=True)))
    for size in (2, 4000):
        found = edited_fingerprints(odd, ranges=size).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
        assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
        assert len({r.fingerprint for r in found}) == len(set(texts))
    assert edited_fingerprints(none).count() == 0


def likeness_by_hand(a, b, shared):
    """The same share with every anchor extended letter by letter; ``shared``: anchors by slots."""
    if a == b:
        return 1.0
    seen_a, seen_b = set(), set()
    for i, j in [*shared, (0, 0), (len(a), len(b))]:
        x, y = i, j
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y = x + 1, y + 1
        while i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        seen_a |= set(range(i, x))
        seen_b |= set(range(j, y))
    return (len(seen_a) + len(seen_b)) / max(1, len(a) + len(b))


def test_likeness_against_letters(small):
    import random

    rng = random.Random(3)
    texts = ["", "a", "abc", "hello world, hello world", "x" * 50] + [r.text or "" for r in small.limit(25).collect()]
    for t in texts[4:20]:
        at = rng.randrange(len(t) + 1)
        texts += [t[:at] + "NEW" + t[at:], t[at:] + t[:at], t.replace(" ", "  ", 3)]
    marks = Marks([code_points(t) for t in texts])
    pairs = [(i, rng.randrange(len(texts))) for i in range(len(texts))] + [(i % 25, 30 + i) for i in range(len(texts) - 30)]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    got, (pair, i, j) = likeness(marks, a, b), anchors(marks, a, b)
    for k, (x, y) in enumerate(pairs):
        shared = [(i[q] - marks.starts[x], j[q] - marks.starts[y]) for q in np.flatnonzero(pair == k)]
        shared = [(u, v) for u, v in shared if texts[x][u : u + 12] == texts[y][v : v + 12]]
        assert got[k] == pytest.approx(likeness_by_hand(texts[x], texts[y], shared), abs=1e-9), (texts[x][:40], texts[y][:40])
    assert ((got >= 0) & (got <= 1)).all()


def test_every_training_text_reaches_the_network(small, monkeypatch):
    from pagewright.llm import lm_scoring

    kept = {}

    def noted(df, name, keep=lm_scoring.keep):
        kept[name] = keep(df, name)
        return kept[name]

    monkeypatch.setattr(lm_scoring, "keep", noted)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 1000)
    train = [r for r in small.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    rows = lm_scores(small).collect()
    assert len(rows) == small.count()
    assert sum(r.n for r in kept["averages"].collect()) == sum(len((r.text or "").encode().split()) + 1 for r in train)


def test_scores_keep_the_rate_of_toxic_rows_under_sampling(spark):
    rows = [(i, f"some plain words n{i % 7}" + (" vile" if i % 40 == 0 else ""), int(i % 20 == 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    bias, weights = toxicity.toxicity_model(df, most=200)
    s = toxicity.scores(pa.array([t for _, t, _ in rows]), bias, weights)
    assert abs(s.mean() - 0.05) < 0.02 and s[1] < 0.1 and s[0] > 0.5
