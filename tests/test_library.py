"""Reconciling as one chain, creations, last good views in batch and stream, ages: against plain versions and the reference's cases."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pagewright.functions import text as T
from pagewright.operators import course
from pagewright.operators import library as L
from pyspark.sql import functions as F

from test_similarity import distance


def reconciled(candidates, store):
    heads, groups = [], []
    for c in candidates:
        for g, head in zip(groups, heads, strict=True):
            if any(head[k] is not None and head[k] == c[k] for k in (2, 3)):
                g.append(c)
                break
        else:
            heads.append(c)
            groups.append([c])
    out = {}
    for g in groups:
        at, title, strong, content, _ = g[0]
        key, near, best = strong or content, None, None
        if not any(k == key for k, _, _ in store):
            for k, t, _ in sorted(store, key=lambda x: x[2]):
                a, b = title.lower(), t.lower()
                r = 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b), 1)
                if r >= 0.85 and (best is None or r > best):
                    near, best = k, r
        outcome = "merged" if any(k == key for k, _, _ in store) else "conflict" if near else "created"
        out[at] = (key, title, len(g), outcome, near)
    return out


def test_reconcile_follows_the_plain_fold(spark):
    rng = random.Random(2)
    candidates = []
    for i in range(80):
        title = rng.choice(["The Long Road ", "The Long Road ", "Rivers "]) + rng.choice(["Home", "home", "Hume", "Away", "Aways", "North"]) + rng.choice(["", " 1", " 2"])
        candidates.append((i, title, rng.choice([None, f"isbn{rng.randrange(9)}"]), f"ch{title.lower()}", "p"))
    store = [("isbn1", "The Long Road Hume", 0), ("chthe long road away", "Another Title", 1), ("x", "THE LONG ROAD NORTH", 2), ("y", "The Long Road Away 1", 3)]
    df = spark.createDataFrame(candidates, "position long, title string, strong string, content string, p string")
    held = spark.createDataFrame(store, "key string, title string, pos long")
    got = {r.leader: (r.key, r.title, r.members, r.outcome, r.near) for r in L.reconcile(df, held, "p", ["strong", "content"]).collect()}
    want = reconciled(candidates, store)
    assert got == want and {w[3] for w in want.values()} == {"merged", "conflict", "created"}


def test_creations(spark):
    key_of = lambda t, a: F.concat(F.lower(t), F.lit("|"), F.coalesce(a, F.lit("")))
    held = spark.createDataFrame([("a|", "A kept"), ("a (copy)|", "x"), ("b|ann", "B")], "key string, title string")
    asked = [(1, "A", None, None), (2, "A", None, "new"), (3, "A", None, "replace"), (4, "A", None, "skip"), (5, "A", "bob", "new"), (6, "B", "ann", "new"), (7, "C", None, None)]
    got = L.creations(spark.createDataFrame(asked, "seq int, title string, author string, resolution string"), held, key_of).orderBy("seq").collect()
    assert [(r.outcome, r.project, r.shown) for r in got] == [
        ("conflict", "a|", "A kept"), ("created", "a (copy) (copy)|", "A (copy) (copy)"), ("replaced", "a|", "A"), ("skipped", "a|", "A"), ("created", "a|bob", "A"),
        ("created", "b (copy)|ann", "B (copy)"), ("created", "c|", "C"),
    ]
    (last,) = L.creations(spark.createDataFrame([(1, "A", None, "new")], "seq int, title string, author string, resolution string"), held, key_of, most=1).collect()
    assert (last.outcome, last.project) == ("failed", None)


FETCHES = "key string, at timestamp, seq long, outcome string, view string"


def test_last_good_views_in_batch_and_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=m)
    rows = [("a", at(0), 1, "ok", "v1"), ("a", at(5), 2, "error", None), ("b", at(0), 3, "ok", "v2"), ("b", at(1), 4, "gone", None), ("b", at(2), 5, "error", None), ("c", at(0), 6, "gone", None), ("c", at(3), 7, "ok", "v3"), ("d", at(1), 8, "error", None), ("a", at(5), 9, "error", None), ("e", at(9), 11, "ok", "late"), ("e", at(9), 10, "gone", None)]
    want = {"a": ("v1", "error"), "b": (None, "error"), "c": ("v3", None), "d": (None, "error"), "e": ("late", None)}
    df = spark.createDataFrame(rows, FETCHES)
    assert {r.key: (r.view, r.error) for r in course.last_good(df, "key").collect()} == want
    random.Random(3).shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], FETCHES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = course.last_good(spark.readStream.schema(FETCHES).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), "key")
    query = stream.writeStream.format("memory").queryName("views").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.key: (r.view, r.error) for r in spark.table("views").collect()} == want
    now = spark.createDataFrame([(at(0), at(15), False), (at(1), at(15), False), (at(14), at(15), True), (None, at(15), False)], "f timestamp, n timestamp, forced boolean")
    assert [r.x for r in now.select(course.must_fetch(F.col("f"), F.col("n"), F.col("forced")).alias("x")).collect()] == [True, False, True, True]


@pytest.mark.parametrize(
    "ago, shown",
    [(-5, "just now"), (0.9, "just now"), (1, "1 minute ago"), (59.9, "59 minutes ago"), (60, "1 hour ago"), (119, "1 hour ago"), (120, "2 hours ago"), (1439, "23 hours ago"), (1440, "yesterday"), (1440 * 3, "Tue"), (1440 * 7, "Mar 8"), (1440 * 80, "Dec 26, 2023"), (None, "unknown")],
)
def test_ages(spark, ago, shown):
    now = datetime(2024, 3, 15, 18, tzinfo=timezone.utc)
    df = spark.createDataFrame([(now, None if ago is None else now - timedelta(minutes=ago))], "n timestamp, a timestamp")
    assert df.select(T.age_text(F.col("a"), F.col("n"))).first()[0] == shown


def test_titles_as_readers_sort_them(spark):
    df = spark.createDataFrame([("zebra",), ("Éclair",), ("eclair",), ("Zoo",), ("éclair",), ("Eclair",), ("_x",), ("9",)], "t string")
    assert [r.t for r in df.orderBy(L.localised(F.col("t"))).collect()] == ["_x", "9", "eclair", "Eclair", "éclair", "Éclair", "zebra", "Zoo"]


def greedy(chapters, tracks, least=0.6):
    def score(a, b):
        a, b = ("".join(x.lower().split()) for x in (a, b))
        x, y = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b))
        return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0

    out, last = {}, -1
    for t, title in enumerate(tracks):
        best = max(((score(c, title), -i) for i, c in enumerate(chapters) if i > last), default=(0, 0))
        if best[0] >= least:
            last = -best[1]
            out[last] = t
    return out if len(out) >= 2 and 2 * len(out) >= min(len(chapters), len(tracks)) else {}


def test_seeding_by_titles_squeezes_or_drops(spark):
    from pagewright.operators import mapping, matching

    rng = random.Random(11)
    words = ["Dawn", "The Dusk", "Rivers", "A Road", "Home", "Storm", "Harvest", "Winter Night"]
    books = {}
    for b in range(12):
        chapters = [rng.choice(words) + rng.choice(["", " I", " II"]) for _ in range(rng.randint(2, 6))]
        tracks = rng.sample(chapters, rng.randint(1, len(chapters))) if b % 3 else [rng.choice(words) for _ in range(rng.randint(1, 6))]
        books[b] = (chapters, sorted(tracks, key=chapters.index) if b % 3 == 1 else tracks, "pair_drop" if b % 2 else "pair_accept")
    c = spark.createDataFrame([(b, i, i, t, 1) for b, (x, _, _) in books.items() for i, t in enumerate(x)], "book int, pos long, turn long, title string, chars long")
    t = spark.createDataFrame([(b, i, t, 1.0) for b, (_, x, _) in books.items() for i, t in enumerate(x)], "book int, pos long, title string, seconds double")
    d = spark.createDataFrame([(b, r) for b, (_, _, r) in books.items()], "book int, response string")
    got = {(r.book, r.turn): r.track for r in mapping.seeded(c, t, d, "book", "pos", "turn", "chars", "seconds", matching.title_anchors(c, t, "book", "pos", "title")).collect()}
    anchored = 0
    for b, (chapters, tracks, response) in books.items():
        found = greedy(chapters, tracks)
        anchored += bool(found)
        track = None
        for i in range(len(chapters)):
            if not found:
                want = i if i < len(tracks) else None
            elif response == "pair_drop":
                want = found.get(i)
            else:
                track = found.get(i, track)
                want = max(found[min(found)] - 1, 0) if track is None else track
            assert got[b, i] == want, (b, i)
    assert 2 < anchored < 12
