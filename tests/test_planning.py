from pagewright.operators import planning


def test_steps_of_each_response(spark):
    c = spark.createDataFrame([(b, p, p + p // 2, f"c{p}", 2) for b in (1, 2, 3, 4, 5) for p in range(3)], "book int, pos long, turn long, text string, chars long")
    t = spark.createDataFrame([(b, p, 1.0) for b, n in ((1, 4), (2, 2), (3, 1), (5, 1), (7, 1)) for p in range(n)], "book int, pos long, seconds double")
    said = [(1, "pair_accept"), (2, "pair_drop"), (3, "single_lesson"), (4, "single_lesson"), (5, None), (6, "split_proportional"), (7, "cancel")]
    d = spark.createDataFrame(said, "book int, response string")
    steps = planning.with_bodies(planning.plan_steps(c, t, d, "book", "pos", "turn", "chars", "seconds"), c, "book", "pos", "text")
    found = sorted((r.book, r.chapter_index, r.track, r.degraded, r.body) for r in steps.collect())
    assert found == [
        (1, 0, 0, False, "c0"), (1, 1, 1, False, "c1"), (1, 3, 2, False, "c2"), (1, 4, 3, True, " "),
        (2, 0, 0, False, "c0"), (2, 1, 1, False, "c1"), (3, 0, 0, True, "c0\n\nc1\n\nc2"),
    ]
    errors = planning.plan_errors(c, t, d, "book", "turn").collect()
    assert sorted(r.book for r in errors) == [4, 6]


def test_sample_plans(spark):
    """Cases of the reference's rules: skip 5, target 30, least 10 seconds."""
    from pagewright.operators import queue

    nan = float("nan")
    rows = [
        ("one", 0, "a", None, None, 120.0, None), ("short", 0, "a", None, None, 29.0, None), ("just", 0, "a", None, None, 30.0, None), ("none", 0, "a", None, None, 0.0, None), ("told", 0, "a", None, None, 0.0, 120.0),
        ("two", 0, "a", None, None, 200.0, None), ("two", 1, "b", None, None, 100.0, None), ("twice", 0, "a", None, None, 120.0, None), ("twice", 1, "a", None, None, 120.0, None),
        ("cut", 0, "a", 0.0, 60.0, 120.0, None), ("cut", 1, "a", 60.0, 120.0, 120.0, None), ("end", 0, "a", None, None, 100.0, None), ("end", 1, "b", 100.0, 100.0, 100.0, None),
        ("odd", 0, "a", nan, 50.0, 100.0, None), ("tiny", 0, "a", None, None, 100.0, None), ("tiny", 1, "b", None, None, 14.0, None),
    ]
    df = spark.createDataFrame(rows, "book string, n int, path string, start double, end double, probed double, declared double")
    got = {r.book: (r.error, r.head and tuple(r.head), r.head_retry and tuple(r.head_retry), r.tail and tuple(r.tail), r.tail_retry and tuple(r.tail_retry)) for r in queue.sample_plans(df, "book", ["n"], "path").collect()}
    split = (None, (5, 35), (35, 60), (85, 115), (60, 85))
    refused = ("insufficient audio", None, None, None, None)
    assert got == {
        "one": split, "told": split, "twice": split, "short": refused, "none": refused, "odd": refused, "tiny": refused, "just": (None, (5, 15), None, (15, 25), None),
        "two": (None, (5, 35), (35, 65), (65, 95), (35, 65)), "cut": (None, (5, 35), (35, 60), (85, 115), (60, 85)), "end": (None, (5, 35), (35, 65), (65, 95), (35, 65)),
    }


def test_trash_slots_and_requests(spark):
    from pagewright.operators import queue

    trashed = queue.trash_slots(spark.createDataFrame([("a", 7, 1), ("a", 7, 2), ("a", 7, 3), ("b", 7, 1), ("c", 7, 1)], "slug string, at int, seq int"), "slug", "at")
    assert sorted(r.slot for r in trashed.collect()) == ["a-7", "a-7-1", "a-7-2", "b-7", "c-7"]
    asked = [(1, "restore", "a-7"), (2, "restore", "a-7-1"), (3, "restore", "a-7"), (4, "purge", "a-7-1"), (5, "restore", "a-7-1"), (6, "restore", "b-7"), (7, "purge", "b-7"), (8, "purge", "b-7"), (9, "purge", "x-1"), (10, "purge", "c-7"), (11, "restore", "c-7")]
    got = queue.trash_requests(spark.createDataFrame(asked, "seq int, action string, slot string"), trashed, spark.createDataFrame([("b",)], "slug string"), "slug")
    want = ["restored", "conflict", "not found", "purged", "not found", "conflict", "purged", "not found", "not found", "purged", "not found"]
    assert [r.answer for r in got.orderBy("seq").collect()] == want


def test_names_are_registered_once():
    import pytest
    from pagewright.plans.registry import QUERIES, query

    with pytest.raises(ValueError, match="two queries"):
        query(None)(next(iter(QUERIES.values())))


def test_queue_states_follow_a_queue(spark):
    import random
    from collections import deque

    from pagewright.operators import queue

    rng, rows, want = random.Random(9), [], {}
    queues = {q: deque() for q in ("a", "b", None)}
    for i in range(200):
        q = rng.choice(list(queues))
        popped, job = None, None
        if rng.random() < 0.5:
            job = i
            queues[q].append(i)
        elif queues[q]:
            popped = queues[q].popleft()
        rows.append((q, i, "push" if job is not None else "advance", job))
        want[i] = (len(queues[q]), queues[q][0] if queues[q] else None, popped)
    got = queue.queue_states(spark.createDataFrame(rows, "q string, i int, op string, job long"), "q", "i").collect()
    assert {r.i: (r.length, r.current, r.popped) for r in got} == want and len(got) == 200
