"""Detection as one decision, against plain Python on small books, and the rules' own small cases."""

import random

import pytest
from pagewright.operators import detection

CHAPTERS = "book int, pos long, title string, body string"
TRACKS = "book int, track long, title string, head string, tail string"


def shared(a: str, b: str) -> float:
    """Length of the longest common substring over the shorter length."""
    least, best, row = min(len(a), len(b)), 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best / least if least else 0.0


def plain_boundary(text, chapters, side, least=None):
    """(verdict, pos, score) of one transcript; chapters are (pos, title, body)."""
    if len(text or "") < 20:
        return "poor", None, None
    own = [c for c in chapters if least is None or c[0] >= least]
    n = min(400, -(-len(text) * 3 // 2))
    probe = {"head": lambda b: b[:n], "tail": lambda b: b[max(0, len(b) - n) :], "body": lambda b: b}[side]
    scored = sorted((-shared(text, probe(b)), p, t, b) for p, t, b in own)
    if not scored:
        return "low", None, None
    score, pos, title, body = -scored[0][0], *scored[0][1:]
    gap = score - (-scored[1][0] if len(scored) > 1 else 0)
    unsure = title and any(t == title and p != pos for p, t, _ in own)
    unsure = unsure or (side != "tail" and len(body) < len(text) and any(len(b) > len(body) for _, _, b in own))
    return ("confident" if not unsure and score >= 0.45 and gap >= 0.15 else "low"), pos, score


def plain(tracks, chapters):
    """(outcome, start, end, starts) of a book whose titles do not decide; tracks are (head, tail)."""
    if len(tracks) == 1:
        head, tail = tracks[0]
        h = plain_boundary(head, chapters, "head")
        t = plain_boundary(tail, chapters, "tail", h[1] if h[0] == "confident" else None)
        if "poor" in (h[0], t[0]):
            return "no_transcript", None, None, []
        if h[0] == t[0] == "confident" and (h[1] != t[1] or len(chapters) <= 1):
            return "detected", h[1], t[1], []
        return "low_confidence", None, None, []
    found = []
    for i, (head, _) in enumerate(tracks):
        h = plain_boundary(head, chapters, "head")
        if i and h[0] == "low":
            b = plain_boundary(head, chapters, "body")
            h = b if b[0] == "confident" or (b[2] or 0) > (h[2] or 0) else h
        found.append(h)
    if all(f[0] == "poor" for f in found):
        return "no_transcript", None, None, []
    starts, last = [], None
    for i, (_, pos, _) in enumerate(found):
        if pos is not None and (last is None or pos > last):
            starts.append((i, pos))
            last = pos
    if not starts:
        return "low_confidence", None, None, []
    begin = 0 if starts[0][0] != 0 else starts[0][1]  # the first track begins at its start, or with the book
    return "detected", begin, len(chapters) - 1, starts


def test_against_plain_python(spark):
    rng = random.Random(5)
    words = ["rain", "river", "stone", "captain", "lantern", "harbor", "quiet", "monday", "glass", "winter", "orchard", "signal", "violet", "thunder"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chapters, tracks, want = [], [], {}
    for book in range(40):
        own = [(p, rng.choice(["", "same title", f"title {p}"]), text(rng.choice([2, 30, 60]))) for p in range(rng.choice([0, 1, 3, 5]))]
        heard = []
        for _ in range(rng.choice([1, 1, 2, 4])):
            body = rng.choice(own)[2] if own else text(20)
            heard.append((rng.choice([body[:50], body[40:110], text(12), "short", None]), rng.choice([body[-60:], text(12), ""])))
        chapters += [(book, *c) for c in own]
        tracks += [(book, i, None, *h) for i, h in enumerate(heard)]
        want[book] = plain(heard, own)
    rows = detection.detected(spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(chapters, CHAPTERS), "book").collect()
    got = {r.book: (r.outcome, r.start_pos, r.end_pos, [tuple(x) for x in r.starts]) for r in rows}
    assert len(rows) == 40 and got == want
    assert {w[0] for w in want.values()} == {"detected", "low_confidence", "no_transcript"}


@pytest.fixture(scope="module")
def book(spark):
    bodies = ["once upon a quiet morning in the village the bells rang softly", "homeward bound after many years away she finally saw the harbor", "and the lantern on the pier burned through the longest night"]
    return bodies, spark.createDataFrame([(b, p, f"part of {w}", bodies[p]) for b in (1, 2, 3) for p, w in enumerate(["bells", "harbor", "lanterns"])], CHAPTERS)


def test_titles_go_first(spark, book):
    bodies, chapters = book
    rows = [(1, 0, "part of bells", None, None), (1, 1, "part of harbor", None, None), (2, 0, "part of bells", bodies[0], bodies[2]), (3, 0, None, "", None), (4, 0, None, bodies[0], bodies[0])]
    found = {r.book: (r.outcome, r.source, r.start_pos, r.end_pos, r.reason) for r in detection.detected(spark.createDataFrame(rows, TRACKS), chapters, "book").collect()}
    assert found == {
        1: ("detected", "title", 0, 1, None), 2: ("detected", "transcript", 0, 2, None),  # one title is no range
        3: ("no_transcript", None, None, None, "empty"), 4: ("low_confidence", None, None, None, None),
    }


def test_a_start_that_is_not_there_is_never_sure(spark, book):
    bodies, chapters = book
    heard = spark.createDataFrame([(1, bodies[2], 9), (2, bodies[2], 1), (3, bodies[0], 1)], "book int, text string, start long")
    found = {r.book: (r.verdict, r.pos) for r in detection.boundaries(heard, chapters, ["book"], "tail", "start").collect()}
    assert found[1] == ("low", 2) and found[2] == ("confident", 2) and found[3][0] == "low"


def test_empty_tables(spark, book):
    none, chapters = spark.createDataFrame([], TRACKS), spark.createDataFrame([], CHAPTERS)
    assert detection.detected(none, book[1], "book").count() == 0
    assert [r.outcome for r in detection.detected(spark.createDataFrame([(1, 0, None, book[0][0], None)], TRACKS), chapters, "book").collect()] == ["no_transcript"]
