"""Sidecars, audio books, a project's sound, the store's health and trash, from files made here."""

import json
import os

from pagewright.sources import books, projects
from pyspark.sql import functions as F


def touch(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def sidecar(*titles):
    return json.dumps({"chapters": [{"title": t, "start_offset_ms": 1000 * i, "length_ms": 1000} for i, t in enumerate(titles)]}).encode()


def test_sidecars_are_chosen_by_stem(spark, tmp_path):
    root = tmp_path / "lib"
    made = {
        "Ann/Exact [B000000001]/book.m4b": b"x", "Ann/Exact [B000000001]/a.json": sidecar("A"), "Ann/Exact [B000000001]/book.json": sidecar("Right"),
        "Ann/Failing [Annotated] [B000000002] x/book.m4b": b"x", "Ann/Failing [Annotated] [B000000002] x/book.json": b"{", "Ann/Failing [Annotated] [B000000002] x/z.json": sidecar("Z"),
        "Bob/Two [b000000003]/p1.m4a": b"x", "Bob/Two [b000000003]/p2.m4b": b"x", "Bob/Two [b000000003]/a.json": sidecar("A"), "Bob/Two [b000000003]/p2.json": sidecar("P2"),
        "Bob/Any/p1.m4a": b"x", "Bob/Any/p2.m4a": b"x", "Bob/Any/b.json": sidecar("B"), "Bob/Any/a.json": json.dumps({"chapters": [{"start_offset_ms": 4}]}).encode(),
        "Bob/None/p1.m4a": b"x", "Bob/Sound/p.mp3": b"x", "stray.m4b": b"x", "Deep/er/still/p.m4b": b"x",
    }
    for name, data in made.items():
        touch(root / name, data)
    rows = books.libation_candidates(spark, f"file://{root}").collect()
    got = [(r.title, r.authors, r.asin, r.audio_kind, len(r.audio), [c.title for c in r.chapters] if r.chapters else None) for r in rows]
    assert got == [
        ("Any", ["Bob"], None, "folder", 2, ["B"]), ("Exact", ["Ann"], "B000000001", "single", 1, ["Right"]), ("Failing [Annotated]", ["Ann"], "B000000002", "single", 1, ["Z"]),
        ("None", ["Bob"], None, "single", 1, None), ("Two [b000000003]", ["Bob"], None, "folder", 2, ["P2"]),
    ]


def test_sidecar_numbers(spark, tmp_path):
    touch(tmp_path / "a.json", json.dumps({"chapters": [{"title": "A", "start_offset_ms": 1500, "length_ms": "9"}, {"title": 3}, {"title": "", "start_offset_ms": -5, "length_ms": 2.5}, 7]}).encode())
    touch(tmp_path / "b.json", b"[1]")
    rows = books.sidecar_chapters(spark, f"file://{tmp_path}").collect()
    assert sorted((r.pos, r.title, r.start, r.end) for r in rows) == [(0, "A", 1.5, 1.5), (2, "", 0.0, 0.0)]


def test_sound_of_projects(spark, tmp_path):
    for name in ("a/2.mp3", "a/10.MP3", "a/1.aac", "a/sub/3.mp3", "a/note.txt", "b/x.flac"):
        touch(tmp_path / name)
    at = f"file:{tmp_path}"
    rows = [("one", "single", f"{at}/gone.m4b", None), ("list", "manifest", f"{at}/m.json", None), ("dir", "folder", f"{at}/a/", None), ("none", "folder", f"{at}/c", None), ("pick", "multiple", None, [f"{at}/b/x.flac", f"{at}/gone.mp3", f"{at}/a/note.txt", f"{at}/a/2.mp3", f"{at}/b/x.flac"])]
    sources = spark.createDataFrame(rows, "project string, kind string, path string, paths array<string>")
    got = books.audio_paths(sources, books.files(spark, f"file://{tmp_path}"), "project").orderBy("project", "pos").collect()
    assert [(r.project, r.pos, r.path.rpartition("/")[2]) for r in got] == [("dir", 0, "10.MP3"), ("dir", 1, "2.mp3"), ("list", 0, "m.json"), ("one", 0, "gone.m4b"), ("pick", 0, "x.flac"), ("pick", 1, "2.mp3"), ("pick", 2, "x.flac")]


def test_health_and_trash(spark, tmp_path):
    put = lambda name, key, at, title="T": (touch(tmp_path / name / "project.json", key if isinstance(key, bytes) else json.dumps({"join_key": key, "title": title}).encode()), os.utime(tmp_path / name / "project.json", (at, at)))
    put("a", "k1", 1000), put("b", "k1", 3000, "fresh"), put("c", "k1", 3000), put("d", "k2", 1000), put("e", b"{", 1000), put("f", b"{}", 1000)
    put(".trash/a-1", "k1", 5000, "old"), put(".trash/b-2", "k9", 6000, "new"), put(".trash/c-3", b"{", 7000)
    rows = projects.scanned(spark, f"file://{tmp_path}")
    got = {r.path.split("/")[-2]: r["class"] for r in rows.collect()}
    assert got == {"a": "deduped", "b": "ok", "c": "deduped", "d": "ok", "e": "corrupt", "f": "corrupt"}
    assert {r["class"]: r.files for r in projects.health(rows).collect()} == {"ok": 2, "deduped": 2, "corrupt": 2}
    assert [(r.slot, r.join_key, r.title) for r in projects.trash_entries(spark, f"file://{tmp_path}").collect()] == [("b-2", "k9", "new"), ("a-1", "k1", "old")]
    assert projects.trash_entries(spark, f"file://{tmp_path}/a").count() == 0


def test_patches_refuse_what_is_not_there(spark):
    receipts = "array<struct<chapter_index: long, lesson_id: long>>"
    held = spark.createDataFrame([("a", [(0, None), (1, 5)]), ("b", [])], f"join_key string, receipts {receipts}")
    asked = spark.createDataFrame([("a", 1, 0, 7), ("a", 2, 0, 8), ("a", 3, 2, 9), ("b", 4, 0, 9), ("c", 5, 0, 9), ("a", 6, None, 9), ("a", 7, 1, None)], "join_key string, seq int, index long, lesson_id long")
    rows, refused = projects.patches(held, asked, "join_key")
    assert {r.join_key: [x.lesson_id for x in r.receipts] for r in rows.collect()} == {"a": [8, None], "b": []}
    assert sorted((r.seq, r.error) for r in refused.collect()) == [(3, "no slot 2 of 2"), (4, "no slot 0 of 0"), (5, "not found"), (6, "no slot null of 2")]
    assert rows.columns == held.columns and F is not None


def test_loose_texts_are_composed(spark, tmp_path):
    touch(tmp_path / "a.txt", b"\xef\xbb\xbf" + "e\u0301a\u200b".encode())
    touch(tmp_path / "b.txt", "e\u0301".encode("utf-16"))
    touch(tmp_path / "c.txt", b"\xff\xff")
    rows = {r.path[-5:]: (r.text, (r.error or "")[:10]) for r in books.loose_texts(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a.txt": ("\xe9a\u200b", ""), "b.txt": ("\xe9", ""), "c.txt": (None, "ValueError")}
