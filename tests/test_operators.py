import datetime
import io
import random
import struct
import wave
import zipfile

import numpy as np
import pytest
from pagewright.functions import identity, text as T
from pagewright.operators import alignment, events, library, mapping, matching
from pagewright.sources import books, projects
from pagewright.streaming import jobs
from pyspark.sql import GroupedData, functions as F


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("chapters", "tracks", "kind"),
    [(0, 3, "unalignable"), (4, 4, None), (1, 3, "one_to_many"), (9, 1, "many_to_one"), (5, 6, "count_off"), (20, 4, "many_to_few"), (200, 4, "unalignable"), (5, 12, "count_off"), (20, 15, "count_off"), (2, 9, "unalignable")],
)
def test_count_classes(spark, chapters, tracks, kind):
    df = spark.createDataFrame([(chapters, tracks)], "c long, t long")
    assert df.select(matching.count_class(F.col("c"), F.col("t")).alias("k")).first().k == kind


@pytest.mark.parametrize(
    ("chars", "seconds", "ends"),
    [([10, 10, 10, 10], [1, 1], [2, 4]), ([100, 1, 1], [1, 1], [1, 3]), ([0, 0, 0], [1, 2], [0, 3]), ([], [1, 1], [0, 0]), ([5], [1, 1, 1], [1, 1, 1]), ([10, 30, 10], [1, 1], [2, 3])],
)
def test_proportional_ends(spark, chars, seconds, ends):
    c = spark.createDataFrame([(1, i, x) for i, x in enumerate(chars)], "book int, pos long, chars long")
    t = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(seconds)], "book int, pos long, seconds double")
    rows = matching.proportional_pack(c, t, "book", "pos", "chars", "seconds").orderBy("track").collect()
    assert [r.end_chapter for r in rows] == (ends if chars else []) and all(r.first_chapter == e for r, e in zip(rows, [0, *ends]))


def test_exact_median(spark):
    for values, want in (([1.0, 2.0, 3.0], 2.0), ([1.0, 2.0, 3.0, 500.0], 2.5), ([7.0] * 5 + [None, 0.0], 7.0), ([0.001, 0.0011, 1e9], 0.0011), ([], None)):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        assert matching.exact_median(df, "x", "m").first().m == (want if want is None else pytest.approx(want))


def test_title_conflicts_against_all_pairs(spark):
    rng, words = random.Random(5), ["rain", "sun", "night", "end", "the", "a"]
    titles = sorted({" ".join(rng.choice(words) + rng.choice(["", "s", "y"]) for _ in range(rng.randrange(1, 5))) for _ in range(150)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    assert distance("night", "nights") == 1
    want = {}
    for a in titles:
        near = [(-(1 - distance(a, b) / max(len(a), len(b))), k, b) for k, b in enumerate(titles) if b != a]
        near = [x for x in near if -x[0] >= 0.85 - 1e-12]
        if near:
            want[a] = min(near)[2]
    df = spark.createDataFrame([(t, k) for k, t in enumerate(titles)], "title string, pos long")
    assert {r.title: r.near for r in library.title_conflicts(df.select("title"), df).collect()} == want


def test_places(spark):
    rows = [(i % 2, i % 7, f"t{i % 5}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, a int, b string, i int")
    found = {r.i: r.place for r in matching.places(df, "g", [F.col("a")], [F.col("a"), F.col("b"), F.col("i")], "place").collect()}
    for g in (0, 1):
        order = sorted((a, b, i) for h, a, b, i in rows if h == g)
        assert [found[i] for _, _, i in order] == list(range(1, 31))


def test_title_anchors_are_greedy_and_monotone(spark):
    c = spark.createDataFrame([(1, i, t) for i, t in enumerate(["The Rain", "The Sun", "Night Falls", "The End"])], "book int, pos long, title string")
    t = spark.createDataFrame([(1, i, t) for i, t in enumerate(["the sun", "The rain", "the end"])], "book int, pos long, title string")
    assert sorted((r.chapter, r.track) for r in matching.title_anchors(c, t, "book", "pos", "title").collect()) == [(1, 0), (3, 2)]


def each(spark, column, given):
    """The column's value for each given text, in order."""
    return [r.x for r in spark.createDataFrame(list(enumerate(given)), "i int, a string").select("i", column(F.col("a")).alias("x")).orderBy("i").collect()]


def test_bodies_are_cleaned(spark):
    cases = {
        "&amp;lt;": "&lt;", "&amp;amp;": "&amp;", "it&apos;s&#x3000;so": "it's\u3000so", "&nbsp;&#39;": "&nbsp;&#39;",
        "<head><style>.a { color: red }</style></head><p>Keep</p><script>var x = '<p>';</script><p>Also keep</p>": "KeepAlso keep",
        '<style type="text/css"/><p>Body text</p>': "Body text",
        "<html><HEAD lang='x'><title>Book</title></HEAD ><body>Text</body>": "Text",
        "<header>Top</header>": "Top", "a < b": "a < b", "x<script>never closed <p>y": "x",
        "a\n \n\t\n\nb\r\n c \n": "a\n\nb\nc", "\u3000 \n\u00a0x\u3000\n\n": "x",
        "<ruby>漢<rt>かん</rt></ruby>": "漢", "": "", "<!-- a --> b": "b",
    }
    assert each(spark, T.clean_body, cases) == list(cases.values())


def test_languages_fold(spark):
    cases = {
        "jpn": "ja", "JA": "ja", "ja-JP": "ja", "en": "en", "en-US": "en", "eng": "en", "zh-Hans": "zh", "chi": "zh", "swe": "sw", "aa": "aa", "el": "el",
        "tr_TR": "tr", "uk": "uk", "qq": "xx", "": "", "x": "", " De ": "de", "dut": "xx", None: None,
    }
    assert each(spark, T.fold_language, cases) == list(cases.values())


def test_small_text_rules(spark):
    cases = {"eng": "en", "jpn": "ja", "fr": "fr", "EN": None, "qq": None, "fra": None, "": None, None: None}
    assert each(spark, T.provider_hint, cases) == list(cases.values())
    assert each(spark, lambda c: T.provider_hint(c, ("en",)), ["eng", "fr"]) == ["en", None]
    cases = {"  The\u3000Rain ": "the rain", "a\tb": "ab", "Ｃｈ\u200b１": "ch1", "\ufeff": "", None: None}
    assert each(spark, T.shown_title, cases) == list(cases.values())
    a, b = each(spark, identity.title_hash, ["Ｃｈ１\u3000x", "ch1  X"])
    assert a == b
    assert each(spark, T.next_stage, ["new", "uploaded", "done", "?"]) == ["parsed", "done", None, None]
    assert each(spark, lambda c: T.stage_step(c, F.lit("mapped")), ["new", "mapped", "done"]) == ["mapped", "mapped", None]
    assert each(spark, lambda c: T.signal_label("s", c.cast("int")), ["0", "2", "5", "11", "12"]) == ["s_x0", "s_x2", "s_x3+", "s_x6+", "s_x12+"]
    assert each(spark, lambda c: T.audio_title(c, F.lit(2)), ["/a/b.c.mp3", "", None]) == ["b.c", "Track 3", "Track 3"]


@pytest.mark.parametrize(("title", "generic"), [("chapter 12", True), ("глава7", True), ("第3章", True), ("3話", True), ("the rain", False), ("chapter one", False), ("", False)])
def test_generic_titles(spark, title, generic):
    assert one(spark, T.is_generic_title(F.col("a")), a=title) is generic


def test_text_functions(spark):
    assert one(spark, T.alignment_text(F.col("a")), a="Ｈｅｌｌｏ,  “Wörld”　２") == "hello wörld 2"
    assert one(spark, T.dice(F.col("a"), F.col("b")), a="night", b="nacht") == pytest.approx(0.25)
    assert one(spark, T.dice(F.col("a"), F.col("b")), a="a", b="b") == 0.0
    assert one(spark, T.longest_common(F.col("a"), F.col("b")), a="xxabcdyy", b="zabcdz") == 4
    assert one(spark, T.scrub_secrets(F.col("a")), a='Bearer abc.def {"bearer":"tok"} key SK-12 ok') == 'Bearer [redacted] {"bearer":"[redacted]"} key [redacted] ok'
    assert one(spark, T.clean_body(F.col("a")), a="<head><title>x</title></head><header>A</header>\n\n <p>B &amp;lt; C</p><script>1<2</script>") == "A\n\nB &lt; C"
    assert one(spark, T.fold_language(F.col("a")), a="ENG-us") == "en" and one(spark, T.fold_language(F.col("a")), a="qq") == "xx"
    assert one(spark, T.matter_kind(F.col("a")), a=" Title  Page ") == "front_matter"
    assert one(spark, T.strip_ruby(F.col("a")), a="<ruby>漢<rt>かん</rt>字<rp>(</rp><rt>じ</rt></ruby> の") == "漢字の"
    assert one(spark, T.strip_ruby(F.col("a")), a="漢 字") == "漢 字"
    names = [(x,) for x in ("track10", "track2", "Track1", "track01", "a")]
    found = [r.n for r in spark.createDataFrame(names, "n string").orderBy(T.natural_key(F.col("n"))).collect()]
    assert found == ["a", "Track1", "track01", "track2", "track10"]


def test_identity(spark):
    key = identity.join_key(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert one(spark, key, a=" b0x ", b=None, c=None, d="h") == "asin:B0X"
    assert one(spark, key, a=" ", b="978-3-16-148410-0", c=None, d="h") == "isbn13:9783161484100"
    assert one(spark, key, a=None, b="12", c=None, d="h") == "ch:h"
    same = [one(spark, identity.content_hash(F.col("a"), F.col("b")), a=a, b="X") for a in ("é  Title", "é title")]
    assert same[0] == same[1]


def test_candidates_follow_the_first_head(spark):
    rows = [(1, "a", "x", "p"), (2, "b", "x", "q"), (3, "b", "y", "q"), (4, "c", "y", "z"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "position long, k1 string, k2 string, k3 string").withColumn("all", F.lit(1))
    found = {r.position: r.leader for r in library.candidate_groups(df, "all", "position", ["k1", "k2", "k3"]).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_mapping_log(spark):
    ops = [(1, 1, 1, "park", 0, 0), (1, 2, 1, "park", 1, 0), (1, 3, 2, "unpark", 1, 0), (1, 4, 2, "swap", 1, 2), (1, 5, 3, "unpark", 0, 0), (1, 6, 4, "reassign", 0, 9)]
    df = spark.createDataFrame(ops, "book int, seq long, expected long, kind string, chapter long, track long")
    rows = events.mapping_log(df, "book", 3).orderBy("seq").collect()
    assert [(r.op_id, r.error) for r in rows] == [(1, None), (1, "stale"), (1, "target is not empty"), (2, None), (3, None), (3, "unknown track")]
    assert rows[-1].mapping == "0:0,1:2,2:1"


def test_detection_jobs(spark):
    kinds = [("started", "detecting_start"), ("stage_changed", "uploading"), ("detection_progress", None), ("needs_match", None), ("result", None), ("log", None)]
    df = spark.createDataFrame([(1, i, k, s) for i, (k, s) in enumerate(kinds)], "job int, seq long, kind string, stage string")
    found = [r.error for r in events.validated(df, "job", ["seq"], "kind", "stage", ["seq"]).orderBy("seq").collect()]
    assert found == [None, "stage of another kind of job", None, "a detection cannot end this way", None, "event after the end"]


def test_transcripts_find_their_chapter(spark):
    bodies = ["it was a dark and stormy night in the town", "the sun rose over the quiet hills again", "nobody had seen the captain since monday"]
    c = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "book int, pos long, body string")
    t = spark.createDataFrame([(1, "sun rose over the quiet hills")], "book int, transcript string")
    best = alignment.decided(alignment.transcript_matches(t, c, "book", "pos"), "book").first()
    assert (best.pos, best.verdict) == (1, "confident")


OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:opf="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title>A Book</dc:title><dc:creator opf:role="aut">Ann</dc:creator><dc:creator opf:role="ill">Ill</dc:creator><dc:language>en</dc:language>
<dc:identifier opf:scheme="ISBN">978-3161484100</dc:identifier></metadata><manifest><item id="a" href="a%20b.xhtml"/><item id="b" href="b.xhtml"/>
<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""
NCX = """<ncx><navMap><navPoint><navLabel><text>Part  One</text></navLabel><content src="a%20b.xhtml#x"/><navPoint><navLabel><text>Inner</text></navLabel>
<content src="a%20b.xhtml"/></navPoint></navPoint></navMap></ncx>"""


def test_book_files(spark, tmp_path):
    folder = tmp_path / "Ann" / "A Book [B012345678]"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "book.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>')
        for name, text in (("c.opf", OPF), ("toc.ncx", NCX), ("a b.xhtml", "﻿<h1>One</h1>"), ("b.xhtml", "<p>x</p>")):
            z.writestr(f"OPS/{name}", text)
    (folder / "broken.epub").write_bytes(b"no zip")
    (folder / "metadata.opf").write_text(OPF)
    (folder / "cover.jpg").write_bytes(b"x")
    (folder / "part2.m4b").write_bytes(b"x")
    (folder / "chapters.json").write_text('{"chapters": [{"title": "One", "start_offset_ms": 0, "length_ms": 1500}, {"length_ms": 5}]}')
    chpl = b"\x01\0\0\0\0\0\0\0\x02" + b"".join(struct.pack(">QB", int(s * 1e7), len(n)) + n for s, n in ((0, b"One"), (2.5, b"Two")))
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    mvhd = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 9000) + b"\0" * 80)
    (folder / "part10.m4b").write_bytes(box(b"moov", mvhd + box(b"udta", box(b"chpl", chpl))))
    with wave.open(str(folder / "s.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(np.r_[np.zeros(60), np.full(45, 16384)].astype("<i2").tobytes())
    path = str(tmp_path)
    rows = books.epub_chapters(spark, path).orderBy("pos").collect()
    assert [(r.href, r.title, r.html) for r in rows if not r.error] == [("OPS/a b.xhtml", "Part One", "<h1>One</h1>"), ("OPS/b.xhtml", None, "<p>x</p>")]
    assert sum("BadZipFile" in (r.error or "") for r in rows) == 1
    meta = books.book_metadata(spark, path).first()
    assert (meta.title, meta.authors, meta.isbn13) == ("A Book", ["Ann"], "9783161484100")
    assert [(r.title, r.start, r.end) for r in books.sidecar_chapters(spark, path).collect()] == [("One", 0.0, 1.5)]
    assert [(r.title, r.start, r.end) for r in books.mp4_chapters(spark, path).filter("title IS NOT NULL").orderBy("pos").collect()] == [("One", 0.0, 2.5), ("Two", 2.5, 9.0)]
    assert [round(r.rms, 3) for r in books.pcm_windows(spark, path).orderBy("win").collect()] == [0.0, 0.0, 0.5, 0.5]
    found = {r.source_id: r for r in books.scan(spark, {"calibre": path, "libation": path}).collect()}
    assert found["calibre"].text_source.endswith("book.epub") and found["libation"].asin == "B012345678"
    assert [a.rpartition("/")[2] for a in found["libation"].audio] == ["part2.m4b", "part10.m4b"]
    assert books.text_of("hé".encode("utf-16")) == "hé" and books.resolved("a/b.opf", "../../x") is None
    with pytest.raises(ValueError, match="latin-1"):
        books.text_of(b'<?xml encoding="latin-1"?>\xff')
    assert io.BytesIO(b"").read() == b""


def test_projects(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "project.json").write_text('{"join_key": "k", "title": "T", "receipts": [{"chapter_index": 0}, {"chapter_index": 1, "lesson_id": 7}]}')
    (tmp_path / "b.json").write_text("{broken")
    rows = {r.health: r for r in projects.read_projects(spark, str(tmp_path)).collect()}
    assert rows["ok"].cover_use and rows["ok"].schema_version == 1 and rows["ok"].skipped == [] and len(rows) == 2
    df = projects.read_projects(spark, str(tmp_path)).filter("health = 'ok'")
    patched = df.select(projects.patched_receipts(F.col("receipts"), F.lit(0), F.lit(5).cast("long")).alias("r")).first().r
    assert [x.lesson_id for x in patched] == [5, 7]
    now, change = (spark.createDataFrame(x, "k string, v int, at int") for x in ([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("c", 3, 1)]))
    assert {r.k: r.v for r in projects.upserted(now, change, "k", "at").collect()} == {"a": 2, "b": 1, "c": 3}


def test_streams_follow_the_batch_rules(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "started", "purchase": "result", "view": "stage_changed", "click": "progress", "error": "log"}.items() for x in kv])
    rows = source.select(F.col("user_id").alias("job"), "event_id", "ts", kinds[F.col("event_type")].alias("kind"), F.lit("uploading").alias("stage"))
    rows.repartition(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.validated_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(120)
    want = events.validated(rows, "job", ["event_id"], "kind", "stage", ["event_id"]).select("event_id", "error").collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("event_id", "error").collect())) == sorted(map(tuple, want))
    write = jobs.upsert_batches(str(tmp_path / "up"), ["job"], ["event_id"], ["kind"])
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = events.latest(rows, ["job"], ["event_id"], ["event_id", "kind"]).collect()
    assert sorted((r.job, r.kind) for r in spark.read.parquet(str(tmp_path / "up/batch=0")).collect()) == sorted((r.job, r.kind) for r in last)


def test_validation_of_any_order_of_events_without_a_jobs_array(spark):
    rng = random.Random(4)
    kinds = ["started", "result", "cancelled", "needs_match", "stage_changed", "detection_progress", "progress"]
    rows = [(j or None, rng.randrange(9), rng.choice(kinds), rng.choice([None, "uploading", "detecting_start"])) for j in range(150) for _ in range(10)]
    df = spark.createDataFrame(rows, "job long, seq long, kind string, stage string")
    want, at = [], {}
    for job, seq, kind, stage in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2], r[3] or "")):
        life, detection = at.get(job, ("waiting", False))
        start, end = kind == "started", kind in events.TERMINAL
        fine = life == "waiting" if start else life == "running" and not (
            (kind == "needs_match" and detection) or (kind == "stage_changed" and stage is not None and (stage == events.DETECTION) != detection)
            or (kind == "detection_progress" and not detection)
        )
        if fine and (start or end):
            life, detection = ("running", stage == events.DETECTION) if start else ("terminal", detection)
        at[job] = life, detection
        want.append((job or 0, seq, kind, fine, life))
    out = events.validated(df, "job", ["seq"], "kind", "stage", ["seq"])
    assert sorted((r.job or 0, r.seq, r.kind, r.error is None, r.life) for r in out.collect()) == sorted(want)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_candidate_groups_fold_only_the_first_of_equal_keys(spark, monkeypatch):
    rows = [(i, "p", None if i % 5 == 0 else f"a{i % 3}", None if i % 5 in (0, 1) else f"b{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "position long, part string, k1 string, k2 string")
    heads, want = {}, {}
    for i, _, a, b in rows:
        own = [(k, x) for k, x in (("k1", a), ("k2", b)) if x is not None]
        want[i] = min((heads[x] for x in own if x in heads), default=i)
        if want[i] == i:
            for x in own:
                heads.setdefault(x, i)
    folded, apply = [], GroupedData.applyInPandas

    def noted(self, func, schema):
        folded.append(self._df.count())
        return apply(self, func, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", noted)
    found = library.candidate_groups(df, "part", "position", ["k1", "k2"]).collect()
    assert len(found) == 600 and {r.position: r.leader for r in found} == want and folded[0] <= 20


def test_titles_give_a_range(spark):
    titles = ["the long rain", "the short sun", "night falls", "chapter 1", "the end of it"]  # in their form for alignment
    c = spark.createDataFrame([(b, i, t) for b in (1, 2, 3) for i, t in enumerate(titles)], "book int, pos long, title string")
    wanted = lambda rows: alignment.best_titles(spark.createDataFrame(rows, "book int, wanted string"), c, "book", "pos")
    starts, ends = wanted([(1, "the short sun"), (2, "chapter 1"), (3, "the end of it")]), wanted([(1, "the end of it"), (2, "night falls"), (3, "night falls")])
    assert {r.book: (r.pos, r.accepted) for r in starts.collect()} == {1: (1, True), 2: (3, False), 3: (4, True)}
    found = [(r.book, r.start_pos, r.end_pos, r.confidence) for r in alignment.title_range(starts, ends, "book", "pos").collect()]
    assert found == [(1, 1, 4, 1.0)]  # generic titles are never accepted, an end before the start is none


def test_transcripts_match_each_side(spark):
    bodies = ["it was a long rain that fell on the town " * 9, "the sun came out and the children ran to the river " * 9, "night fell and nobody spoke of the stranger again " * 9]
    bodies[1] += "and then the old clock struck twelve in the empty hall"
    c = spark.createDataFrame(list(enumerate(bodies)), "pos long, body string").withColumn("book", F.lit(1))
    heard = lambda text: spark.createDataFrame([(1, text)], "book int, transcript string")
    best = lambda *a, **k: alignment.decided(alignment.transcript_matches(*a, **k), "book").first()
    r = best(heard("and the children ran to the river the sun came out"), c, "book", "pos")
    assert (r.pos, r.verdict) == (1, "confident")
    r = best(heard("the old clock struck twelve in the empty hall"), c, "book", "pos", "tail", after=F.col("pos") > 0)
    assert (r.pos, r.verdict) == (1, "confident")
    assert best(heard("nobody spoke"), c, "book", "pos", "body").verdict == "poor"


def test_course_header_goes_first(spark):
    from pagewright.operators import course

    lessons = spark.createDataFrame([("a", 100, 50.0, 1.0), ("a", None, 100.0, None), ("b", None, None, None)], "c string, w long, p double, d double")
    stats = course.course_stats(lessons, "c", "w", "p", "d")
    rows = {r.c: r for r in course.with_header(stats, spark.createDataFrame([("a", 999)], "c string, total_words long"), "c", ["total_words"]).collect()}
    assert (rows["a"].lessons, rows["a"].total_words, rows["a"].progress, rows["a"].lessons_read) == (2, 999, 75, 1)
    assert (rows["b"].lessons, rows["b"].total_words, rows["b"].progress) == (1, None, None)


def test_plans_of_odd_mappings(spark):
    """Nulls, an unknown track, a missing entry, a skipped chapter's track, parked tracks."""
    from pagewright.operators import mapping

    every = spark.createDataFrame([(b, o, f"text {o}" if o else None) for b in (1, 2, 3) for o in range(5)], "book int, turn long, text string")
    c = matching.numbered(every.filter("turn <> 3"), "book", ["turn"], "pos")
    t = spark.createDataFrame([(b, k) for b in (1, 2, 3) for k in range(5)], "book int, pos long")
    m = [(1, 0, 0), (1, 1, 0), (1, 2, None), (1, 3, 3), (1, 4, 1), (2, 0, 0), (2, 1, 9), (2, 2, 1), (2, 4, 1), (3, 0, 0), (3, 1, 1), (3, 4, 2)]
    m = spark.createDataFrame(m, "book int, turn long, track long")
    assert {r.book: r.error for r in mapping.mapping_errors(c, t, m, "book", "pos", "turn").collect()} == {2: "unknown track", 3: "no entry"}
    steps = mapping.plan_of(m, spark.createDataFrame([(1, 4)], "book int, pos long"), c, every, t, "book", "pos", "turn", "text").collect()
    assert sorted((r.book, r.chapter_index, r.track, r.degraded, r.body) for r in steps) == [
        (1, 0, 0, False, "\n\ntext 1"), (1, 4, 1, False, "text 4"), (1, 7, 2, True, " "),
    ]


def test_slices_and_their_errors(spark):
    chapters = spark.createDataFrame([(b, i, f"c{i}") for b in (1, 2, 3) for i in range(4)] + [(2, 9, "c1")], "book int, pos long, id string")
    ranges = [(1, "c1", "c2"), (2, "c0", "c1"), (3, "c2", "c1"), (4, "c0", "c0"), (3, "x", "c1"), (1, "c0", None)]
    kept, errors = mapping.bounded_slice(chapters, spark.createDataFrame(ranges, "book int, start string, end string"), "book", "id", "pos")
    assert [(r.book, r.pos) for r in kept.orderBy("pos").collect()] == [(1, 1), (1, 2)]
    want = {(1, "c1"): None, (2, "c0"): "duplicate end", (3, "c2"): "reversed", (4, "c0"): "empty", (3, "x"): "missing start", (1, "c0"): "missing end"}
    assert {(r.book, r.start): r.error for r in errors.collect()} == want


def test_batches_end_after_the_longest_wait(spark):
    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=k)
    rows = [(1, at(k)) for k in (0, 200, 400, 600, 800, 2000)] + [(2, at(0)), (2, at(0)), (None, at(5)), (3, None)]
    half = datetime.timedelta(milliseconds=500)
    found = events.debounced(spark.createDataFrame(rows, "book int, ts timestamp"), "book", "ts", half, half).collect()
    assert sorted((r.book or 0, r.opened, r.changes) for r in found) == [(0, at(5), 1), (1, at(0), 3), (1, at(600), 2), (1, at(2000), 1), (2, at(0), 2)]


def test_mapping_logs_of_odd_operations(spark):
    ops = [(None, 1, 1, "park", 0, None), (1, 1, None, "park", 0, 0), (1, 2, 1, "reassign", 0, None), (1, 3, 1, None, 0, 1), (1, 4, 1, "swap", 0, None)]
    df = spark.createDataFrame(ops, "book int, seq long, expected long, kind string, chapter long, track long")
    found = {(r.book, r.seq): r.error for r in events.mapping_log(df, "book", 2).collect()}
    assert found == {(None, 1): None, (1, 1): "stale", (1, 2): "unknown track", (1, 3): "unknown operation", (1, 4): "unknown chapter"}
    assert events.mapping_log(df.limit(0), "book", 2).count() == 0


def test_malformed_tables_of_contents_keep_what_was_read():
    cut = NCX.replace("</navPoint></navMap></ncx>", "<navPoint><navLabel><text>Lost</navPoint>")
    assert books.ncx_titles(cut, "OPS/toc.ncx")["OPS/a b.xhtml"] == "Part One"
    assert books.ncx_titles("", "x") == {} and books.nav_titles("<a", "x") == {}


def test_a_failing_source_does_not_stop_the_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("b10.mp3", "b9.mp3"):
        (tmp_path / "a" / name).write_bytes(b"x")
    rows = books.scan(spark, {"libation": str(tmp_path / "none"), "other": "x", "manual": str(tmp_path)}).collect()
    found = {r.source_id: r for r in rows}
    assert len(rows) == 3 and found["manual"].title == "b9" and found["manual"].error is None
    assert found["libation"].error == "PATH_NOT_FOUND" and found["other"].error == "unknown source"


def test_summaries(spark, tmp_path):
    for name, text in {
        "a": '{"join_key": "k", "title": "T", "receipts": [{"chapter_index": 0, "degraded": true}, {"chapter_index": 1}], "completed_lesson_ids": [7], "authors": ["Ann"], '
        '"matcher_decision": {"response": "pair_drop"}, "sources": {"audio": {"kind": "single"}, "chapter_manifest": {"chapters": [{"title": "x"}, {}]}}}',
        "b": '{"join_key": "l", "receipts": [{"chapter_index": 0, "degraded": true}], "sources": {}}', "c": '{"join_key"',
    }.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = {r.project: r for r in projects.summaries(projects.read_projects(spark, str(tmp_path))).collect()}
    assert set(rows) == {"k", "l"} and len(rows["k"]) == 16
    shown = ("receipt_count", "completed_lesson_count", "has_matcher_decision", "has_audio_source", "last_receipt_degraded", "chapter_manifest_len")
    assert [tuple(rows[k][c] for c in shown) for k in "kl"] == [(2, 1, True, True, False, 2), (1, 0, False, False, True, None)]
