"""Chapters and durations of sound files that are made byte by byte."""

import struct
import wave

import numpy as np
import pytest
from pagewright.sources import books, sound


def box(kind, *bodies):
    data = b"".join(bodies)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def full(kind, *bodies):
    return box(kind, b"\0\0\0\0", *bodies)


def u32(*n):
    return struct.pack(f">{len(n)}I", *n)


def track(number, handler, scale, length, tables=b"", refs=b"", wide=False):
    head = (b"\1\0\0\0" + bytes(16) + u32(scale) + struct.pack(">Q", length)) if wide else (bytes(12) + u32(scale, length))
    stbl = box(b"stbl", tables)
    return box(b"trak", full(b"tkhd", bytes(8), u32(number)), refs, box(b"mdia", box(b"mdhd", head), full(b"hdlr", bytes(4), handler), box(b"minf", stbl)))


def sample(text, extra=b""):
    return struct.pack(">H", len(text)) + text + extra


def book(samples, seconds, chunks, refs=(2,), wide=False, shift=0, chpl=b"", per_chunk=None):
    """A file whose text samples lie in front of the movie box, dealt to chunks as told."""
    media = box(b"mdat", *samples)
    place, at = 8 + 16, []
    sizes = [len(s) for s in samples]
    for n in chunks:
        at.append(place + shift)
        place += sum(sizes[sum(chunks[: len(at) - 1]) :][:n])
    stsc = per_chunk or [(i + 1, n, 1) for i, n in enumerate(chunks)]
    tables = b"".join([
        full(b"stts", u32(len(seconds)), *[u32(1, int(s * 1000)) for s in seconds]), full(b"stsz", u32(0, len(sizes)), u32(*sizes)),
        full(b"stsc", u32(len(stsc)), *[u32(*x) for x in stsc]),
        full(b"co64", u32(len(at)), struct.pack(f">{len(at)}Q", *at)) if wide else full(b"stco", u32(len(at), *at)),
    ])
    chap = box(b"tref", box(b"chap", u32(*refs))) if refs else b""
    movie = box(b"moov", full(b"mvhd", bytes(8), u32(1000, 9000)), track(1, b"soun", 44100, 44100 * 9, refs=chap), track(2, b"text", 1000, 9000, tables, wide=wide), box(b"udta", chpl) if chpl else b"")
    return box(b"ftyp", b"M4B \0\0\0\0") + media + movie


def chapters(spark, folder):
    rows = books.mp4_chapters(spark, f"file://{folder}").orderBy("path", "pos").collect()
    return {p: [(r.title, r.start, r.end) if r.error is None else r.error for r in rows if r.path.endswith(p)] for p in {r.path.rpartition("/")[2] for r in rows}}


CHPL = full(b"chpl", b"\2", struct.pack(">QB", 0, 3), b"Uno", struct.pack(">QB", 25_000_000, 3), b"Due")


def test_chapter_tracks(spark, tmp_path):
    three = [sample("Één".encode()), sample(b"\xef\xbb\xbfTwo\0rest"), sample(b"Three" + u32(12) + b"encd" + u32(256))]
    made = {
        "a.m4b": book(three, [1.5, 2, 4], [2, 1]),
        "b.m4b": book(three, [1.5, 2, 4], [1, 1, 1], refs=(), wide=True),  # no reference: any text track
        "c.m4a": book(three, [1.5], [3], refs=(7,)),  # a reference to nothing; times of one sample alone
        "d.m4b": book([b"", sample(b"x")], [1, 1], [2]),
        "e.m4b": book(three, [1, 1, 1], [3], chpl=CHPL, per_chunk=[(1, 2, 1)]),  # tables that disagree: the list
        "f.m4b": book(three, [1, 1, 1], [3], shift=1 << 20),
        "g.m4b": book(three, [1, 1, 1], [3])[:-30],
        "h.m4b": box(b"ftyp", b"M4B ") + box(b"mdat", b"1234"),
        "i.m4b": b"",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = chapters(spark, tmp_path)
    assert got["a.m4b"] == got["b.m4b"] == [("Één", 0, 1.5), ("Two", 1.5, 3.5), ("Three", 3.5, 7.5)]
    assert got["c.m4a"] == [("Één", 0, 1.5), ("Two", 1.5, 1.5), ("Three", 1.5, 1.5)]
    assert got["d.m4b"] == [("", 0, 1), ("x", 1, 2)]
    assert got["e.m4b"] == [("Uno", 0, 2.5), ("Due", 2.5, 9)]
    assert len(got["f.m4b"]) == 1 and got["f.m4b"][0].startswith("EOFError") and got["g.m4b"][0].startswith("ValueError")
    assert "h.m4b" not in got and "i.m4b" not in got


def test_sample_places_follow_chunks():
    kind = np.dtype([("first", ">u4"), ("n", ">u4"), ("of", ">u4")])
    rng = np.random.default_rng(3)
    for _ in range(50):
        chunks, sizes = rng.integers(0, 1 << 40, 9), rng.integers(0, 50, 30)
        first = np.unique(rng.integers(1, 10, 4))
        stsc = np.array([(f, int(rng.integers(0, 6)), 1) for f in first], kind)
        want, k = [], 0
        for c in range(9):
            n = next((int(x["n"]) for x in stsc[::-1] if x["first"] <= c + 1), 0)
            place = int(chunks[c])
            for _ in range(min(n, 30 - k)):
                want.append(place)
                place, k = place + int(sizes[k]), k + 1
        assert sound.sample_places(stsc, chunks, sizes).tolist() == want


def frame(bits=9, rate=0, mono=False, version=3, layer=3):
    head = bytes([255, 224 | version << 3 | (4 - layer) << 1 | 1, bits << 4 | rate << 2, 192 if mono else 0])
    size, *_ = sound.mpeg_frame(head)
    return head + bytes(size - 4)


def told(tag, frames, mono=False):
    data, side = bytearray(frame(mono=mono)), 17 if mono else 32
    if tag == b"VBRI":
        data[36:54] = tag + bytes(10) + u32(frames)
    else:
        data[4 + side : 16 + side] = tag + u32(1, frames)
    return bytes(data)


def test_durations(spark, tmp_path):
    id3 = b"ID3\4\0\0" + bytes([0, 0, 1, 2]) + bytes(130)
    flac = b"fLaC\0\0\0\x22" + bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 441_000).to_bytes(8, "big") + bytes(16)
    page = lambda granule, body, serial=7: b"OggS\0\0" + struct.pack("<qIIIB", granule, serial, 0, 0, 1) + bytes([len(body)]) + body
    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 22050) + bytes(10)
    opus = b"OpusHead" + struct.pack("<BBHI", 1, 1, 312, 48000) + bytes(3)
    with wave.open(str(tmp_path / "w.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(bytes(4 * 12_000))
    made = {
        "xing.mp3": id3 + told(b"Xing", 1000), "info.mp3": told(b"Info", 500, mono=True), "vbri.mp3": told(b"VBRI", 250), "plain.mp3": b"junk" + frame() * 100 + b"TAG" + bytes(125),
        "low.mp3": frame(version=2, bits=8, mono=True) * 50, "one.flac": flac, "tag.flac": id3 + flac,
        "v.ogg": page(0, vorbis) + page(-1, b"x") + page(44100, bytes(200)) + page(99, b"other", 8), "o.ogg": page(0, opus) + page(48_312, b"x"), "unknown.ogg": page(0, b"\x80theora" + bytes(9)),
        "book.m4b": book([sample(b"x")], [1], [1]), "raw.aac": b"\xff\xf1" + bytes(50), "bad.mp3": b"no sound here at all", "bad.flac": b"fLaC", "bad.wav": b"RIFF\0\0\0\0WAVE", "bad.m4a": box(b"ftyp", b"M4A "),
        "named.mp3": flac,
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "note.txt").write_text("x")
    got = {r.path.rpartition("/")[2]: r for r in books.durations(spark, f"file://{tmp_path}").collect()}
    assert got.keys() == {*made, "w.wav"}
    want = {
        "xing.mp3": 1000 * 1152 / 44100, "info.mp3": 500 * 1152 / 44100, "vbri.mp3": 250 * 1152 / 44100, "plain.mp3": 100 * 1152 / 44100, "low.mp3": 50 * 576 / 22050, "one.flac": 10, "tag.flac": 10,
        "v.ogg": 2, "o.ogg": 1, "unknown.ogg": 0, "book.m4b": 9, "raw.aac": 0, "w.wav": 1.5, "named.mp3": 10,
    }
    assert {k: r.duration for k, r in got.items() if r.error is None} == pytest.approx(want)
    assert {k for k, r in got.items() if r.error} == {"bad.mp3", "bad.flac", "bad.wav", "bad.m4a"}
    assert (got["info.mp3"].channels, got["one.flac"].channels, got["v.ogg"].rate, got["named.mp3"].format) == (1, 2, 22050, "flac")
