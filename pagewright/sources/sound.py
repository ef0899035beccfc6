"""What sound files say in their headers: chapters of MP4 files and durations, without decoding and without reading whole files.

Spark lists the files (paths and lengths alone, contents are never loaded); a task opens each of its files and reads the byte ranges that hold
headers and tables, so a file of many gigabytes costs some reads of kilobytes.

Defined results: a file without chapters gives no row; a file whose boxes or headers contradict themselves gives its path and the error; a
duration that a file does not say is 0.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from contextlib import closing
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of a table or text that are read at once at most; more is an error.
MOST_BODY = 64 << 20


class Ranges:
    """Byte ranges of one file. Paths of the local file system are opened as such, others by Arrow's file systems."""

    def __init__(self, path: str, size: int):
        self.size = size
        if urlparse(path).scheme in ("", "file"):
            self._file = open(unquote(urlparse(path).path), "rb")  # noqa: SIM115  closed by close()
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            self._file = system.open_input_file(inner)

    def read(self, at: int, n: int) -> bytes:
        """Exactly n bytes from ``at``; an error where the file ends before."""
        if n < 0 or n > MOST_BODY:
            raise ValueError(f"{n} bytes at once")
        self._file.seek(at)
        data = self._file.read(n)
        if len(data) < n:
            raise EOFError(f"the file ends within {n} bytes at {at}")
        return data

    def some(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``."""
        return self.read(at, max(0, min(n, self.size - at)))

    def close(self) -> None:
        self._file.close()


def read_ranges(listed: DataFrame, decode: Callable[[str, Ranges], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of ``decode(path, ranges)`` for each file of (path, length); a broken file gives its path and the error."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[dict] = []
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                try:
                    with closing(Ranges(path, int(length))) as file:
                        rows += [{"path": path, **r} for r in decode(path, file)]
                except Exception as e:  # one bad file must not fail the job
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return listed.select("path", "length").mapInPandas(work, schema)


# MP4 boxes


def boxes(file: Ranges, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes in a span, headers read alone."""
    while begin + 8 <= end:
        size, kind = struct.unpack(">I4s", file.read(begin, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", file.read(begin + 8, 8))[0], 16
        size = size or end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} reaches past its parent")
        yield kind, begin + head, begin + size
        begin += size


def inside(file: Ranges, span: tuple[int, int], *kinds: bytes) -> tuple[int, int] | None:
    """The first box along a path of kinds."""
    for kind in kinds:
        span = next(((b, e) for k, b, e in boxes(file, *span) if k == kind), None)
        if span is None:
            return None
    return span


def body(file: Ranges, span: tuple[int, int] | None) -> bytes | None:
    return None if span is None else file.read(span[0], span[1] - span[0])


def _table(data: bytes, kind: str, head: int = 8) -> np.ndarray:
    """The entries of a full box: as many as its count says and as it holds."""
    if len(data) < head:
        return np.empty(0, kind)
    count = struct.unpack_from(">I", data, head - 4)[0]
    return np.frombuffer(data, kind, min(count, (len(data) - head) // np.dtype(kind).itemsize), head)


def _wide(data: bytes | None, narrow: str, wide: str) -> tuple | None:
    """The fields after a full box's two times, which are 4 or 8 bytes each."""
    if not data:
        return None
    kind, at = (wide, 20) if data[0] == 1 else (narrow, 12)
    return struct.unpack_from(kind, data, at) if len(data) >= at + struct.calcsize(kind) else None


def _handler(file: Ranges, track: tuple[int, int]) -> bytes | None:
    data = body(file, inside(file, track, b"mdia", b"hdlr"))
    return data[8:12] if data and len(data) >= 12 else None


def sample_places(stsc: np.ndarray, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each sample's byte place: chunks hold as many samples as the last entry at or before them says, one behind the other."""
    first = stsc["first"].astype(np.int64) - 1
    entry = np.searchsorted(first, np.arange(len(chunks)), "right") - 1
    per = np.where(entry >= 0, stsc["n"].astype(np.int64)[np.maximum(entry, 0)], 0) if len(stsc) else np.zeros(len(chunks), np.int64)
    upto = np.minimum(np.cumsum(per), len(sizes))
    chunk = np.repeat(np.arange(len(chunks)), np.diff(np.concatenate([[0], upto])))
    before = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    own_first = np.concatenate([[0], upto])[:-1]  # the first sample of each chunk
    return chunks.astype(np.int64)[chunk] + before[: len(chunk)] - before[own_first[chunk]]


def _title(data: bytes) -> str:
    """A text sample: its length, then UTF-8 up to a zero byte or a box of its encoding."""
    if len(data) < 2:
        return ""
    text = data[2 : 2 + struct.unpack_from(">H", data)[0]].removeprefix(b"\xef\xbb\xbf")
    at = text.find(b"encd")
    text = text[: max(0, at - 4)] if at >= 0 else text
    return text.split(b"\0")[0].decode("utf-8", "replace")


def _track_chapters(file: Ranges, track: tuple[int, int]) -> list[tuple[float, float, str]]:
    """(start, end, title) of the samples of a text track; none where a table is missing or they disagree."""
    scale = _wide(body(file, inside(file, track, b"mdia", b"mdhd")), ">I", ">I")
    table = inside(file, track, b"mdia", b"minf", b"stbl")
    if not scale or not scale[0] or table is None:
        return []
    found = {k: (b, e) for k, b, e in reversed(list(boxes(file, *table)))}
    times, size, to_chunk = (body(file, found.get(k)) for k in (b"stts", b"stsz", b"stsc"))
    chunks = _table(body(file, found[b"stco"]), ">u4") if b"stco" in found else _table(body(file, found[b"co64"]), ">u8") if b"co64" in found else None
    if times is None or size is None or to_chunk is None or chunks is None or len(size) < 12:
        return []
    common, count = struct.unpack_from(">II", size, 4)
    if common and count > file.size // common:
        raise ValueError("more samples than the file has bytes")
    sizes = np.full(count, common, np.int64) if common else _table(size, ">u4", 12).astype(np.int64)
    places = sample_places(_table(to_chunk, np.dtype([("first", ">u4"), ("n", ">u4"), ("of", ">u4")])), chunks, sizes)
    if not len(sizes) or len(places) != len(sizes):
        return []
    runs = _table(times, np.dtype([("n", ">u4"), ("units", ">u4")]))
    upto = np.minimum(np.cumsum(runs["n"].astype(np.int64)), len(sizes))
    units = np.zeros(len(sizes), np.int64)  # a sample beyond the table lasts no time
    held = np.repeat(runs["units"].astype(np.int64), np.diff(np.concatenate([[0], upto])))
    units[: len(held)] = held
    edges = np.concatenate([[0], np.cumsum(units)]) / scale[0]
    return [(float(edges[i]), float(edges[i + 1]), _title(file.read(int(p), int(n)))) for i, (p, n) in enumerate(zip(places, sizes, strict=True))]


def _listed_chapters(file: Ranges, movie: tuple[int, int]) -> list[tuple[float, float, str | None]]:
    """Chapters of the chpl box: starts in units of 100 ns; the last one ends with the movie."""
    data = body(file, inside(file, movie, b"udta", b"chpl"))
    if data is None or len(data) < 5:
        return []
    at = 5 if data[0] == 0 else 9
    found: list[tuple[float, str]] = []
    for _ in range(data[at - 1] if len(data) >= at else 0):
        if at + 9 > len(data) or at + 9 + data[at + 8] > len(data):
            break
        start, n = struct.unpack_from(">QB", data, at)
        found.append((start / 1e7, data[at + 9 : at + 9 + n].decode("utf-8", "replace")))
        at += 9 + n
    length = _wide(body(file, inside(file, movie, b"mvhd")), ">II", ">IQ")
    last = length[1] / length[0] if length and length[0] else 0.0
    starts = [s for s, _ in found]
    return [(s, e, t or None) for (s, t), e in zip(found, [*starts[1:], max([last, *starts[-1:]])], strict=True)]


def mp4_chapter_rows(path: str, file: Ranges) -> Iterator[dict]:
    """Chapters of the text track that the sound's track refers to, else of any text track, else of the chpl box."""
    movie = inside(file, (0, file.size), b"moov")
    if movie is None:
        return
    tracks = [(b, e) for k, b, e in boxes(file, *movie) if k == b"trak"]
    handlers = [_handler(file, t) for t in tracks]
    named: set[int] = set()
    for track, kind in zip(tracks, handlers, strict=True):
        data = body(file, inside(file, track, b"tref", b"chap")) if kind == b"soun" else None
        if data is not None:
            named = set(struct.unpack(f">{len(data) // 4}I", data[: len(data) // 4 * 4]))
            break
    ids = [_wide(body(file, inside(file, t, b"tkhd")), ">I", ">I") for t in tracks]
    chosen = next((t for t, i in zip(tracks, ids, strict=True) if i and i[0] in named), None)
    chosen = chosen or next((t for t, h in zip(tracks, handlers, strict=True) if h in (b"text", b"sbtl")), None)
    found = _track_chapters(file, chosen) if chosen else []
    kind = "track" if found else "list"
    for pos, (start, end, title) in enumerate(found or _listed_chapters(file, movie)):
        yield {"pos": pos, "title": title, "start": start, "end": end, "kind": kind, "error": None}


# Durations


def _tagged(file: Ranges) -> int:
    """Where the sound begins, behind ID3 tags."""
    at = 0
    while (head := file.some(at, 10))[:3] == b"ID3" and len(head) == 10:
        size = 0
        for b in head[6:]:
            size = size << 7 | b & 127
        at += 10 + size + (10 if head[5] & 16 else 0)
    return at


#: Kilobits a second by layer table, and rates, of MPEG sound.
_BITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = (44100, 48000, 32000)


def mpeg_frame(head: bytes) -> tuple[int, int, int, int, int] | None:
    """(bytes, samples, rate, channels, bytes of side information) of a frame, None where these four bytes begin none."""
    if len(head) < 4 or head[0] != 255 or head[1] & 224 != 224:
        return None
    version, layer, bits, rate = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    hertz = _RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    first = version == 3
    per_second = 1000 * _BITS[(1, layer) if first else (2, min(layer, 2))][bits]
    samples = 384 if layer == 1 else 1152 if first or layer == 2 else 576
    padding = head[2] >> 1 & 1
    size = (12 * per_second // hertz + padding) * 4 if layer == 1 else samples // 8 * per_second // hertz + padding
    channels = 1 if head[3] >> 6 == 3 else 2
    side = (17 if channels == 1 else 32) if first else 9 if channels == 1 else 17
    return size, samples, hertz, channels, side


def _mp3(file: Ranges) -> tuple[int, int, int]:
    """(samples, rate, channels): the frames that a Xing, Info or VBRI header counts, else as many as the first frames' mean size gives."""
    begin = _tagged(file)
    at, data = begin, file.some(begin, 1 << 16)
    while at - begin + 4 <= len(data):  # the first frame that another one follows, or the end
        frame = mpeg_frame(data[at - begin : at - begin + 4])
        after = file.some(at + frame[0], 4) if frame else b""
        if frame and (len(after) < 4 or mpeg_frame(after)):
            break
        at += 1
    else:
        raise ValueError("no MPEG frame")
    size, samples, rate, channels, side = frame
    own = file.some(at, max(size, 64))
    tag = own[4 + side : 8 + side]
    if tag in (b"Xing", b"Info") and own[11 + side] & 1:
        return struct.unpack_from(">I", own, 12 + side)[0] * samples, rate, channels
    if own[36:40] == b"VBRI":
        return struct.unpack_from(">I", own, 50)[0] * samples, rate, channels
    total, n, place = 0, 0, at
    while n < 16 and (frame := mpeg_frame(file.some(place, 4))):
        total, n, place = total + frame[0], n + 1, place + frame[0]
    end = file.size - (128 if file.size - at > 128 and file.read(file.size - 128, 3) == b"TAG" else 0)
    return (end - at) * n // total * samples, rate, channels


def _flac(file: Ranges) -> tuple[int, int, int]:
    at = _tagged(file)
    data = file.read(at, 42)
    if data[:4] != b"fLaC" or data[4] & 127:
        raise ValueError("no STREAMINFO")
    packed = int.from_bytes(data[18:26], "big")
    return packed & (1 << 36) - 1, packed >> 44, (packed >> 41 & 7) + 1


def _ogg(file: Ranges) -> tuple[int, int, int]:
    """Samples by the last page's granule of the first sound stream."""
    head = file.some(0, 1 << 16)
    if head[:4] != b"OggS" or len(head) < 28:
        raise ValueError("no Ogg page")
    serial, first = head[14:18], head[27 + head[26] :]
    if first[:7] == b"\x01vorbis":
        channels, rate, skip = first[11], struct.unpack_from("<I", first, 12)[0], 0
    elif first[:8] == b"OpusHead":
        channels, rate, skip = first[9], 48000, struct.unpack_from("<H", first, 10)[0]
    else:
        return 0, 0, 0
    end = file.size
    while end > 0:  # from the end, page by page at most 64 KiB apart
        begin = max(0, end - (1 << 16))
        data = file.some(begin, end - begin + 26)
        at = data.rfind(b"OggS")
        while at >= 0:
            granule = struct.unpack_from("<q", data, at + 6)[0] if len(data) >= at + 18 else -1
            if granule >= 0 and data[at + 14 : at + 18] == serial:
                return max(0, granule - skip), rate, channels
            at = data.rfind(b"OggS", 0, at)
        end = begin
    return 0, rate, channels


def _wav(file: Ranges) -> tuple[int, int, int]:
    data = file.read(0, 12)
    if data[:4] not in (b"RIFF", b"RF64") or data[8:] != b"WAVE":
        raise ValueError("no WAVE file")
    at, form, long_size = 12, None, None
    while at + 8 <= file.size:
        kind, size = struct.unpack("<4sI", file.read(at, 8))
        if kind == b"ds64":
            long_size = struct.unpack("<Q", file.read(at + 16, 8))[0]
        elif kind == b"fmt ":
            form = struct.unpack("<HHIIH", file.read(at + 8, 14))
        elif kind == b"data" and form and form[4]:
            size = long_size if size == 0xFFFFFFFF and long_size is not None else size
            return min(size, file.size - at - 8) // form[4], form[2], form[1]
        at += 8 + size + (size & 1)
    raise ValueError("no sound data")


def _mp4(file: Ranges) -> tuple[int, int, int]:
    """Units and their number a second of the first sound track; its channels."""
    movie = inside(file, (0, file.size), b"moov")
    for kind, b, e in boxes(file, *movie) if movie else ():
        if kind == b"trak" and _handler(file, (b, e)) == b"soun":
            length = _wide(body(file, inside(file, (b, e), b"mdia", b"mdhd")), ">II", ">IQ")
            told = body(file, inside(file, (b, e), b"mdia", b"minf", b"stbl", b"stsd"))
            channels = struct.unpack_from(">H", told, 32)[0] if told and len(told) >= 34 else 0
            unknown = length is not None and length[1] in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF)
            return (0 if unknown or length is None else length[1]), (length[0] if length else 0), channels
    raise ValueError("no sound track")


READERS: dict[str, Callable[[Ranges], tuple[int, int, int]]] = {"mp3": _mp3, "flac": _flac, "ogg": _ogg, "opus": _ogg, "oga": _ogg, "wav": _wav, "m4a": _mp4, "m4b": _mp4, "mp4": _mp4}


def duration_rows(path: str, file: Ranges) -> Iterator[dict]:
    """By what the file's beginning says, else by its name's end; kinds that say no length (raw AAC) have 0."""
    head, name = file.some(0, 12), path.rpartition(".")[2].lower()
    told = {b"fLaC": "flac", b"OggS": "ogg", b"RIFF": "wav", b"RF64": "wav"}.get(head[:4]) or ("mp4" if head[4:8] == b"ftyp" else None)
    reader = READERS.get(told or name)
    frames, rate, channels = reader(file) if reader else (0, 0, 0)
    kind = told if told and READERS[told] is not READERS.get(name) else name
    yield {"format": kind, "frames": frames, "rate": rate, "channels": channels, "duration": frames / rate if rate else 0.0, "error": None}


def mp4_chapters(listed: DataFrame) -> DataFrame:
    """Chapters of each MP4 file of (path, length)."""
    return read_ranges(listed, mp4_chapter_rows, "path string, pos long, title string, start double, end double, kind string, error string")


def durations(listed: DataFrame) -> DataFrame:
    """format, frames, rate, channels and duration in seconds of each sound file of (path, length)."""
    return read_ranges(listed, duration_rows, "path string, format string, frames long, rate long, channels long, duration double, error string")
