"""Book files as tables: EPUB packages, book metadata, chapter sidecars, MP4 chapters, PCM windows, audio folders.

Files are read by Spark's binaryFile source and decoded in Arrow batches, a file at a time; broken files give a row with
an error instead of failing the job. Only what a file says is read; sound is decoded for WAV alone.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import unicodedata
import urllib.parse
import wave
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import extension, natural_key, stem
from pagewright.sources import sound

AUDIO = ("m4b", "m4a", "mp3", "flac", "ogg", "wav", "aac")
#: Most bytes of one entry of a package.
MOST_ENTRY = 16 << 20


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decoded(df: DataFrame, decode: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of ``decode(path, content)`` for each file; a broken file gives its path and the error."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [{"path": path, **r} for r in decode(path, bytes(content))]
                except Exception as e:  # one bad file must not fail the job
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return df.select("path", "content").mapInPandas(work, schema)


def text_of(data: bytes) -> str:
    """Decode by byte order mark, else as UTF-8; anything else is an error that names the declared encoding."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        found = re.search(rb"encoding=[\"']([A-Za-z0-9._-]+)", data[:200])
        raise ValueError(f"not UTF-8 or UTF-16 (declared: {found[1].decode() if found else 'nothing'})") from None


def local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def resolved(base: str, href: str) -> str | None:
    """A link in a package as a path in it, without its fragment; null where it leaves the package or is absolute."""
    href = urllib.parse.unquote(href.split("#")[0])
    if not href or href.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href):
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), href))
    return None if path.startswith("..") else path


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MOST_ENTRY:
        raise ValueError(f"{name} is too large")
    return z.read(name)


def partial_tree(xml: str) -> ET.Element:
    """The tree of what can be read: a malformed table of contents keeps the part before its error."""
    parser = ET.XMLPullParser(["start"])
    root = ET.Element("nothing")
    try:
        parser.feed(xml)
        parser.close()
    except ET.ParseError:
        pass
    try:
        for _, node in parser.read_events():
            root = node if root.tag == "nothing" else root
    except ET.ParseError:
        pass
    return root


def ncx_titles(xml: str, base: str) -> dict[str, str]:
    """Titles by path; points are nested and the one that closes last wins, so a parent overrides its child."""
    out: dict[str, str] = {}

    def visit(node: ET.Element) -> None:
        for child in node:
            visit(child)
        if local(node.tag) == "navpoint":
            label = next((x for n in node if local(n.tag) == "navlabel" for x in n.iter() if local(x.tag) == "text"), None)
            content = next((n for n in node if local(n.tag) == "content"), None)
            path = resolved(base, content.get("src", "")) if content is not None else None
            title = re.sub(r"[ \t\r\n\f]+", " ", "".join(label.itertext())).strip(" ") if label is not None else ""
            if path and title:
                out[path] = title

    visit(partial_tree(xml))
    return out


def nav_titles(xml: str, base: str) -> dict[str, str]:
    """Titles by path of the table of contents (or the only list); the first of a path wins."""
    navs = [n for n in partial_tree(re.sub(r"&(?!#|amp;|lt;|gt;|quot;|apos;)\w+;", " ", xml)).iter() if local(n.tag) == "nav"]
    toc = [n for n in navs if any(local(k) == "type" and "toc" in v.split() for k, v in n.attrib.items())]
    out: dict[str, str] = {}
    for nav in toc[:1] or (navs if len(navs) == 1 else []):
        for a in nav.iter():
            path = resolved(base, a.get("href", "")) if local(a.tag) == "a" else None
            title = re.sub(r"[ \t\r\n\f]+", " ", "".join(a.itertext())).strip(" ")
            if path and title:
                out.setdefault(path, title)
    return out


def epub_items(path: str, data: bytes) -> Iterator[dict]:
    """One row for each spine item: pos, href, title of the contents (nav before ncx), html, linear."""
    z = zipfile.ZipFile(io.BytesIO(data))
    root = ET.fromstring(_entry(z, "META-INF/container.xml"))
    opf_path = next(n.get("full-path") for n in root.iter() if local(n.tag) == "rootfile")
    opf = ET.fromstring(_entry(z, opf_path))
    manifest = {n.get("id"): n for n in opf.iter() if local(n.tag) == "item"}
    titles: dict[str, str] = {}
    names = set(z.namelist())
    kinds = [(ncx_titles, lambda n: n.get("media-type") == "application/x-dtbncx+xml"), (nav_titles, lambda n: "nav" in (n.get("properties") or "").split())]
    for read, fits in kinds:  # the second overrides the first; a malformed table gives the titles before its error
        for item in filter(fits, manifest.values()):
            at = resolved(opf_path, item.get("href", ""))
            if at in names:
                try:
                    titles |= read(text_of(_entry(z, at)), at)
                except (ET.ParseError, ValueError):
                    continue
    refs = [n for n in opf.iter() if local(n.tag) == "itemref"]
    for pos, ref in enumerate(refs):
        item = manifest.get(ref.get("idref"))
        at = resolved(opf_path, item.get("href", "")) if item is not None else None
        if at in names:
            yield {"pos": pos, "href": at, "title": titles.get(at), "html": text_of(_entry(z, at)), "linear": ref.get("linear") != "no", "error": None}


def epub_chapters(spark: SparkSession, path: str) -> DataFrame:
    return decoded(files(spark, path, "*.epub"), epub_items, "path string, pos long, href string, title string, html string, linear boolean, error string")


def opf_metadata(path: str, data: bytes) -> Iterator[dict]:
    """Title, authors (those marked so, else all creators), language, subjects, isbn, uuid and series."""
    root = ET.fromstring(text_of(data))
    every = lambda name: [n for n in root.iter() if local(n.tag) == name]
    text = lambda n: (n.text or "").strip()
    title = next((text(n) for n in every("title") if text(n)), None)
    if not title:
        raise ValueError("no title")
    creators = every("creator")
    role = lambda n: next((v for k, v in n.attrib.items() if local(k) == "role"), None)
    authors = [text(n) for n in creators if role(n) == "aut"] or [text(n) for n in creators]
    isbn = uuid = None
    for n in every("identifier"):
        value = text(n)
        scheme = next((v.lower() for k, v in n.attrib.items() if local(k) == "scheme"), "")
        digits = re.sub(r"[ -]", "", value.lower().removeprefix("urn:isbn:").removeprefix("isbn:"))
        if (scheme == "isbn" or "isbn" in value.lower()) and re.fullmatch(r"\d{13}", digits):
            isbn = isbn or digits
        elif scheme == "uuid" or value.lower().startswith("urn:uuid:"):
            uuid = uuid or value.lower().removeprefix("urn:uuid:")
    meta = {n.get("name"): n.get("content") for n in every("meta") if n.get("name")}
    yield {
        "title": title, "authors": [a for a in authors if a], "language": next((text(n) for n in every("language") if text(n)), None),
        "subjects": [text(n) for n in every("subject") if text(n)], "isbn13": isbn, "uuid": uuid, "series": meta.get("calibre:series"),
        "series_index": float(meta["calibre:series_index"]) if meta.get("calibre:series_index") else None, "error": None,
    }


def book_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, title string, authors array<string>, language string, subjects array<string>, isbn13 string, uuid string, series string, series_index double, error string"
    return decoded(files(spark, path, "*.opf"), opf_metadata, schema)


def sidecar_rows(path: str, data: bytes) -> Iterator[dict]:
    """Chapters of a JSON sidecar: milliseconds to seconds, what is no whole number counts as 0, rows without a title are dropped."""
    chapters = json.loads(text_of(data))
    chapters = chapters.get("chapters") if isinstance(chapters, dict) else None
    whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else 0
    for pos, c in enumerate(chapters if isinstance(chapters, list) else []):
        if isinstance(c, dict) and isinstance(c.get("title"), str):
            start, length = (whole(c.get(k)) for k in ("start_offset_ms", "length_ms"))
            yield {"pos": pos, "title": c["title"], "start": start / 1000, "end": (start + length) / 1000, "error": None}


def sidecar_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of every JSON file below a folder."""
    return decoded(files(spark, path, "*.{json,JSON}"), sidecar_rows, "path string, pos long, title string, start double, end double, error string")


def text_rows(path: str, data: bytes) -> Iterator[dict]:
    yield {"text": unicodedata.normalize("NFC", text_of(data)), "error": None}


def loose_texts(spark: SparkSession, path: str) -> DataFrame:
    """Plain texts, their byte order mark dropped, in composed form."""
    return decoded(files(spark, path, "*.{txt,text,md}"), text_rows, "path string, text string, error string")


def folder_of(path: str = "path") -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def chosen_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """folder, path and chapters of the one sidecar that each folder with sound is read by.

    The file named as a folder's only sound file comes first; then the first that is named as any sound file beside it; then the first of all.
    A file without chapters is passed over, and only the first of a rule is tried by it.
    """
    chapters = sidecar_chapters(spark, path).filter("error is null")
    usable = chapters.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "start", "end"))).alias("chapters"))  # one file's
    sound = files(spark, path).select("path").filter(extension(F.col("path")).isin("m4b", "m4a")).select(folder_of().alias("folder"), stem(F.col("path")).alias("stem"))
    alone = sound.groupBy("folder").agg(F.count("*").alias("n"), F.min("stem").alias("only"))
    own = files(spark, path, "*.{json,JSON}").select("path", folder_of().alias("folder"), stem(F.col("path")).alias("stem"))
    own = own.join(alone, "folder").join(sound.distinct().withColumn("beside", F.lit(True)), ["folder", "stem"], "left").join(usable, "path", "left")
    exact = (F.col("n") == 1) & (F.col("stem") == F.col("only"))
    w = Window.partitionBy("folder")
    own = own.withColumns({"_exact": F.min(F.when(exact, F.col("path"))).over(w), "_beside": F.min(F.when(F.col("beside"), F.col("path"))).over(w)})
    rank = F.when(F.col("path") == F.col("_exact"), 1).when(F.col("path") == F.col("_beside"), 2).otherwise(3)
    best = own.filter("chapters is not null").groupBy("folder").agg(F.min_by(F.struct("path", "chapters"), F.struct(rank, "path")).alias("b"))
    return best.select("folder", "b.*")


def mp4_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of all m4a and m4b files below a folder; see ``sound``."""
    return sound.mp4_chapters(files(spark, path, "*.m4[ab]").select("path", "length"))


def durations(spark: SparkSession, path: str) -> DataFrame:
    """Durations of all sound files below a folder, by their headers."""
    return sound.durations(audio_files(spark, path).select("path", "length"))


def wav_windows(path: str, data: bytes, window_ms: int = 30) -> Iterator[dict]:
    """Root mean square of each window of the mean of all channels; the last may be partial."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples")
        rate, channels = w.getframerate(), w.getnchannels()
        sound = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, channels).mean(1) / 32768
    size = max(1, rate * window_ms // 1000)
    for win in range(-(-len(sound) // size)):
        part = sound[win * size : (win + 1) * size]
        yield {"win": win, "rms": float(np.sqrt((part * part).mean())), "samples": len(part), "rate": rate, "error": None}


def pcm_windows(spark: SparkSession, path: str) -> DataFrame:
    return decoded(files(spark, path, "*.wav"), wav_windows, "path string, win long, rms double, samples long, rate long, error string")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """Audio files below a folder that are not empty, with the key that puts them in natural order."""
    rows = files(spark, path).select("path", "length").filter(extension(F.col("path")).isin(*AUDIO))
    rows = rows.select("path", "length", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), stem(F.col("path")).alias("name"))
    return rows.withColumn("sort_key", natural_key(F.col("name")))


def calibre_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Books of an author/book library: metadata, the first EPUB and the cover of each folder that has metadata."""
    books = book_metadata(spark, path).withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).filter("error IS NULL").drop("error", "path")
    found = files(spark, path).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    per = found.groupBy("folder").agg(
        F.min(F.when(extension(F.col("path")) == "epub", F.col("path"))).alias("text_source"), F.min(F.when(name.isin("cover.jpg", "cover.jpeg", "cover.png"), F.col("path"))).alias("cover_path")
    )
    return books.join(per, "folder", "left").withColumn("source_id", F.lit("calibre"))


def asin_group(name: Column) -> Column:
    """What the last bracket of an ASIN's shape holds."""
    groups = F.filter(F.regexp_extract_all(name, F.lit(r"\[([^\]]*)\]"), 1), lambda x: x.rlike("^B0[A-Z0-9]{8}$"))
    return F.try_element_at(groups, F.lit(-1))


def without_asin(name: Column) -> Column:
    """What stands before the last bracket of an ASIN's shape; the whole name where there is none."""
    asin = asin_group(name)
    behind = F.call_function("substring_index", name, F.concat(F.lit("["), asin, F.lit("]")), F.lit(-1))
    return F.trim(F.when(asin.isNull(), name).otherwise(F.left(name, F.length(name) - F.length(behind) - 12)))


def libation_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Audio books below author/book folders with m4b or m4a files, by title: a single file or a folder, its ASIN and its sidecar's chapters."""
    root = path.rstrip("/").removeprefix("file:").lstrip("/")
    below = F.regexp_replace(F.regexp_replace("folder", "^[a-z0-9]+:/*", ""), F.lit(f"^{re.escape(root)}/"), F.lit(""))
    rows = audio_files(spark, path).filter(extension(F.col("path")).isin("m4b", "m4a")).withColumn("_b", F.split(below, "/")).filter("size(_b) = 2")
    rows = rows.groupBy("folder", "_b").agg(F.array_sort(F.collect_list(F.struct("sort_key", "path"))).alias("_f"))  # one folder's files
    rows = rows.withColumn("audio", F.transform("_f", lambda x: x["path"]))
    rows = rows.join(chosen_sidecars(spark, path).select("folder", F.col("path").alias("sidecar"), "chapters"), "folder", "left")
    name = F.col("_b")[1]
    kind = F.when(F.size("audio") == 1, "single").otherwise("folder")
    return rows.select(
        "folder", without_asin(name).alias("title"), F.array(F.col("_b")[0]).alias("authors"), asin_group(name).alias("asin"), kind.alias("audio_kind"), "audio", "sidecar", "chapters",
        F.lit("libation").alias("source_id"),
    ).orderBy("title", "folder")


#: Ends of names that a project's sound may have.
PROJECT_AUDIO = ("m4b", "m4a", "mp3", "wav", "ogg", "flac")


def audio_paths(sources: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, pos, path): the sound files of each project, in order.

    ``sources`` has kind (single, manifest, folder, multiple), path and paths; ``listed`` has the path of every file there is. A single file or a manifest is itself, there
    or not; a folder's own sound files come by path; picked files keep their order without those that are missing or no sound.
    """
    sound = listed.select("path").filter(extension(F.col("path")).isin(*PROJECT_AUDIO)).distinct()
    one = sources.filter("kind in ('single', 'manifest')").select(key, F.lit(0).alias("at"), "path")
    folder = sources.filter("kind = 'folder'").select(key, F.regexp_replace("path", "/+$", "").alias("folder"))
    held = folder.join(sound.select("path", folder_of().alias("folder")), "folder").select(key, F.lit(0).alias("at"), "path")
    picked = sources.filter("kind = 'multiple'").select(key, F.posexplode("paths").alias("at", "path")).join(sound, "path").select(key, "at", "path")
    pos = (F.row_number().over(Window.partitionBy(key).orderBy("at", "path")) - 1).cast("long")
    return one.unionByName(held).unionByName(picked).select(key, pos.alias("pos"), "path")


def manual_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Files picked by hand: the audio files of one folder are one candidate, titled by the first one's name; none without any."""
    rows = audio_files(spark, path).groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("sort_key", "path"))).alias("_f"))  # one folder's files
    return rows.select("folder", stem(F.col("_f")[0]["path"]).alias("title"), F.transform("_f", lambda x: x["path"]).alias("audio"), F.lit("manual").alias("source_id"))


#: Readers of candidates by source, in the order in which they are asked.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"manual": manual_candidates, "calibre": calibre_candidates, "libation": libation_candidates}


def scan(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Candidates of all sources; ``roots`` names the folder of each. A source whose folder cannot be read, or that is not
    known, gives one row with its error, and the others go on; error is null for candidates."""
    schema = "source_id string, error string"
    out = spark.createDataFrame([], schema)
    for name, root in sorted(roots.items(), key=lambda kv: list(SOURCES).index(kv[0]) if kv[0] in SOURCES else len(SOURCES)):
        try:
            found = SOURCES[name](spark, root) if name in SOURCES else None
            failed = None if found is not None else "unknown source"
        except AnalysisException as e:
            failed = e.getCondition() or str(e)
        rows = spark.createDataFrame([(name, failed)], schema) if failed else found.withColumn("error", F.lit(None).cast("string"))
        out = out.unionByName(rows, allowMissingColumns=True)
    return out
