"""EPUB packages as tables: every entry with its part in manifest and spine, covers by four rules, vendors by their markers.

``entries`` is read once from the files; covers and vendors are joins and aggregates over it. Texts of entries are kept as far as a rule looks: the first
``LOOKED`` bytes of pages and style sheets, and where their first image is.

Defined results: a broken file gives its path and an error and has neither cover nor vendor; a package without a cover has no row
among the covers; where several items fit a rule the first of the manifest counts, in the file name rule the first of the archive.
"""

from __future__ import annotations

import io
import posixpath
import re
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import extension, signal_label
from pagewright.operators.queue import COVER_NAMES, cover_name, vendor
from pagewright.sources.books import MOST_ENTRY, decoded, files, local, text_of

#: Pages that are looked at for markers, in the archive's order, and bytes of a page or style sheet.
PAGES_LOOKED = 12
LOOKED = 64 * 1024
#: Media types by a file name's end.
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "svg": "image/svg+xml"}

ENTRIES = (
    "path string, entry string, place long, id string, manifest_pos long, media_type string, is_cover_property boolean, is_cover_meta boolean, spine_pos long, "
    "is_guide_cover boolean, first_image string, looked string, error string"
)


def joined(base: str, href: str) -> str:
    """A link as an entry's name; dots are resolved, steps above the archive's top are dropped."""
    path = posixpath.normpath(posixpath.join("/", posixpath.dirname(base), urllib.parse.unquote(href.split("#")[0])))
    return path.lstrip("/")


def first_image(page: str) -> str | None:
    """Where the first img (or image of a drawing) of a page points."""
    found = re.search(r"""<(?:\w+:)?(?:img\b[^>]*?\bsrc|image\b[^>]*?\b(?:xlink:)?href)\s*=\s*(?:"([^"]*)"|'([^']*)')""", page, re.I)
    return (found[1] or found[2]) if found else None


def entry_rows(path: str, data: bytes) -> Iterator[dict]:
    """One row for each entry of the archive, and for each item of the manifest that the archive lacks."""
    z = zipfile.ZipFile(io.BytesIO(data))

    def read(name: str) -> bytes:
        if z.getinfo(name).file_size > MOST_ENTRY:
            raise ValueError(f"{name} is too large")
        return z.read(name)

    root = ET.fromstring(read("META-INF/container.xml"))
    opf_path = next(n.get("full-path") for n in root.iter() if local(n.tag) == "rootfile")
    opf = ET.fromstring(read(opf_path))
    nodes = list(opf.iter())
    of = lambda tag: [n for n in nodes if local(n.tag) == tag]
    meta = next((n.get("content") for n in of("meta") if n.get("name") == "cover"), None)
    guide = next((n.get("href") for n in of("reference") if (n.get("type") or "").lower() == "cover"), None)
    items = {}
    for pos, n in enumerate(of("item")):
        items.setdefault(joined(opf_path, n.get("href") or ""), (pos, n))
    spine: dict[str, int] = {}
    for pos, n in enumerate(of("itemref")):
        spine.setdefault(n.get("idref"), pos)
    names = z.namelist()
    for place, name in enumerate([*names, *(i for i in items if i not in names)]):
        pos, n = items.get(name, (None, None))
        kind, looked, image = extension_of(name), None, None
        if place < len(names) and kind in ("xhtml", "html", "htm", "css"):
            with z.open(name) as f:
                looked = f.read(LOOKED).decode("latin-1")
            if kind != "css":
                try:
                    image = first_image(text_of(read(name)))
                except ValueError:
                    image = None
        yield {
            "entry": name, "place": place if place < len(names) else None, "id": n.get("id") if n is not None else None, "manifest_pos": pos, "media_type": n.get("media-type") if n is not None else None,
            "is_cover_property": n is not None and "cover-image" in (n.get("properties") or "").split(), "is_cover_meta": n is not None and meta is not None and n.get("id") == meta,
            "spine_pos": spine.get(n.get("id")) if n is not None else None, "is_guide_cover": guide is not None and joined(opf_path, guide) == name,
            "first_image": joined(name, image) if image else None, "looked": looked, "error": None,
        }


def extension_of(name: str) -> str:
    return name.rpartition(".")[2].lower()


def entries(spark: SparkSession, path: str) -> DataFrame:
    return decoded(files(spark, path, "*.epub"), entry_rows, ENTRIES)


def covers(rows: DataFrame) -> DataFrame:
    """path, rung (property, meta, guide or name), entry, mime, sidecar and host (the first page of the spine that shows it), one row a package with a cover."""
    rows = rows.filter("error is null")
    guessed = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[extension(F.col("entry"))]
    mime = F.coalesce("media_type", guessed, F.lit("application/octet-stream"))
    own = rows.select("path", "entry", mime.alias("mime"))
    pages = rows.filter("first_image is not null and spine_pos is not null and media_type like '%html%'")
    hosts = pages.groupBy("path", F.col("first_image").alias("entry")).agg(F.min_by("entry", "spine_pos").alias("host"))
    shown = rows.filter("is_guide_cover and first_image is not null").select("path", F.col("first_image").alias("entry"), F.col("entry").alias("page"))

    def rung(found: DataFrame, rank: int, name: str, order: Column, page: Column | None = None) -> DataFrame:
        return found.select("path", "entry", F.lit(rank).alias("rank"), F.lit(name).alias("rung"), order.cast("long").alias("at"), (F.lit(None).cast("string") if page is None else page).alias("page"))

    base = F.lower(F.element_at(F.split("entry", "/"), -1))
    named = rows.filter(base.isin("cover.jpg", "cover.jpeg", "cover.png", "cover.webp") & ~F.lower("entry").rlike("(^|/)_covers/") & F.col("place").isNotNull())
    found = (
        rung(rows.filter("is_cover_property"), 1, "property", F.col("manifest_pos")).unionByName(rung(rows.filter("is_cover_meta"), 2, "meta", F.col("manifest_pos")))
        .unionByName(rung(shown, 3, "guide", F.lit(0), F.col("page"))).unionByName(rung(named, 4, "name", F.col("place")))
    )
    first = found.groupBy("path").agg(F.min_by(F.struct("entry", "rung", "page"), F.struct("rank", "at")).alias("f")).select("path", "f.*")
    # an image that the guide's page shows need not be in the manifest, nor in the archive
    out = first.join(own, ["path", "entry"], "left").join(hosts, ["path", "entry"], "left")
    kind = F.coalesce("mime", guessed, F.lit("application/octet-stream"))
    host = F.when(F.col("rung") == "guide", F.col("page")).when(F.col("rung").isin("property", "meta"), F.col("host"))
    return out.select("path", "rung", "entry", kind.alias("mime"), cover_name(kind).alias("sidecar"), host.alias("host"))


def marker_counts(rows: DataFrame) -> DataFrame:
    """kobo_span, font_per and kindle markers of each page and style sheet that is looked at, comments left out."""
    kind = extension(F.col("entry"))
    looked = rows.filter("error is null and place is not null").select("path", "entry", "place", "looked", kind.isin("xhtml", "html", "htm").alias("page"), (kind == "css").alias("css"), (kind == "ncx").alias("ncx"))
    nth = F.row_number().over(Window.partitionBy("path", "page").orderBy("place"))
    looked = looked.withColumn("nth", nth).filter(F.col("css") | F.col("ncx") | (F.col("page") & (F.col("nth") <= PAGES_LOOKED)))
    text = F.lower(F.when(F.col("page"), F.regexp_replace("looked", r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(F.regexp_replace("looked", r"(?s)/\*.*?(?:\*/|\z)", "")))
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    return looked.select(
        "path", "page", "ncx", F.when(F.col("page"), count("kobospan")).otherwise(0).alias("kobo_span"), F.when(F.col("page"), count("font-1[246]0per")).otherwise(0).alias("font_per"),
        count('amzn-page-break|kindle:embed|kindle:position|kf8|"calibre').alias("kindle"),
    )


def vendors(rows: DataFrame) -> DataFrame:
    """path, vendor, confidence and signals of each package that can be read."""
    own = marker_counts(rows).withColumn("kobo", F.col("kobo_span") + F.col("font_per"))
    per = own.groupBy("path").agg(
        F.max("kobo_span").alias("span"), F.max("font_per").alias("font"), F.max("kobo").alias("most"), F.sum("kobo").alias("total"), F.count_if(F.col("kobo") > 0).alias("files"),
        F.sum("kindle").alias("kindle"), F.bool_or("ncx").alias("ncx"),
    )
    all_of = rows.filter("error is null").select("path").distinct().join(per, "path", "left").fillna(0).withColumn("ncx", F.coalesce("ncx", F.lit(False)))
    kind, sure = vendor(F.col("most"), F.col("total"), F.col("files"), F.col("kindle"), F.col("ncx"))
    signals = [F.when(F.col(c) > 0, signal_label(n, F.col(c))) for n, c in (("kobo_span", "span"), ("font_per", "font"), ("kindle_marker", "kindle"))]
    return all_of.select("path", kind.alias("vendor"), sure.alias("confidence"), F.array_compact(F.array(*signals, F.when(F.col("ncx"), "toc_ncx"))).alias("signals"))


def write_sidecars(spark: SparkSession, path: str, found: DataFrame, folder: str) -> DataFrame:
    """(path, sidecar, file) of covers that are written below ``folder`` in one Parquet table of names and bytes, for a sink to place.

    The bytes of a cover leave its package in the task that reads it; nothing passes through the driver.
    """
    wanted = files(spark, path, "*.epub").select("path", "content").join(found.select("path", "entry", "sidecar"), "path")

    def work(batches):
        for pdf in batches:
            kept = []
            for p, content, entry, name in zip(pdf["path"], pdf["content"], pdf["entry"], pdf["sidecar"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                if entry in z.namelist() and z.getinfo(entry).file_size <= MOST_ENTRY:
                    kept.append((p, name or f"cover.{extension_of(entry)}", z.read(entry)))
            yield pdf.__class__(kept, columns=["path", "sidecar", "bytes"])

    wanted.mapInPandas(work, "path string, sidecar string, bytes binary").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


__all__ = ["COVER_NAMES", "covers", "entries", "marker_counts", "vendors", "write_sidecars"]
