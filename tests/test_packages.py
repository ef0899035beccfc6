"""Covers and vendors of packages that are made here."""

import io
import zipfile

import pytest
from pagewright.sources import packages as P


def package(opf, files, container=True, opf_path="OEBPS/content.opf"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if container:
            z.writestr("META-INF/container.xml", f'<container><rootfiles><rootfile full-path="{opf_path}"/></rootfiles></container>')
        z.writestr(opf_path, opf)
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def opf(items, spine=(), extra=""):
    manifest = "".join(f'<item id="{i}" href="{h}" media-type="{m}" properties="{p}"/>' for i, h, m, p in items)
    return f"<package><metadata>{extra if 'meta' in extra else ''}</metadata><manifest>{manifest}</manifest><spine>{''.join(f'<itemref idref="{s}"/>' for s in spine)}</spine>{'' if 'meta' in extra else extra}</package>"


XHTML = "application/xhtml+xml"
PAGE = '<html><body><img alt="x" src="../img/a.jpg"/></body></html>'
ITEMS = [("p1", "text/p1.xhtml", XHTML, ""), ("c", "text/c.xhtml", XHTML, ""), ("a", "img/a.jpg", "image/jpeg", ""), ("b", "img/b.png", "image/png", "")]
FILES = {"OEBPS/text/p1.xhtml": "<p>no picture</p>", "OEBPS/text/c.xhtml": PAGE, "OEBPS/img/a.jpg": b"A", "OEBPS/img/b.png": b"B"}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("epub")
    prop = [*ITEMS[:2], ("a", "img/a.jpg", "image/jpeg", "cover-image svg"), ITEMS[3]]
    page = lambda n, mark: {f"OEBPS/x{i}.xhtml": mark for i in range(n)}
    books = {
        "property": package(opf(prop, ["p1", "c"], '<meta name="cover" content="b"/>'), FILES),
        "meta": package(opf(ITEMS, ["p1", "c"], '<meta name="cover" content="b"/>'), FILES),
        "guide": package(opf(ITEMS, ["p1"], '<guide><reference type="cover" href="text/c.xhtml#top"/></guide>'), FILES),
        "undeclared": package(opf(ITEMS[:2], ["c"], '<guide><reference type="Cover" href="text/c.xhtml"/></guide>'), FILES),
        "name": package(opf(ITEMS[:1], ["p1"]), {"OEBPS/_covers/cover.jpg": b"no", "OEBPS/images/COVER.PNG": b"yes", "cover.jpg": b"later"}),
        "nothing": package(opf(ITEMS, ["p1"], '<meta name="cover" content="gone"/>'), FILES),
        "kobo": package(opf([]), page(1, '<span class="koboSpan"/>' * 7)),
        "spread": package(opf([]), page(3, '<i class="font-140per"/>')),
        "kindle": package(opf([]), {"a.css": '.x{content:"calibre"} /* kf8 kf8 */', "b.css": "/* open KF8", **page(2, "<!-- kf8 --> Kindle:Embed <!-- kf8")}),
        "ncx": package(opf([]), {"toc.ncx": "<ncx/>"}),
        "ncx1": package(opf([]), {"toc.NCX": "<ncx/>", "a.html": "kf8"}),
        "weak": package(opf([]), page(2, "koboSpan")),
        "late": package(opf([]), {**page(12, "plain"), **{f"OEBPS/y{i}.xhtml": "koboSpan" * 9 for i in range(5)}}),
        "deep": package(opf([]), {"a.htm": " " * (64 * 1024) + "koboSpan" * 9, "b.htm": " " * (64 * 1024 - 24) + "koboSpan" * 9}),
        "twelve": package(opf([]), page(1, "koboSpan font-120per " * 13)),
        "broken": b"no archive",
        "bare": package(opf([]), {}, container=False),
    }
    for name, data in books.items():
        (folder / f"{name}.epub").write_bytes(data)
    return f"file://{folder}", P.entries(spark, f"file://{folder}").cache()


def name_of(path):
    return path.rpartition("/")[2].removesuffix(".epub")


def test_covers_by_four_rules(made):
    got = {name_of(r.path): (r.rung, r.entry, r.mime, r.sidecar, r.host) for r in P.covers(made[1]).collect()}
    assert got == {
        "property": ("property", "OEBPS/img/a.jpg", "image/jpeg", "cover.jpg", "OEBPS/text/c.xhtml"), "meta": ("meta", "OEBPS/img/b.png", "image/png", "cover.png", None),
        "guide": ("guide", "OEBPS/img/a.jpg", "image/jpeg", "cover.jpg", "OEBPS/text/c.xhtml"), "undeclared": ("guide", "OEBPS/img/a.jpg", "image/jpeg", "cover.jpg", "OEBPS/text/c.xhtml"),
        "name": ("name", "OEBPS/images/COVER.PNG", "image/png", "cover.png", None),
    }


def test_vendors_by_markers(made):
    got = {name_of(r.path): (r.vendor, pytest.approx(r.confidence), r.signals) for r in P.vendors(made[1]).collect()}
    want = {
        "kobo": ("kobo", 0.6 + 7 / 30, ["kobo_span_x6+"]), "spread": ("kobo", 0.7, ["font_per_x1"]), "kindle": ("kindle", 0.75, ["kindle_marker_x3+"]), "ncx": ("kindle", 0.6, ["toc_ncx"]),
        "ncx1": ("kindle", 0.65, ["kindle_marker_x1", "toc_ncx"]), "weak": ("generic", 0.35, ["kobo_span_x1"]), "late": ("generic", 0.2, []), "deep": ("kobo", 0.7, ["kobo_span_x3+"]),
        "twelve": ("kobo", 0.99, ["kobo_span_x12+", "font_per_x12+"]),
    }
    assert {k: got[k] for k in want} == want
    assert "broken" not in got and "bare" not in got and len(got) == 15


def test_broken_packages_and_sidecars(spark, made, tmp_path):
    assert {name_of(r.path) for r in made[1].filter("error is not null").collect()} == {"broken", "bare"}
    kept = P.write_sidecars(spark, made[0], P.covers(made[1]), f"file://{tmp_path}/covers")
    assert {name_of(r.path): (r.sidecar, bytes(r.bytes)) for r in kept.collect()} == {
        "property": ("cover.jpg", b"A"), "meta": ("cover.png", b"B"), "guide": ("cover.jpg", b"A"), "undeclared": ("cover.jpg", b"A"), "name": ("cover.png", b"yes"),
    }
