"""Identity keys of books: strong ids first, else a hash of title and first author."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import collapsed, normal_form


def normalised(c: Column, unicode: bool = True) -> Column:
    return F.lower(collapsed(normal_form("NFC")(c) if unicode else c))


def content_hash(title: Column, author: Column, unicode: bool = True) -> Column:
    """Hex SHA-256 of the normalised title and first author, the unit separator between; null counts as empty."""
    parts = [normalised(F.coalesce(c, F.lit("")), unicode) for c in (title, author)]
    return F.sha2(F.concat(parts[0], F.lit("\x1f"), parts[1]), 256)


#: The full-width forms of ASCII and the wide space, and what they fold to.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "


def title_hash(c: Column, unicode: bool = True) -> Column:
    """Hex SHA-256 of a title with full-width letters folded, single spaces, lower case."""
    folded = F.when(c.rlike("[\uff01-\uff5e\u3000]"), F.translate(c, FULL_WIDTH, HALF_WIDTH)).otherwise(c)  # letter by letter only where it must
    return F.sha2(normalised(folded, unicode), 256)


def valid_asin(c: Column) -> Column:
    """Trimmed, in upper case; kept even where it is malformed, null where it is blank."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def valid_isbn(c: Column) -> Column:
    digits = F.regexp_replace(c, "[ -]", "")
    return F.when(digits.rlike("^[0-9]{13}$"), digits)


def join_key(asin: Column, isbn: Column, uuid: Column, content: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("asin:"), valid_asin(asin)), F.concat(F.lit("isbn13:"), valid_isbn(isbn)), F.concat(F.lit("uuid:"), uuid), F.concat(F.lit("ch:"), content)
    )


def chapter_id(strategy: Column, href: Column, title: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", strategy, href, F.lower(collapsed(title))), 256)
    return F.concat(strategy, F.lit(":"), F.left(digest, F.lit(16)))
