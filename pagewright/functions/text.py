"""Text columns: normal forms, similarities, markup cleaning, titles, languages, paths.

Everything is a native column expression but ``normal_form`` and ``longest_common``, for which Spark has no
expression; these are Arrow-batched.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Exact normalised titles of front and back matter.
FRONT_MATTER = (
    "cover", "title", "title page", "copyright", "imprint", "dedication", "epigraph", "preface", "foreword", "prologue", "contents",
    "table of contents", "目次", "まえがき", "はじめに", "序文", "序章",
)
BACK_MATTER = (
    "acknowledgments", "acknowledgements", "about the author", "about the publisher", "afterword", "epilogue", "appendix", "bibliography",
    "glossary", "index", "notes", "colophon", "奥付", "あとがき", "解説", "謝辞",
)
#: Words that with a number make a title say nothing.
TITLE_KEYWORDS = (
    "chapter", "track", "part", "глава", "часть", "трек", "kapitel", "teil", "spur", "capítulo", "capitulo", "parte", "pista", "chapitre",
    "partie", "piste", "トラック", "パート",
)
#: Codes with an equivalent of two letters.
LANGUAGE_FOLD = {
    "ja": "ja", "jpn": "ja", "jap": "ja", "en": "en", "eng": "en", "zh": "zh", "chi": "zh", "zho": "zh", "fr": "fr", "fra": "fr", "fre": "fr",
    "de": "de", "ger": "de", "deu": "de", "es": "es", "spa": "es", "it": "it", "ita": "it", "pt": "pt", "por": "pt", "ru": "ru", "rus": "ru",
    "ko": "ko", "kor": "ko",
}
#: Other codes of two letters that stay.
LANGUAGES_KEPT = (
    "aa", "ab", "af", "ak", "ar", "as", "az", "be", "bg", "bn", "bo", "bs", "ca", "cs", "cy", "da", "el", "et", "fa", "fi", "ga", "gl", "gu", "he",
    "hi", "hr", "hu", "hy", "id", "is", "ka", "kk", "km", "kn", "ky", "la", "lo", "lt", "lv", "mk", "ml", "mn", "mr", "ms", "my", "ne", "nl", "no",
    "pa", "pl", "ro", "si", "sk", "sl", "so", "sq", "sr", "sv", "sw", "ta", "te", "th", "tl", "tr", "uk", "ur", "uz", "vi", "yi", "zu",
)
#: Three-letter codes that a transcription service's hint may stand for.
HINT_ALIASES = {"eng": "en", "jpn": "ja", "rus": "ru", "spa": "es", "deu": "de"}
#: The two-letter codes of ISO 639-1.
ISO_639_1 = (
    "aa", "ab", "ae", "af", "ak", "am", "an", "ar", "as", "av", "ay", "az", "ba", "be", "bg", "bh", "bi", "bm", "bn", "bo", "br", "bs", "ca", "ce",
    "ch", "co", "cr", "cs", "cu", "cv", "cy", "da", "de", "dv", "dz", "ee", "el", "en", "eo", "es", "et", "eu", "fa", "ff", "fi", "fj", "fo", "fr",
    "fy", "ga", "gd", "gl", "gn", "gu", "gv", "ha", "he", "hi", "ho", "hr", "ht", "hu", "hy", "hz", "ia", "id", "ie", "ig", "ii", "ik", "io", "is",
    "it", "iu", "ja", "jv", "ka", "kg", "ki", "kj", "kk", "kl", "km", "kn", "ko", "kr", "ks", "ku", "kv", "kw", "ky", "la", "lb", "lg", "li", "ln",
    "lo", "lt", "lu", "lv", "mg", "mh", "mi", "mk", "ml", "mn", "mr", "ms", "mt", "my", "na", "nb", "nd", "ne", "ng", "nl", "nn", "no", "nr", "nv",
    "ny", "oc", "oj", "om", "or", "os", "pa", "pi", "pl", "ps", "pt", "qu", "rm", "rn", "ro", "ru", "rw", "sa", "sc", "sd", "se", "sg", "si", "sk",
    "sl", "sm", "sn", "so", "sq", "sr", "ss", "st", "su", "sv", "sw", "ta", "te", "tg", "th", "ti", "tk", "tl", "tn", "to", "tr", "ts", "tt", "tw",
    "ty", "ug", "uk", "ur", "uz", "ve", "vi", "vo", "wa", "wo", "xh", "yi", "yo", "za", "zh", "zu",
)
#: Code points that show nothing, as ranges of a regular expression.
IGNORABLE = (
    r"\p{Cc}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}"
    r"\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{E0000}-\x{E0FFF}"
)
#: The stages of a project, in order.
STAGES = ("new", "parsed", "mapped", "transcoded", "uploaded", "done")


#: Texts that Python holds as its own objects at a time.
HELD = 64


def normal_form(form: str):
    """A function of a column for a Unicode normal form (NFC, NFKC ...); only texts with a letter that it may alter go to Python.

    Letters below U+0300 do not combine with each other, so a text of such letters that are their own form is its own form.
    """
    altered = [i for i in range(0x300) if unicodedata.normalize(form, chr(i)) != chr(i)]
    risky = "[" + "".join(rf"\x{{{i:x}}}" for i in altered) + r"\x{300}-\x{10ffff}]"

    @F.arrow_udf("string")
    def normalised(text: pa.Array) -> pa.Array:
        parts = (text.slice(i, HELD).to_pylist() for i in range(0, len(text), HELD))
        made = [pa.array([None if x is None else unicodedata.normalize(form, x) for x in part], pa.string()) for part in parts]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    def column(c: Column) -> Column:
        plain = (F.octet_length(c) == F.char_length(c)) | ~c.rlike(risky)
        return F.when(plain, c).otherwise(normalised(F.when(~plain, c)))

    return column


def collapsed(c: Column) -> Column:
    """Runs of any Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def alignment_text(c: Column, unicode: bool = True) -> Column:
    """Lower case, letters and numbers only, single spaces; compatibility forms folded where ``unicode``."""
    c = normal_form("NFKC")(c) if unicode else c
    return collapsed(F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}\s　]", ""))


def squashed(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s", ""))


def bigrams(c: Column) -> Column:
    return F.array_distinct(F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array()))


def dice(a: Column, b: Column) -> Column:
    """Similarity of two squashed titles by their distinct character pairs: 1 if equal, 0 where there are none."""
    return dice_of(a, b, bigrams(a), bigrams(b))


def dice_of(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The same with the titles' pairs of characters at hand."""
    return F.when(a == b, F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(
        2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    )


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in lower case; 1 for two empty texts."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")) for c in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def longest_common_length(a: str, b: str) -> int:
    """Length of the longest common substring: the longer text read once against the suffix automaton of the shorter one.

    Time and memory follow the sum of the lengths.
    """
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return len(a)
    # a state stands for the substrings that end at the same places: its steps, its longest length, and the state of its next shorter suffix
    steps: list[dict[str, int]] = [{}]
    length, shorter, last = [0], [-1], 0
    for c in a:
        new, at = len(steps), last
        steps.append({})
        length.append(length[last] + 1)
        shorter.append(0)
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = shorter[at]
        if at >= 0:
            to = steps[at][c]
            if length[to] == length[at] + 1:
                shorter[new] = to
            else:  # part the state: what is reached from here ends at more places
                own = len(steps)
                steps.append(dict(steps[to]))
                length.append(length[at] + 1)
                shorter.append(shorter[to])
                while at >= 0 and steps[at].get(c) == to:
                    steps[at][c] = own
                    at = shorter[at]
                shorter[to] = shorter[new] = own
        last = new
    best = at = held = 0
    for c in b:
        while at and c not in steps[at]:
            at = shorter[at]
            held = length[at]
        to = steps[at].get(c)
        if to is None:
            held = 0
        else:
            at, held = to, held + 1
            if held > best:
                best = held
    return best


@F.pandas_udf(IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else longest_common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def title_score(a: Column, b: Column) -> Column:
    """Half the Jaccard similarity of tokens, half the longest common substring over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(0.5 * token_jaccard(a, b) + 0.5 * longest_common(a, b) / longest)


def transcript_score(text: Column, probe: Column) -> Column:
    least = F.least(F.length(text), F.length(probe))
    return F.when(least == 0, F.lit(0.0)).otherwise(longest_common(text, probe) / least)


def probe_length(transcript: Column) -> Column:
    """Characters of a chapter that a transcript is held against: 1.5 times its length, 400 at most."""
    return F.least(F.ceil(F.length(transcript) * 1.5), F.lit(400)).cast("int")


def is_generic_title(c: Column) -> Column:
    """A keyword with a number, together or apart, or a counter such as 第1章."""
    words = "|".join(TITLE_KEYWORDS)
    return c.rlike(rf"^\s*(?:(?:{words})\s*\p{{N}}+|第?\p{{N}}+[章話巻部]+)\s*$")


def trimmed(c: Column) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean_body(html: Column) -> Column:
    """Markup to text: ruby readings, heads, styles and scripts go, tags go, six entities are decoded.

    Lines are trimmed, and a run of blank lines is one. A ``<`` that no ``>`` follows stays; an element that is never
    closed goes to the end.
    """
    element = "|".join(rf"{n}(?=[>/ \t\r\n])(?:[^>]*/>|.*?(?:</{n}[^>]*(?:>|\z)|\z))" for n in ("style", "script", "head"))
    text = F.regexp_replace(strip_ruby(html), rf"(?is)<(?:{element}|[^>]*>)", "")

    def lined(c: Column) -> Column:
        c = F.regexp_replace(c, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
        return trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n"))

    plain = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#x3000;", "\u3000"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.when(F.contains(html, F.lit("&")), lined(text)).otherwise(lined(plain))


def heading(html: Column) -> Column:
    """The first h1, else h2, else h3, cleaned; null where there is none."""
    found = [F.nullif(clean_body(F.regexp_extract(html, rf"(?is)<h{k}[^>]*>(.*?)</h{k}>", 1)), F.lit("")) for k in (1, 2, 3)]
    return F.coalesce(*found)


def head_title(html: Column) -> Column:
    """The title element unless it is empty or says nothing."""
    title = clean_body(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(~F.lower(title).isin("", "page", "untitled"), title)


def matter_kind(title: Column) -> Column:
    t = F.lower(collapsed(title))
    return F.when(t.isin(*FRONT_MATTER), "front_matter").when(t.isin(*BACK_MATTER), "back_matter").otherwise("body")


def fold_language(c: Column) -> Column:
    """Two-letter code of a language tag: its first part by table, else its first two letters if they are a code
    that stays, else xx; an empty text for a shorter part, null for null."""
    tag = F.element_at(F.split(F.lower(trimmed(c)), "[-_]"), 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_FOLD.items() for x in kv])
    two = F.left(tag, F.lit(2))
    short = F.when(c.isNull(), None).when(F.octet_length(tag) < 2, "").when(two.isin(*LANGUAGES_KEPT), two).otherwise("xx")
    return F.coalesce(table[tag], short)


def provider_hint(c: Column, supported: tuple[str, ...] = ()) -> Column:
    """The two-letter code that a transcription service is given, null where none is safe (or ``supported``)."""
    aliases = F.create_map(*[F.lit(x) for kv in HINT_ALIASES.items() for x in kv])
    code = F.coalesce(aliases[c], c)
    known = code.isin(*ISO_639_1)
    return F.when(known & code.isin(*supported) if supported else known, code)


def shown_title(c: Column, unicode: bool = True) -> Column:
    """Compatibility forms folded, lower case, what shows nothing dropped (line breaks too), single spaces."""
    c = F.lower(normal_form("NFKC")(c) if unicode else c)
    return collapsed(F.regexp_replace(c, f"[{IGNORABLE}]", ""))


def audio_title(path: Column, place: Column) -> Column:
    """The file's stem, else its place from 1."""
    return F.coalesce(F.nullif(stem(path), F.lit("")), F.format_string("Track %d", place + 1))


def stage_step(now: Column, wanted: Column) -> Column:
    """The stage after a step: forward or the same; null where it would go back or is unknown."""
    order = F.array(*[F.lit(x) for x in STAGES])
    a, b = F.array_position(order, now), F.array_position(order, wanted)
    return F.when((a > 0) & (b >= a), wanted)


def next_stage(now: Column) -> Column:
    """The stage that follows; null after the last."""
    order = F.array(*[F.lit(x) for x in STAGES])
    place = F.array_position(order, now)
    return F.when(place > 0, F.get(order, place))


def signal_label(name: str, n: Column) -> Column:
    """A count in six bins, so that labels hardly change."""
    bins = F.when(n >= 12, "12+").when(n >= 6, "6+").when(n >= 3, "3+").otherwise(n.cast("string"))
    return F.concat(F.lit(f"{name}_x"), bins)


def safe_segment(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(
        F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    )


def hours_minutes(seconds: Column) -> Column:
    """Hours and minutes, rounded to the minute; a dash where nothing is known."""
    total = F.floor(seconds / 60 + 0.5).cast("long")
    hours, minutes = F.floor(total / 60), F.pmod(total, F.lit(60))
    return F.when(seconds.isNull(), "—").when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))


def count_text(n: Column) -> Column:
    """Digits in groups of three; a dash where nothing is known."""
    return F.when(n.isNull(), "—").otherwise(F.format_number(n, 0))


def relative_day(at: Column, now: Column) -> Column:
    """today (and later), yesterday, the weekday within a week, else the date, with its year where that is another one."""
    days = F.datediff(now, at)
    date = F.when(F.year(at) == F.year(now), F.date_format(at, "MMM d")).otherwise(F.date_format(at, "MMM d, yyyy"))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, F.date_format(at, "E")).otherwise(date)


def age_text(at: Column, now: Column) -> Column:
    """How long ago: just now, minutes, hours, from a day on the day; unknown for no time."""
    minutes = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))) / 60_000)
    hours = F.floor(minutes / 60)
    return (
        F.when(at.isNull(), "unknown").when(minutes < 1, "just now").when(minutes == 1, "1 minute ago").when(minutes < 60, F.format_string("%d minutes ago", minutes))
        .when(hours == 1, "1 hour ago").when(hours < 24, F.format_string("%d hours ago", hours)).otherwise(relative_day(at, now))
    )


def scrub_secrets(c: Column) -> Column:
    """Key-shaped tokens, and the token after the word bearer, become [redacted]."""
    token = r"[A-Za-z0-9._~+/-]"
    c = F.regexp_replace(c, rf"(?i)(?<!{token})(bearer)(?!{token})([^A-Za-z0-9._~+/-]+)(?!bearer(?!{token})){token}+", "$1$2[redacted]")
    return F.regexp_replace(c, rf"(?i)(?<!{token})g?sk[-_]{token}*", "[redacted]")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, r"[/\\]"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r".\.([^.]*)$", 1))


_CJK = r"[぀-ヿ㐀-鿿豈-﫿]"


def strip_ruby(html: Column) -> Column:
    """Readings (rt, rp and what they hold) go, ruby and rb tags are unwrapped, gaps between CJK characters close."""
    held = [F.contains(html, F.lit(x)) for x in ("<r", "<R", "</r", "</R")]
    text = F.regexp_replace(html, r"(?is)<r[tp](?:\s[^>]*)?>.*?(?:</r[tp]\s*>|(?=<r[tpb]|</ruby))", "")
    text = F.regexp_replace(text, r"(?is)</?(?:ruby|rb|rtc)(?:\s[^>]*)?>", "")
    close = lambda c: F.regexp_replace(c, rf"(?<={_CJK})[ \t\r\n]+(?={_CJK})", "")
    return F.when(~F.contains(html, F.lit("<")), html).when(held[0] | held[1] | held[2] | held[3], close(text)).otherwise(close(html))


def natural_key(c: Column) -> Column:
    """Sort key of file names: text in lower case, digits by value, fewer leading zeros first on ties."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    value = lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))
    numbered = lambda x: F.concat(F.lit("0"), F.lpad(F.length(value(x)).cast("string"), 4, "0"), value(x), F.lpad(F.length(x).cast("string"), 4, "0"))
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), numbered(x)).otherwise(x))
