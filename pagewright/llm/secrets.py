"""Secret scans: fixed patterns, and assignments read from source and configuration syntax.

The base finds the fixed patterns ``BASE``. The lexer reads names, operators and literals: ``name = "literal"``, ``"name": 'literal'``,
``name: Type = `literal```, ``name := literal``, ``name => literal``, ``name <- literal``, ``<name>literal</name>``, ``#define NAME "literal"``, ``setx NAME literal``, ``--name literal``, bare values of
configuration files, and the user:password part of an address. A value is a row of terms joined by ``+``, ``.``, ``..``, ``&`` or mere spaces between
strings; a term is a string, a bare value or a name.

Constants are propagated: a name stands for the literals it was last given before that place, or first given after it, and so do
``$name``, ``${name}``, ``{name}`` and ``#{name}`` inside a string or bare. Names that are given each other end nowhere.

A literal's score is its target name's sensitivity (the name's words: a password, secret, token, api key, ... counts, ``length``, ``url``, ``policy``,
``public`` and the like count against it) times the value's strength (bits by its own letters' frequencies, and whether it mixes kinds of
characters; placeholders and references have none). Literals from ``THRESHOLD`` on are found, but for those that lie within a base span.

Texts are scanned where they lie, without a shuffle. A search of a linear-time engine first leaves out texts that cannot hold a
finding; it leaves none out that could. All patterns here start at a word's beginning and never give back what they took, so very long words and lines are
read once.

Defined results: a null text is empty and has no findings; ids are carried, nulls too; rows that repeat are found alike; an
empty table gives an empty result; further columns are ignored. Places are code points, the end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns and the least length of the part that counts, in the order in which kinds are listed.
BASE = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: What a text must hold for a kind to be found in it.
HINTS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "literal": r"(?i)pass|pwd|secret|token|key|cred|auth|bearer|pin|salt|session|cookie|signature|connection|://[^\s/@:]*:[^\s/@]+@",
}
KINDS = list(HINTS)
#: Score from which a literal is found.
THRESHOLD = 0.5

#: How much a word of a name, or two in a row, says that the value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pass": 0.9, "pwd": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.9,
    "apikey": 1.0, "secretkey": 1.0, "accesskey": 0.9, "privatekey": 1.0, "authtoken": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.6,
    "authorization": 0.8, "pin": 0.6, "salt": 0.5, "signature": 0.5, "session": 0.4, "cookie": 0.4, "key": 0.4, "api key": 1.0, "access key": 0.9, "private key": 1.0, "secret key": 1.0,
    "signing key": 1.0, "encryption key": 1.0, "auth key": 1.0, "account key": 0.9, "master key": 1.0, "license key": 0.6, "connection string": 0.7, "session key": 0.9,
}
#: Words that say that a name holds something about a secret, or nothing secret.
HARMLESS = set(
    "length len count size name names id ids url uri path file filename dir policy field label type kind expiry expires expiration ttl hint reset prompt regex pattern max min num "
    "required enabled disabled public prefix suffix header param parameter column index format version scope issuer endpoint host user username email age limit budget per total "
    "usage uses used hash digest color title text message error placeholder example".split()
)
PLACEHOLDER = re.compile(
    r"(?i)(?:x+|\*+|\.+|-+|_+|0+|1+|<[^>]*>|\$\{[^}]*\}|\{\{[^}]*\}\}|%[^%]*%|change_?-?me\w*|your[\w-]*|my[-_]\w*|example\w*|placeholder\w*|dummy\w*|sample\w*|fake\w*|test\w{0,4}|foo\w*|bar|"
    r"none|null|nil|true|false|undefined|todo\w*|redacted|secret|password|token|string|\w*\.\.\.)"
)

_NAME = r"[A-Za-z_][\w$]*+(?:(?:[.\-]|::|->)[A-Za-z_][\w$]*+)*+"
#: Not within a name.
_START = r"(?<![\w$])(?<![\w$][.\-])(?<![\w$]::)(?<![\w$]->)"
_STRING = r'''"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`'''
#: A target and its operator: quoted, indexed or plain names, with a type behind a colon where a second operator follows.
ASSIGN = re.compile(
    rf"""(?a){_START}(?:["'])?(?P<name>{_NAME})(?:["'])?\]?[ \t]*+(?:(?::[ \t]*+[&*]?[A-Za-z_][\w<>\[\].|? ]*?)?[ \t]*(?::=|\?\?=|\|\|=|\+=|=>|<-|=(?![=~]))|:(?![:=/]))[ \t]*+"""
)
DIRECTIVE = re.compile(rf"""(?a)(?<![\w$])(?:\#[ \t]*define|setx?|setenv|ARG|ENV)[ \t]++(?P<name>{_NAME})[ \t]++(?=["'\w])|(?<![\w-])--(?P<flag>{_NAME})[ \t]++(?=["'\w])""")
ELEMENT = re.compile(rf"(?a)<(?P<name>{_NAME})(?:[ \t][^<>\n]*+)?>(?P<value>[^<>\n]++)</")
ADDRESS = re.compile(r"(?a)://[^\s/@:\"']*+:(?P<value>[^\s/@\"']++)@")
TERM = re.compile(rf"""(?a)(?P<fix>[rbuf]{{1,2}}(?=["']))?(?P<string>{_STRING})|(?P<bare>[^\s"'`,;(){{}}\[\]<>]++(?:\{{[^}}\s]*+\}}[^\s"'`,;(){{}}\[\]<>]*+)*+)(?P<call>\(|\[)?""")
JOIN = re.compile(r"[ \t]*+(?:\+|\.\.?|&|~)[ \t]*+(?:\\?\n[ \t]*+)?|[ \t]++(?=[\"'`])")
REFERENCE = re.compile(r"\$\{(\w+)\}|\#\{(\w+)\}|\$\((\w+)\)|(?<![\w$])\$(\w+)|(?<![$\#{])\{(\w+)\}")
_CUT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """0 to 1: how much a name says that its value is secret."""
    words = [w.lower() for w in _CUT.findall(name)]
    found = [SENSITIVE.get(w, 0) for w in words] + [SENSITIVE.get(f"{a} {b}", 0) for a, b in zip(words, words[1:], strict=False)]
    harm = sum(w in HARMLESS for w in words)
    return max(found, default=0) * 0.3**harm


def strength(value: str) -> float:
    """0 to 1: how much a value looks like a secret; 30 bits by its own letters' frequencies are enough."""
    if len(value) < 6 or PLACEHOLDER.fullmatch(value) or "\n" in value and not value.lstrip().startswith("-----BEGIN"):
        return 0.0
    n = len(value)
    bits = n * -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", r"\d", r"[^A-Za-z0-9\s]"))
    spaced = 0.3 if value.count(" ") > 2 else 1.0
    return min(1.0, bits / 30) * (1.0 if kinds > 1 else 0.45) * spaced


class Assignments:
    """The name-literal pairs of a text. A term is (start, end) of a literal or the name of a constant."""

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[tuple[int, str, list]] = []  # place, name, terms
        at = 0
        while m := ASSIGN.search(text, at):
            at = self._terms(m.start(), m["name"], m.end())
        for m in DIRECTIVE.finditer(text):
            self._terms(m.start(), m["name"] or m["flag"], m.end())
        for m in ELEMENT.finditer(text):
            self._add(m.start(), m["name"], self._literal(*m.span("value")))
        for m in ADDRESS.finditer(text):
            self._add(m.start(), "password", self._literal(*m.span("value")))
        self.pairs.sort(key=lambda p: p[0])
        self.given: dict[str, list[int]] = {}
        for k, (_, name, _) in enumerate(self.pairs):
            for known in {name, re.split(r"[.\-]|::|->", name)[-1]}:
                self.given.setdefault(known, []).append(k)

    def _add(self, place: int, name: str, terms: list) -> None:
        if terms:
            self.pairs.append((place, name, terms))

    def _literal(self, start: int, end: int) -> list:
        """A literal without what refers to constants in it, and those constants."""
        value, out, at = self.text[start:end], [], 0
        for m in REFERENCE.finditer(value):
            if m.start() > at:
                out.append((start + at, start + m.start()))
            out.append(next(g for g in m.groups() if g))
            at = m.end()
        if at < len(value):
            out.append((start + at, end))
        return out

    def _terms(self, place: int, name: str, at: int) -> int:
        """Note what a name is given at ``at``; where to read on: behind bare values, within strings and at names, which may be given more."""
        out, on = [], at
        while m := TERM.match(self.text, at):
            if m["string"]:
                cut = 3 if m["string"][:3] in ('"""', "'''") else 1
                out += self._literal(m.start("string") + cut, m.end("string") - cut)
            elif m["call"]:
                return max(on, m.end("bare"))
            elif re.fullmatch(_NAME, m["bare"], re.A):
                out.append((m["bare"], *m.span("bare")))
            else:
                out += self._literal(*m.span("bare"))
                on = m.end()
            joined = JOIN.match(self.text, m.end())
            if not joined:
                break
            at = joined.end()
        self._add(place, name, out)
        return on

    def scored(self) -> list[tuple[int, int, str, float]]:
        """(start, end, name, weight) of all literals that a sensitive name is given, by way of constants too.

        Weights go from targets to what they are given, the largest first, so every pair is met once.
        """
        weights = [(sensitivity(name), k) for k, (_, name, _) in enumerate(self.pairs)]
        met: set[int] = set()
        best: dict[tuple[int, int], tuple[str, float]] = {}
        for weight, k in sorted(((w, k) for w, k in weights if w >= THRESHOLD), key=lambda x: (-x[0], x[1])):
            name, waiting = self.pairs[k][1], [k]
            while waiting:
                at = waiting.pop()
                if at in met:
                    continue
                met.add(at)
                for term in self.pairs[at][2]:
                    known = term if isinstance(term, str) else term[0] if len(term) == 3 else None
                    source = self._source(known, at) if known else None
                    if source is not None:
                        waiting.append(source)
                    elif not isinstance(term, str):  # a literal, or a bare word that is no constant
                        best.setdefault(term[-2:], (name, weight))
        return [(s, e, name, weight) for (s, e), (name, weight) in best.items()]

    def _source(self, name: str, k: int) -> int | None:
        """The pair that gives a name its value at pair k: the last before it, else the first after it."""
        own = self.given.get(name, ())
        i = bisect_left(own, k)
        after = i + (i < len(own) and own[i] == k)
        return own[i - 1] if i else own[after] if after < len(own) else None


def lexed(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of all literals from THRESHOLD on; of several names the most sensitive one."""
    scored = ((start, end, name, weight * strength(text[start:end])) for start, end, name, weight in Assignments(text).scored())
    return sorted(x for x in scored if x[3] >= THRESHOLD)


def scan(text: str, kinds: list[bool]) -> list[dict]:
    """The findings of a text among the kinds that it may hold, by start and kind."""
    found = []
    for kind, may in zip(BASE, kinds, strict=False):
        if may:
            pattern, group, least = BASE[kind]
            found += [(m.start(), kind, m.end(), m[1] if group == 2 else None, 1.0) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if kinds[3]:
        base = sorted((s, e) for s, _, e, _, _ in found)
        reach = list(accumulate((e for _, e in base), max))  # the furthest end of the spans that begin before
        for s, e, name, score in lexed(text):
            i = bisect_right(base, (s, math.inf))
            if not i or reach[i - 1] < e:
                found.append((s, "literal", e, name, score))
    found.sort(key=lambda f: (f[0], KINDS.index(f[1])))
    return [{"kind": k, "start": s, "end": e, "name": n, "score": w} for s, k, e, n, w in found]


FOUND = "array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"


def found_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: the findings of every row's text by start, then kind; name is the target's, score 1 for the base."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def work(batches):
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            may = [pc.match_substring_regex(texts, HINTS[k]).to_numpy(zero_copy_only=False) for k in KINDS]
            some = sum(m.astype(int) for m in may) > 0
            chosen = zip(texts.filter(pa.array(some)).to_pylist(), *(m[some].tolist() for m in may), strict=True)
            found = iter([scan(t, list(k)) for t, *k in chosen])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([next(found) if s else [] for s in some.tolist()], kind)], ["doc_id", "found"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found {FOUND}")


def secret_findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each finding: doc_id, kind, start, end, name, score, value."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = found_secrets(rows).filter(F.size("found") > 0).select("doc_id", F.inline("found"))
    return spans


def listed(found: Column | str) -> Column:
    """``kind:start:end`` of each finding, comma-joined."""
    one = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    return F.concat_ws(",", F.transform(found, one))
