"""Secret scans: known forms by pattern, and literals by the names they are assigned to.

**Base.** Three kinds of spans are found in the whole text, leftmost and without overlap within a kind:
``assign`` (a telling name, a separator and a value), ``access`` (access key ids) and ``hex`` (long runs of
lower-case hexadecimal digits). A match that is too short is dropped, and what it covers is not tried again.

**Assignments.** Source code and configuration are read as name-literal pairs: ``name = "..."`` in its many
forms (``:=``, ``=>``, ``:``, ``==`` is no assignment), quoted keys, subscripts (``env["name"] = ...``),
members, typed declarations, shell and ini lines with bare values, command-line flags, attributes and
elements. The right side is a chain of quoted literals, bare values and names joined by ``+``, ``.``,
``||`` or nothing. Constants are propagated: a name on the right side stands for all literals that reach it
anywhere in the text, through any number of names, so ``password = DEFAULT`` marks the literal assigned to
``DEFAULT``. Every chain of literals gets the score of the most sensitive name it reaches, times how much
the literal looks like a secret: its length, entropy and classes of characters, less for words, paths and
placeholders. Literals at ``THRESHOLD`` are spans of kind ``literal``, without their quotes, unless a base
span covers them.

Places are code points, ends exclusive. Defined cases: a null or empty text has no spans; repeated rows are
scanned each; names that stand for each other in a circle share their literals; an empty table gives no
rows; added literals have at most 10,000 characters in quotes and 2,000 without. Input columns stay in the struct ``row``. Texts are read whole; one without any telling word is
searched for access ids and hexadecimal runs only, which loses nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.5
LEAST = 6  # characters of a literal

# The base patterns.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20 and more are runs with 16 after the prefix
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: How telling the parts of a name are, alone or next to each other.
NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.8, "pw": 0.7,
    "secret": 1.0, "secrets": 0.9, "credential": 0.9, "credentials": 0.9, "creds": 0.9, "token": 0.9, "bearer": 0.9, "jwt": 0.9,
    "apikey": 1.0, "authkey": 1.0, "auth": 0.7, "signature": 0.6, "salt": 0.7, "pin": 0.6, "otp": 0.7, "webhook": 0.6, "dsn": 0.6,
    "key": 0.3, "cookie": 0.5,
}
PAIRS = {
    ("api", "key"), ("access", "key"), ("secret", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("master", "key"),
    ("account", "key"), ("auth", "key"), ("ssh", "key"), ("shared", "key"), ("license", "key"), ("service", "key"), ("app", "key"),
    ("connection", "string"), ("pass", "phrase"), ("pass", "word"), ("auth", "code"),
}
#: Parts that say the value is about a secret rather than one.
ABOUT = {
    "id", "name", "names", "path", "file", "dir", "url", "uri", "length", "len", "count", "size", "type", "kind", "field", "label", "hint", "policy", "prompt",
    "placeholder", "expires", "expiry", "ttl", "max", "min", "num", "public", "enabled", "required", "regex", "pattern", "header", "prefix", "suffix", "title", "error", "message",
    "description", "help", "algorithm", "version", "env", "var", "column", "param", "format", "issuer", "endpoint", "location", "provider", "manager", "tokens", "tokenizer",
}
_STEMS = ("pass", "pwd", "pw", "secret", "cred", "token", "bearer", "jwt", "key", "auth", "signature", "salt", "pin", "otp", "webhook", "dsn", "cookie", "connection")

_PLACEHOLDER = re.compile(
    r"(?i)\$\{|\{\{|^<.*>$|^\$\w+$|^%\(?\w|^your[_-]|change_?me|placeholder|redacted|^x{4,}$|^\*+$|^\.+$"
    r"|^.{0,12}(?:example|dummy).{0,4}$|^(?:none|null|undefined|true|false|todo|string|process|optional|required|default)\b"
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PATH = re.compile(r"^(?:[a-z][a-z0-9+.-]*://[^:@/]+(?:/|$)|/|\.{1,2}/|~/|[A-Za-z]:\\)")

# every repetition is bounded, so that no text takes more than linear time
_STRING = r'''"(?:[^"\\\n]|\\.){0,10000}+"|'(?:[^'\\\n]|\\.){0,10000}+'|`(?:[^`\\\n]|\\.){0,10000}+`'''
_IDENT = r"[A-Za-z_$][A-Za-z0-9_$]{0,200}+"
# the left side: a flag, a quoted key, or a (member of a) name, with a subscript or a type behind it
_TARGET = re.compile(
    rf"""(?P<flag>(?<![\w-])--[A-Za-z][\w-]*)(?:=|[ ]+(?=[^\s-]))
      |(?:(?P<quoted>["'][^"'\n]{{1,200}}["'])
         |(?<![\w$])(?P<name>{_IDENT}(?:(?:\.|->|::|-){_IDENT}){{0,8}}+)(?P<index>\[[ ]*["'][^"'\n]{{1,200}}["'][ ]*\])?)
       (?:[ \t]*:[ \t]*[A-Za-z_][\w.\[\]<>]{{0,200}}+(?=[ \t]*=(?!=)))?
       [ \t]*(?P<sign>:=|=>|(?<![!<>=])=(?![=>~])|:(?![:/=]))[ \t]*""",
    re.VERBOSE,
)
_TERM = re.compile(rf"""(?:[rbfuRBFUL@]{{1,2}}(?=["']))?(?P<string>{_STRING})|(?P<ref>{_IDENT}(?:(?:\.|->|::){_IDENT}){{0,8}}+)(?![\w$(\[/+=-])""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|\|\||&)[ \t]*(?:\\?\n[ \t]*)?|[ \t]+(?=[\"'])")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]{1,2000}+(?![(\[])(?![^\s\"'`,;(){}\[\]<>])")
_ELEMENT = re.compile(rf"<(?P<name>{_IDENT}(?:[-.:]{_IDENT})*)>(?P<value>[^<>\n]+)</(?P=name)>")


_SPANS = "spans array<struct<kind:string, start:long, end:long, name:string, score:double>>"


def name_score(name: str) -> float:
    """How sensitive a target name is, 0 to 1, by its parts in snake, kebab or camel case."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((NAMES.get(p, 0.0) for p in parts), default=0.0)
    joined = "".join(parts)
    if any(pair in PAIRS for pair in zip(parts, parts[1:])) or joined in NAMES:
        best = max(best, NAMES.get(joined, 0.95))
    return best * (0.3 if parts and (parts[-1] in ABOUT or parts[0] in ("max", "min", "num", "public", "no", "has", "is")) else 1.0)


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    if len(value) < LEAST or _PLACEHOLDER.search(value) or len(set(value)) < 4:
        return 0.0
    size = len(value)
    entropy = -sum(n / size * math.log2(n / size) for n in Counter(value).values())
    classes = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    score = 0.4 * min(1.0, size / 12) + 0.4 * min(1.0, entropy / 3.5) + 0.2 * min(1.0, classes / 3)
    if classes == 1 and value.isalpha():
        score *= 0.9 if quoted else 0.4
    if any(c.isspace() for c in value):
        score *= 0.7 if value.count(" ") < 4 else 0.3
    return score * (0.5 if _PATH.search(value) else 1.0)


@dataclass(frozen=True)
class _Piece:
    """A part of a right side: a quoted literal, a bare value, or a name that may stand for others."""

    start: int
    end: int
    kind: str  # "quoted", "bare" or "name"


def _own(name: str) -> str:
    """The last member of a dotted name, under which it is looked up."""
    return re.split(r"\.|->|::", name)[-1]


def _chain(text: str, at: int) -> tuple[list[_Piece], int]:
    """The literals and names joined on the right side that starts at ``at``, and where it ends."""
    pieces, end = [], at
    while True:
        term, bare = _TERM.match(text, at), None if pieces else _BARE.match(text, at)
        if term and term["string"]:
            pieces.append(_Piece(term.start("string") + 1, term.end("string") - 1, "quoted"))
            end = term.end()
        elif term and not (bare and bare.end() > term.end()):
            pieces.append(_Piece(*term.span("ref"), "name"))
            end = term.end()
        elif bare:
            return [_Piece(*bare.span(), "bare")], bare.end()
        else:
            return pieces, end
        joint = _JOIN.match(text, end)
        if not joint:
            return pieces, end
        at = joint.end()


def assignments(text: str) -> Iterator[tuple[str, list[_Piece]]]:
    """(name, right side) pairs of a text."""
    at = 0
    while found := _TARGET.search(text, at):
        name = found["flag"] or (found["quoted"] or found["index"] or found["name"]).strip("[]\"' ")
        pieces, end = _chain(text, found.end())
        if pieces:
            yield name, pieces
        # a name on the right side may be assigned to itself, as in a = b = "..."
        at = end if pieces and pieces[-1].kind != "name" else found.end()
    for found in _ELEMENT.finditer(text):
        yield found["name"], [_Piece(*found.span("value"), "quoted")]


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals at THRESHOLD, by place, with the most sensitive name each reaches."""
    values: dict[str, list[list[_Piece]]] = defaultdict(list)
    targets: dict[str, float] = {}
    for name, pieces in assignments(text):
        values[_own(name)].append(pieces)
        targets[name] = name_score(name)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    done: dict[str, set[str]] = defaultdict(set)
    for name, score in sorted(targets.items(), key=lambda t: (-t[1], t[0])):
        if score < THRESHOLD:
            break
        waiting, seen = [_own(name)], done[f"{score}"]  # names of one score reach the same literals with the same result
        while waiting:
            current = waiting.pop()
            if current in seen:
                continue
            seen.add(current)
            for pieces in values.get(current, ()):
                own = [p for p in pieces if p.kind != "name"]
                for piece in pieces:
                    if piece.kind == "name":
                        other = text[piece.start : piece.end]
                        if _own(other) in values:
                            waiting.append(_own(other))
                        elif len(pieces) == 1 and other == _own(other) and not name_score(other):
                            own = pieces  # no such name is assigned here, so it is a bare value
                if own:
                    total = score * literal_score("".join(text[p.start : p.end] for p in own), own[0].kind == "quoted")
                    for p in own if total >= THRESHOLD else ():
                        if p.end > p.start and total > best.get((p.start, p.end), (0.0, ""))[0]:
                            best[p.start, p.end] = (total, name)
    return [(a, b, name, score) for (a, b), (score, name) in sorted(best.items())]


def spans(text: str | None) -> list[tuple[str, int, int, str | None, float]]:
    """(kind, start, end, name, score) of all spans of a text, by start, then kind; base spans have score 1."""
    if not text:
        return []
    low = text.lower()
    found = [("access", *m.span(), None, 1.0) for m in _ACCESS.finditer(text)] + [("hex", *m.span(), None, 1.0) for m in _HEX.finditer(text)]
    if any(word in low for word in _ASSIGN_WORDS):
        found += [("assign", *m.span(), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if any(stem in low for stem in _STEMS) and ("=" in text or ":" in text or "--" in text or "</" in text):
        found.sort(key=lambda s: (s[1], s[2]))
        covered, reach = [], 0
        for start, end in [s[1:3] for s in found]:
            if end > reach:  # by rising start and end
                covered.append((start, end))
                reach = end
        k = 0
        for a, b, name, score in literals(text):
            while k < len(covered) and covered[k][1] < b:
                k += 1
            if not any(s <= a and b <= e for s, e in covered[k : k + 1]):
                found.append(("literal", a, b, name, score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, spans) of every document; a span is (kind, start, end, name, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "name", "score"), s)) for s in spans(body.as_py())] for body in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, kind)], ["row", "spans"])

    rows = docs.select(F.col(text).alias("text"), F.struct("*").alias("row"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.StructType.fromDDL(_SPANS)]))


def joined(found: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(found: DataFrame, text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """The documents of :func:`scan` with every run of spans in the text replaced by a mark."""
    whole = F.col(f"row.{text}")
    # places already written and text so far; spans come by start, so an overlapping one only moves the place on
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(whole, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = F.when((s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (acc["at"] == 0)), F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), fresh.alias("out"))

    done = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))))
    return found.select(F.col("row").withField(text, F.when(whole.isNotNull(), done)).alias("row")).select("row.*")
