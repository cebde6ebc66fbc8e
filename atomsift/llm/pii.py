"""Personal data with offsets, plain and disguised.

Plain identifiers are found in the text as it is. Then transducers rewrite the
text, keeping for every character of the rewritten text the source range it
stands for: invisible characters go, look-alike letters and digits become ASCII,
spelled digits become digits, and ``at``/``dot`` disguises become signs. What is
detected there and does not touch a plain span of its kind is added, in source
offsets.
"""

from __future__ import annotations

import re
import unicodedata
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The plain patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match of it takes up whole runs of digits, so it begins where a run does; other starts would only cost time.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like ASCII ones.
_LOOKS = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅ" "аеорсухіјѕһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "αονι",
        "ABEKMHOPCTYXIJS" "aeopcyxijshdqw" "ABEZHIKMNOPTYX" "aovi",
        strict=True,
    )
)
_INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
_SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_NUMBER = "|".join(_SPELLED)
_STRANGE = re.compile(
    "[\u00ad\u0370-\u03ff\u0400-\u052f\u0660-\u0669\u06f0-\u06f9\u200b-\u200d\u2060\ufeff\uff01-\uff5e]"
)
_RUN = re.compile(rf"(?<![a-z])(?:{_NUMBER})(?:[ -](?:{_NUMBER}))+(?![a-z])")  # for lower-cased text
_WORD = re.compile(_NUMBER)
_PLUS = re.compile(r"(?<![a-z])plus (?=[0-9])", re.I | re.A)
_LONE = re.compile(rf"(?:(?<=[0-9] dot )|(?<=[0-9] point ))({_NUMBER})(?![a-z])", re.I | re.A)
_POINT = re.compile(r"(?<=[0-9]) (?:dot|point) (?=[0-9])", re.I | re.A)
_BRACKETED = re.compile(r" ?[\[({<] ?(at|dot) ?[\])}>] ?", re.I | re.A)
_OPENED = re.compile(r"[\[({<] ?(?:at|dot) ?[\])}>]")  # what _BRACKETED needs, for lower-cased text
# Endings that a spoken domain may have.
_ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|eu|uk|us|ca|au|nz|de|at|ch|fr|be|nl|es|pt|it|pl|se|no|dk|fi|ru|jp|cn|in|br|mx"
_SPOKEN = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?: at | ?@ ?)(?=(?:[A-Za-z0-9-]+(?: dot |\.))+(?:{_ENDINGS})(?![A-Za-z0-9-]))", re.I | re.A)
_ASKED = re.compile(r" at | ?@ ?")  # what _SPOKEN needs, for lower-cased text
_DOTS = re.compile(r"@[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+", re.I | re.A)
_DOT = re.compile(r" dot ", re.I | re.A)
_TENTH = re.compile(r"(?<=[0-9])[OolI](?=[ -]?[0-9])")
_CAPITALS = {c: c + 32 for c in range(65, 91)}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _emails(text: str):
    last = at = 0
    while (at := text.find("@", max(at, last))) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield "email", start, found.end()
            last = found.end()
        at += 1


def plain(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; those that fail their check are dropped."""
    found = list(_emails(text))
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_byte, m[0].split("."))):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


class Traced:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.first, self.past = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ascending disjoint ranges. The new characters share the range that they replace."""
        if not edits:
            return
        text, first, past, at = [], [], [], 0
        for start, end, new in edits:
            text.append(self.text[at:start])
            first += self.first[at:start]
            past += self.past[at:start]
            if new:
                text.append(new)
                first += [self.first[start]] * len(new)
                past += [self.past[end - 1]] * len(new)
            at = end
        text.append(self.text[at:])
        self.text, self.first, self.past = "".join(text), [*first, *self.first[at:]], [*past, *self.past[at:]]

    def sub(self, pattern: re.Pattern, new) -> None:
        self.rewrite([(m.start(), m.end(), new(m)) for m in pattern.finditer(self.text)])


def _ascii(m: re.Match) -> str:
    c = m[0]
    if c in _INVISIBLE:
        return ""
    if c in _LOOKS:
        return _LOOKS[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else c


def _lower(text: str) -> str:
    """The text with letters in lower case, character for character."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(_CAPITALS)


def _numbers(traced: Traced, lower: str) -> None:
    edits = []
    for run in _RUN.finditer(lower):
        words = list(_WORD.finditer(lower, *run.span()))
        # the sign between two spelled digits goes, so that they stand together
        ends = [w.start() for w in words[1:]] + [run.end()]
        edits += [(w.start(), end, _SPELLED[w[0]]) for w, end in zip(words, ends, strict=True)]
    traced.rewrite(edits)


def _spoken(text: str, lower: str):
    """Matches of ``_SPOKEN``, looked for only where one can begin."""
    for m in _ASKED.finditer(lower):
        found = _SPOKEN.match(text, m.start())
        if found and found[0] != "@":
            yield found


def normalise(text: str) -> Traced | None:
    """The rewritten text, or None where no rule changes anything.

    A rule is passed over only where the text has not what its own pattern needs.
    """
    traced = Traced(text)
    if not text.isascii() and _STRANGE.search(text):
        traced.sub(_STRANGE, _ascii)
    lower = _lower(traced.text)
    if _RUN.search(lower):
        _numbers(traced, lower)
        lower = _lower(traced.text)
    if "plus " in lower:
        traced.sub(_PLUS, lambda m: "+")
    if " dot " in lower or " point " in lower:
        for _ in range(3 * bool(_LONE.search(traced.text))):  # each one may stand after the one before
            traced.sub(_LONE, lambda m: _SPELLED[m[1].lower()])
    traced.sub(_TENTH, lambda m: "0" if m[0] in "Oo" else "1")
    if " dot " in lower or " point " in lower:
        traced.sub(_POINT, lambda m: ".")
    if _OPENED.search(lower):
        traced.sub(_BRACKETED, lambda m: "@" if m[1].lower() == "at" else ".")
    if "@" in traced.text or " at " in lower:
        traced.rewrite([(m.start(), m.end(), "@") for m in _spoken(traced.text, _lower(traced.text))])
    if " dot " in lower:
        traced.rewrite([(d.start(), d.end(), ".") for m in _DOTS.finditer(traced.text) for d in _DOT.finditer(traced.text, *m.span())])
    return None if traced.text == text else traced


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans and added ones, each ordered by kind and start."""
    text = text or ""
    base = plain(text)
    added = []
    traced = normalise(text)
    if traced is not None:
        for kind, start, end in plain(traced.text):
            s, e = traced.first[start], traced.past[end - 1]
            if not any(k == kind and s < pe and ps < e for k, ps, pe in base):
                added.append((kind, s, e))
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    return sorted(base, key=order), sorted(set(added), key=order)


def _line(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every document.

    Both are arrays of ``struct(kind, start, end)`` in code points, end exclusive,
    ordered by kind as listed in ``KINDS`` and start; ``spans`` has the plain and
    the added ones. Null and empty texts have none; repeated rows are answered
    one by one; other columns are ignored; an empty table gives an empty table.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        keys = ("kind", "start", "end")
        for batch in batches:
            base, every = [], []
            for text in batch.column(1):
                own, more = find(text.as_py())
                base.append([dict(zip(keys, s, strict=True)) for s in own])
                both = sorted(own + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if more else own
                every.append([dict(zip(keys, s, strict=True)) for s in both])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span), pa.array(every, span)], ["doc_id", "base", "spans"]
            )

    kind = "array<struct<kind:string,start:long,end:long>>"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    if not text:
        return text
    base, added = find(text)
    out, at = [], 0
    for kind, start, end in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]) if at else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced; null stays null."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = pa.array([redact(t.as_py()) for t in batch.column(at)], pa.string())
            yield batch.set_column(at, "text", column)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts of plain spans by kind, digest of plain spans, and all spans as text."""
    line = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(line("base"), 256).alias("base_sha256"),
        line("spans").alias("spans"),
    )
