"""Fill-in-the-middle examples, cut by memoised counts of content-defined chunks.

A rolling hash over the bytes cuts every text into chunks whose borders depend on
nearby content only, so copies and shared passages yield the same chunks. A chunk's
summary (how many units begin in it, how it begins and ends, whether it holds a
mark) is computed once per task and kept with the chunk's content, which every hit
is compared with. Summaries of neighbours combine: the running sums of a text's
chunks give its length in units and the chunk that holds a cut, and only that chunk
is searched for the byte to cut at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import OrderedDict
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix

LEAST_CHUNK = 1 << 8
MOST_CHUNK = 1 << 13
#: One position in so many, on average, may end a chunk.
CHUNK_EVERY = 1 << 10
#: Bytes that a border depends on.
WINDOW = 32
#: Bytes that are hashed at once, and bytes of chunks that a task remembers.
PIECE = 1 << 20
CACHE_BYTES = 1 << 25
#: Texts of so many bytes form an output batch.
OUTPUT_BYTES = 1 << 22

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# Prefix, suffix and middle marks of the query.
MARKS = ("<P>", "<S>", "<M>")


def borders(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes; the last one is its length.

    The hash of a position sums the values of the last WINDOW bytes, each shifted by
    its age, and is built by doubling the window.
    """
    ends, at = [], 0
    for start in range(0, len(data), PIECE):
        first = max(0, start - WINDOW + 1)
        rolled, width = _GEAR[data[first : start + PIECE]], 1
        while width < WINDOW:
            older = rolled[:-width] << np.uint32(width)
            rolled = rolled.copy()
            rolled[width:] += older
            width *= 2
        marked = np.flatnonzero(rolled[start - first :] >> np.uint32(32 - CHUNK_EVERY.bit_length() + 1) == 0)
        for end in (marked + (start + 1)).tolist():
            while end - at > MOST_CHUNK:
                at += MOST_CHUNK
                ends.append(at)
            if end - at >= LEAST_CHUNK:
                at = end
                ends.append(at)
    while len(data) - at > MOST_CHUNK:
        at += MOST_CHUNK
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


class Summary(NamedTuple):
    """What neighbours need to know of a chunk.

    ``units`` begin in it if the byte before it is no blank; ``opens``: one more does
    if that byte is one; ``closes``: it ends with a blank.
    """

    units: int
    opens: bool
    closes: bool
    marked: bool


class Chunks:
    """Summaries of chunks, remembered by content up to CACHE_BYTES; the longest unused go first."""

    def __init__(self, unit: str = "chars", marks=MARKS):
        if unit not in ("chars", "words"):
            raise ValueError(f"unit must be chars or words, not {unit!r}")
        self.words, self.marks = unit == "words", [m.encode() for m in marks]
        self.overlap = max(map(len, self.marks)) - 1
        self.known: OrderedDict[bytes, Summary] = OrderedDict()
        self.held = self.hits = 0

    def starts(self, chunk: bytes, after_blank: bool) -> np.ndarray:
        """Where units begin in a chunk."""
        data = np.frombuffer(chunk, np.uint8)
        if not self.words:
            return np.flatnonzero((data & 0xC0) != 0x80)
        blank = _BLANK[data]
        before = np.concatenate([[after_blank], blank[:-1]])
        return np.flatnonzero(~blank & before)

    def summary(self, chunk: bytes) -> Summary:
        """From memory if the same bytes have been seen; a dictionary compares contents, not only hashes."""
        found = self.known.get(chunk)
        if found is not None:
            self.known.move_to_end(chunk)
            self.hits += 1
            return found
        if self.words:
            opens = not _BLANK[chunk[0]]
            found = Summary(len(self.starts(chunk, False)), opens, bool(_BLANK[chunk[-1]]), self.has_mark(chunk))
        else:
            units = len(chunk) if chunk.isascii() else len(self.starts(chunk, False))
            found = Summary(units, False, False, self.has_mark(chunk))
        self.known[chunk] = found
        self.held += len(chunk)
        while self.held > CACHE_BYTES:
            self.held -= len(self.known.popitem(last=False)[0])
        return found

    def has_mark(self, data: bytes) -> bool:
        return any(m in data for m in self.marks)


class Measured:
    """One text's chunks: its length in units, whether it holds a mark, and where the k-th unit begins."""

    def __init__(self, text: bytes, chunks: Chunks):
        self.text, self.chunks = text, chunks
        self.ends = borders(np.frombuffer(text, np.uint8))
        counts, self.after_blank = [], []
        blank, self.marked, at = True, False, 0
        for end in self.ends:
            own = chunks.summary(text[at:end])
            counts.append(own.units + (own.opens and blank))
            self.after_blank.append(blank)
            # a mark may begin in one chunk and end in a later one
            self.marked |= own.marked or chunks.has_mark(text[max(0, at - chunks.overlap) : at + chunks.overlap])
            blank, at = own.closes, end
        self.sums = list(accumulate(counts))
        self.units = self.sums[-1] if self.sums else 0

    def byte_of(self, k: int) -> int:
        """Where the first ``k`` units end: at the byte where the next one begins."""
        if k <= 0:
            return 0
        if k >= self.units:
            return len(self.text)
        i = bisect_left(self.sums, k + 1)
        begin, before = (self.ends[i - 1], self.sums[i - 1]) if i else (0, 0)
        return begin + int(self.chunks.starts(self.text[begin : self.ends[i]], self.after_blank[i])[k - before])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 from the sha256 of seed and id; a null id is an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _rearrange(seed: int, plain_percent: int, spm_percent: int, unit: str, marks):
    p, s, m = (mark.encode() for mark in marks)

    def example(chunks: Chunks, doc_id, text: bytes):
        h1, h2, h3, h4 = draws(seed, doc_id)
        measured = Measured(text, chunks)
        n = measured.units
        if not text or measured.marked or h3 % 100 >= 100 - plain_percent:
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = measured.byte_of(low), measured.byte_of(high)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            return n, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches):
        chunks = Chunks(unit, marks)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, first, held = [], 0, 0
            for i in range(batch.num_rows):
                text = (texts[i].as_buffer() or pa.py_buffer(b"")).to_pybytes()
                rows.append(example(chunks, ids[i].as_py(), text))
                held += len(text)
                if held >= OUTPUT_BYTES or i + 1 == batch.num_rows:
                    n, form, low, middle, output = zip(*rows)
                    arrays = [
                        ids.slice(first, len(rows)),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(low, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix", "middle", "output"])
                    rows, first, held = [], i + 1, 0

    return run


def infill(
    docs: DataFrame,
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
    unit: str = "chars",
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``(doc_id, n, form, prefix, middle, output)`` for every row.

    A text of ``n`` units (``chars``: code points; ``words``: a run of non-blanks and
    what follows up to the next) is cut at two places drawn from ``seed`` and id.
    ``form`` psm writes prefix, suffix, middle behind their marks, spm suffix, prefix,
    middle; ``prefix`` and ``middle`` are lengths in units. A share of texts, and
    every text that is empty or holds a mark, stays plain, with null lengths.

    Null texts are empty ones. A null id counts as an empty string, so all such rows
    draw the same numbers; repeated rows give equal rows. An empty table gives an
    empty table; other columns are not read. Texts are cut whole, whatever their length.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(
        _rearrange(seed, plain_percent, spm_percent, unit, marks),
        "doc_id long, n long, form string, prefix long, middle long, output string",
    )


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an example, from its output and form alone: the parts between the marks in text order."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks))
    first, second = F.element_at(parts, 2), F.element_at(parts, 3)
    text = F.concat(
        F.when(form == "psm", first).otherwise(second),
        F.element_at(parts, 4),
        F.when(form == "psm", second).otherwise(first),
    )
    return F.when(form == "plain", output).otherwise(text)
