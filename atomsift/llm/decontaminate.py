"""Benchmark decontamination by pigeonhole edit matching.

Texts are sequences of words (letters and digits, A-Z lower-cased; everything
else separates, in any script), so case, spacing and punctuation make no difference.
In scripts that set no spaces every character is a word. An item of
m words may be matched with up to ``m // WORDS_PER_EDIT`` word edits. It is cut
into one piece more than that; whoever matches within the budget holds at least
one piece unchanged. Pieces are found through rolling hashes of every text
position, and each find is verified with Myers' bit-parallel edit distance of the
whole item against the words around it.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Texts, buffers, chunks, mix

WORDS_PER_EDIT = 8
ITEMS_AT_ONCE = 20_000
ITEM_BYTES = 32 << 20
_STEP = np.uint64(0xD1342543DE82EF95)


# Scripts without spaces between words (South-East Asian ones, Tibetan, kana, Han).
_UNSPACED = (
    (0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x1A20, 0x1AB0), (0x3005, 0x3008),
    (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xA9E0, 0xAA00), (0xAA60, 0xAAE0), (0xF900, 0xFB00),
    (0xFF66, 0xFFA0), (0x1B000, 0x1B170), (0x20000, 0x40000),
)
_INSIDE = (0x00AD, 0x200C, 0x200D)  # soft hyphen and joiners are inside words
_WORD, _BETWEEN, _SINGLE = 0, 1, 2


class _Kinds:
    """What each character is: part of a word, a separator, or a word by itself. Made when first needed."""

    def __init__(self):
        self.table = None

    def of(self, points: np.ndarray) -> np.ndarray:
        if self.table is None:
            table = np.array([unicodedata.category(chr(c))[0] in "PSZC" for c in range(1 << 17)], np.uint8) * np.uint8(_BETWEEN)
            for a, b in _UNSPACED:
                table[a:b][table[a:b] == _WORD] = _SINGLE
            table[list(_INSIDE)] = _WORD
            self.table = table
        beyond = np.where(points < 0x40000, _SINGLE, _WORD)
        return np.where(points < len(self.table), self.table[np.minimum(points, len(self.table) - 1)], beyond)


_KINDS = _Kinds()


def _separators() -> np.ndarray:
    """Bytes that do not belong to words: ASCII other than letters and digits."""
    sign = np.ones(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        sign[a:b] = False
    return sign


_SIGN = _separators()


def _characters(raw: np.ndarray):
    """Position, length and code point of the characters beyond ASCII; broken ones are left out."""
    at = np.flatnonzero(raw >= 0xC0)
    lead = raw[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    padded, whole = np.append(raw, np.zeros(3, np.uint8)), np.ones(len(at), bool)
    for j in range(1, 4):
        more = j < size
        byte = padded[at[more] + j]
        whole[more] &= byte >> 6 == 2
        point[more] = point[more] << 6 | byte & 0x3F
    return at[whole], size[whole], point[whole]


def plain_words(texts: Texts) -> Texts:
    """The chunk with every separator turned into a space and characters of unspaced scripts as words."""
    raw = np.where(_SIGN[texts.raw], np.uint8(32), texts.raw)
    at, size, point = _characters(raw)
    if not len(at):
        return Texts(raw, texts.offsets)
    kind = _KINDS.of(point)
    between = kind == _BETWEEN
    for j in range(4):
        raw[at[between & (j < size)] + j] = 32
    plain = Texts(raw, texts.offsets)
    single = kind == _SINGLE
    if single.any():
        first, past = at[single], at[single] + size[single]
        begins, ends = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        held = np.append(raw != 32, False)
        begins[plain.starts] = begins[first] = ends[plain.ends] = ends[past] = True
        begins[past[held[past]]] = True
        ends[first[held[first - 1]]] = True  # before the first byte is the blank at the end
        plain.starts, plain.ends = np.flatnonzero(begins), np.flatnonzero(ends)
        plain.doc = np.searchsorted(plain.offsets, plain.starts, side="right") - 1
    return plain


def distance_within(pattern: list[int], text: list[int], budget: int, anchored: bool = False):
    """``(distance, end)`` of the best match of the pattern in the text, or None beyond the budget.

    Myers' algorithm: one bit per pattern word, one step per text word. The match
    may begin anywhere, or has to at the first word if ``anchored``; ``end`` is
    exclusive, the first one among equals.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | (1 << i)
    plus, minus, score = full, 0, m
    best = (m, 0) if m <= budget else None
    for at, w in enumerate(text):
        eq = where.get(w, 0)
        x = eq | minus
        horizontal = ((((eq & plus) + plus) ^ plus) | eq) & full
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | anchored) & full, (down << 1) & full
        plus = (down | (~(x | up) & full)) & full
        minus = up & x
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


def begin_of(pattern: list[int], text: list[int], distance: int) -> int:
    """Where a match of this distance that ends with the text begins, the last place among equals."""
    return len(text) - distance_within(pattern[::-1], text[::-1], distance, anchored=True)[1]


class Items:
    """Pieces of a bounded set of test items, ready for look-up."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.words = ids, [w.tolist() for w in words]
        self.budget = [len(w) // WORDS_PER_EDIT for w in words]
        by_length: dict[int, list] = defaultdict(list)
        for i, w in enumerate(words):
            if len(w) == 0:
                continue
            ends = np.linspace(0, len(w), self.budget[i] + 2).round().astype(int)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                by_length[b - a].append((int(_windows(w[a:b], b - a)[0]), i, int(a)))
        self.pieces = {}
        for length, rows in by_length.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            self.pieces[length] = keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def hits(self, h: np.ndarray):
        """``(position, item, offset of the piece in the item)`` of every piece in a word sequence."""
        for length, (keys, item, offset) in self.pieces.items():
            if len(h) < length:
                continue
            windows = _windows(h, length)
            low, high = np.searchsorted(keys, windows, "left"), None
            maybe = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == windows)
            if len(maybe):
                low, high = low[maybe], np.searchsorted(keys, windows[maybe], "right")
                count = high - low
                row = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                yield np.repeat(maybe, count), item[row], offset[row]


def _windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, from sums of powers as in a rolling hash."""
    acc = np.zeros(len(h) - length + 1, np.uint64)
    for j in range(length):
        acc = acc * _STEP + h[j : len(h) - length + 1 + j]
    return mix(acc)


def _match(texts: Texts, items: Items):
    """``(text, item, distance, first word, end word, byte range)`` for every item found in each text."""
    plain = plain_words(texts)
    h = plain.word_hash()
    starts = np.searchsorted(plain.doc, np.arange(len(plain) + 1))
    hits = [np.stack(x) for x in items.hits(h)] or [np.zeros((3, 0), np.int64)]
    at, item, offset = np.concatenate(hits, axis=1)
    doc = plain.doc[at] if len(at) else at
    order = np.lexsort((at - offset, item, doc))
    done: dict[tuple[int, int], tuple] = {}
    seen = None
    for k in order:
        d, i, begin = int(doc[k]), int(item[k]), int(at[k] - offset[k])
        if (d, i) in done and done[d, i][0] == 0 or seen == (d, i, begin):
            continue
        seen = (d, i, begin)
        budget, m = items.budget[i], len(items.words[i])
        a, b = max(begin - budget, int(starts[d])), min(begin + m + budget, int(starts[d + 1]))
        found = distance_within(items.words[i], h[a:b].tolist(), budget)
        if found and ((d, i) not in done or found[0] < done[d, i][0]):
            done[d, i] = (found[0], begin_of(items.words[i], h[a : a + found[1]].tolist(), found[0]) + a, a + found[1])
    for (d, i), (distance, a, b) in sorted(done.items()):
        yield d, i, distance, int(plain.starts[a] - texts.offsets[d]), int(plain.ends[b - 1] - texts.offsets[d])


def _item_blocks(items: DataFrame):
    """The items in blocks of bounded size, read one after the other."""
    ids, words, held = [], [], 0
    for row in items.select("item_id", F.col("text").cast("string")).orderBy("item_id").toLocalIterator():
        text = Texts(*buffers(pa.array([row["text"] or ""])))
        ids.append(row["item_id"])
        words.append(plain_words(text).word_hash())
        held += 40 * len(words[-1])
        if len(ids) >= ITEMS_AT_ONCE or held >= ITEM_BYTES:
            yield Items(ids, words)
            ids, words, held = [], [], 0
    if ids:
        yield Items(ids, words)


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, distance, start, end)`` for each item found in a document.

    ``distance`` counts word edits; ``start`` and ``end`` are UTF-8 byte offsets
    of the match in the text, end exclusive. The best match of an item in a document
    is returned, of equally good ones the first to end, and of those the shortest.

    Items of fewer than ``WORDS_PER_EDIT`` words match every exact run of their words,
    even a single one; null, empty and wordless items and texts match nothing. Repeated rows on either side are answered one by one. Items go in blocks of
    bounded size, each compared with all documents, so neither table has to be
    small. Empty tables give an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, distance int, start long, end long"
    found = None
    for block in _item_blocks(items):
        shared = spark.sparkContext.broadcast(block)  # at most ITEM_BYTES of words

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                for first, texts in chunks(batch.column("text")):
                    rows = list(_match(texts, block))
                    if rows:
                        d, i, distance, start, end = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("doc_id").take(pa.array([first + x for x in d])),
                                pa.array([block.ids[x] for x in i], pa.int64()),
                                pa.array(distance, pa.int32()),
                                pa.array(start, pa.int64()),
                                pa.array(end, pa.int64()),
                            ],
                            ["doc_id", "item_id", "distance", "start", "end"],
                        )

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents in which no item is found, with all their columns; every column value stays as it is."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    kept = docs
    for block in _item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, texts in chunks(batch.column(at)):
                    for d, *_ in _match(texts, shared.value):
                        clean[first + d] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
