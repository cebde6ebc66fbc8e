"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Every byte is eight binary decisions. A decision has a node for each context
depth (0 to ``DEPTH`` bytes before it), and a node mixes its own Krichevsky-
Trofimov estimate with what its deeper contexts predict; the weights follow from
the code lengths of the whole training corpus. A context that was never seen in
training predicts like the deepest one that was.

Texts are coded as bytes with ``DEPTH`` start signs before and an end sign after
them, so probabilities of all texts add up to at most one. All training counts are
sums over the corpus: a gram is ``DEPTH`` context bytes and the coded byte, and
the shallower counts are sums of those. Probabilities exist for every gram of the
scored texts. Grams (and words) that make up at least one part in ``SHARE`` of
the corpus, so no more than ``SHARE`` of them, are looked up in a table that every
task has; all others are joined by shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from .scratch import Scratch
from .text import chunks, mix

DEPTH = 5
SHARE = 1 << 22
START, END = 0xFE, 0xFF  # bytes that UTF-8 never holds
END_WORD = np.uint64(1)
HOLD = 1 << 20  # keys gathered before a task sums them up, besides those of one chunk
PIECE = 1 << 18  # grams weighted at a time, besides those of one pair of nearest bytes


def grams_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a chunk (context bytes above, coded byte lowest) and their number per text."""
    lengths = np.diff(texts.offsets)
    n = len(lengths)
    width = lengths + DEPTH + 1
    at = np.concatenate([[0], np.cumsum(width)])
    padded = np.full(at[-1], START, np.uint8)
    padded[at[1:] - 1] = END
    shift = np.repeat(at[:-1] + DEPTH - texts.offsets[:-1], lengths)
    padded[np.arange(len(texts.raw)) + shift] = texts.raw
    gram = np.zeros(max(len(padded) - DEPTH, 0), np.uint64)
    for back in range(DEPTH + 1):
        gram |= padded[DEPTH - back : len(padded) - back].astype(np.uint64) << np.uint64(8 * back)
    # windows that begin in one text and end in the next are not grams
    keep = np.ones(len(gram), bool)
    for j in range(DEPTH):
        keep[(at[1:-1] - DEPTH + j)] = False
    return (gram[keep] if n > 1 else gram), lengths + 1


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in text order and the number of words per text, end sign not included."""
    return texts.word_hash(), np.bincount(texts.doc, minlength=len(texts))


class _Sums:
    """Counts of 64-bit keys, held in bounded memory."""

    def __init__(self):
        self.waiting, self.held = [], 0

    def add(self, keys, seen):
        self.waiting.append((keys, seen))
        self.held += len(keys)

    def take(self):
        keys = np.concatenate([k for k, _ in self.waiting]) if self.waiting else np.zeros(0, np.uint64)
        seen = np.concatenate([s for _, s in self.waiting]) if self.waiting else np.zeros(0, np.int64)
        self.waiting, self.held = [], 0
        order = np.argsort(keys)
        keys, seen = keys[order], seen[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(seen, first) if len(first) else seen


def _unique(keys: np.ndarray):
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _count(batches):
    """``kind`` 0 word, 1 gram; ``n`` counts training texts only, so keys of held-out ones have 0."""
    sums = {0: _Sums(), 1: _Sums()}

    def out(kind):
        keys, n = sums[kind].take()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n)],
            ["kind", "key", "n"],
        )

    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False)
        for first, texts in chunks(batch.column("text")):
            own = train[first : first + len(texts)]
            words, per_text = words_of(texts)
            words = words[np.repeat(own, per_text)]
            ends = np.full(int(own.sum()), END_WORD)
            keys, n = _unique(np.concatenate([words, ends]))
            sums[0].add(keys, n)
            grams, per_text = grams_of(texts)
            mine = np.repeat(own, per_text)
            keys, n = _unique(grams[mine])
            sums[1].add(keys, n)
            rest = np.unique(grams[~mine])
            sums[1].add(rest, np.zeros(len(rest), np.int64))
            for kind in sums:
                if sums[kind].held >= HOLD:
                    yield out(kind)
    for kind in sums:
        yield out(kind)


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2)."""
    return _lgamma(n + 0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: eight steps of the recurrence, then Stirling's series."""
    x = np.asarray(x, float).copy()
    below = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        below += np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    inverse = 1 / x
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - below


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma_half(zeros) + _lgamma_half(ones) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


LOG_HALF = np.log(0.5)
LOCAL = 2  # contexts of this many bytes and more are weighted inside one task


class Depth:
    """Distinct (context, byte) rows of one depth, ascending, and the rows they have one byte less deep."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n = key, n

    def shorter(self, depth: int):
        """The rows of ``depth`` and, for each row here, its row there."""
        key, up = np.unique(self.key & np.uint64((1 << (8 * depth + 8)) - 1), return_inverse=True)
        return Depth(key, np.bincount(up, self.n, len(key))), up

    def nodes(self, bit: int):
        """First row of each node of a decision, each row's node, and the node's counts.

        A node is a context with the first ``bit`` bits of the byte, hence a run of rows.
        """
        run = self.key >> np.uint64(8 - bit)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(run))))
        one = ((self.key >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        ones, every = np.bincount(node, self.n * one), np.bincount(node, self.n)
        return first, node, every - ones, ones


def _depths(gram, n):
    """Tables from ``DEPTH`` down to ``LOCAL`` and the steps between them."""
    order = np.argsort(gram)
    tables, ups = [Depth(gram[order], n[order])], []
    for depth in range(DEPTH - 1, LOCAL - 1, -1):
        table, up = tables[-1].shorter(depth)
        tables.append(table)
        ups.append(up)
    return tables, ups


def _weighted(tables, ups, bit):
    """For each depth: nodes of rows, counts, log KT and log P_w; contexts add up bottom-up."""
    out, below = [], None
    for i, table in enumerate(tables):
        first, node, zeros, ones = table.nodes(bit)
        kt = log_kt(zeros, ones)
        if below is None:
            log_w = kt
        else:
            deeper_first, deeper_w = below
            sums = np.bincount(node[ups[i - 1][deeper_first]], deeper_w, len(first))
            log_w = np.logaddexp(kt + LOG_HALF, sums + LOG_HALF)
        out.append((first, node, zeros, ones, kt, log_w))
        below = first, log_w
    return out


def _pieces(batches):
    """All rows of a task, about ``PIECE`` at a time.

    Subtrees are complete, as rows are dealt to tasks and pieces by the two nearest context bytes.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    gram, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    del parts, table
    near = ((gram >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)
    order = np.argsort(near, kind="stable")
    ends = np.unique(np.cumsum(np.bincount(near)))
    ends = ends[ends > 0]
    first = 0
    while first < len(gram):
        last = int(ends[min(np.searchsorted(ends, first + PIECE), len(ends) - 1)])
        rows = order[first:last]
        yield gram[rows], n[rows].astype(float)
        first = last


def _shallow_parts(batches):
    """For depth 1: counts, and sums of log P_w over the contexts of depth 2, per node of depth 1."""
    for gram, n in _pieces(batches):
        tables, ups = _depths(gram, n)
        for bit in range(8):
            first, _, zeros, ones, _, log_w = _weighted(tables, ups, bit)[-1]
            key = tables[-1].key[first].astype(np.int64)
            number = (key & 0xFF00) | (1 << bit) | ((key & 0xFF) >> (8 - bit))
            name, node = np.unique(number, return_inverse=True)
            sums = [np.bincount(node, v, len(name)) for v in (zeros, ones, log_w)]
            yield pa.RecordBatch.from_arrays([pa.array(name), *map(pa.array, sums)], ["node", "zeros", "ones", "log_w"])


def _shallow_model(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """Mixing weight and estimates of the nodes of depth 0 and 1, by node number."""
    zeros, ones, below = np.zeros((3, 1 << 16))
    zeros[rows["node"]], ones[rows["node"]], below[rows["node"]] = rows["zeros"], rows["ones"], rows["log_w"]
    used = (zeros + ones) > 0
    kt = log_kt(zeros, ones)
    log_w = np.where(used, np.logaddexp(kt + LOG_HALF, below + LOG_HALF), 0.0)
    fold = lambda v: v.reshape(256, 256).sum(0)
    z0, o0 = fold(zeros), fold(ones)
    kt0 = log_kt(z0, o0)
    log_w0 = np.logaddexp(kt0 + LOG_HALF, fold(log_w) + LOG_HALF)
    return {
        "zeros1": zeros, "ones1": ones, "alpha1": np.exp(kt + LOG_HALF - log_w),
        "zeros0": z0, "ones0": o0, "alpha0": np.exp(kt0 + LOG_HALF - log_w0),
    }


def _blend(p, known, own, alpha, seen):
    """One step towards the root: the node's own estimate against that of the deeper contexts."""
    mixed = np.where(known, alpha * own + (1 - alpha) * p, own)
    return np.where(seen, mixed, p), known | seen


def _gram_scores(shallow):
    def run(batches):
        model = shallow.value
        for gram, n in _pieces(batches):
            tables, ups = _depths(gram, n)
            gram, n = tables[0].key, tables[0].n
            symbol, near = (gram & np.uint64(0xFF)).astype(np.int64), (gram & np.uint64(0xFF00)).astype(np.int64)
            total = np.zeros(len(gram))
            for bit in range(8):
                one = ((symbol >> (7 - bit)) & 1).astype(bool)
                p, known = np.full(len(gram), 0.5), np.zeros(len(gram), bool)
                row = np.arange(len(gram))
                for i, (_, node, zeros, ones, kt, log_w) in enumerate(_weighted(tables, ups, bit)):
                    row = row if i == 0 else ups[i - 1][row]
                    at = node[row]
                    own = np.where(one, ones[at] + 0.5, zeros[at] + 0.5) / (zeros[at] + ones[at] + 1.0)
                    p, known = _blend(p, known, own, np.exp(kt + LOG_HALF - log_w)[at], (zeros + ones > 0)[at])
                prefix = (1 << bit) | (symbol >> (8 - bit))
                for at, depth in ((near | prefix, "1"), (prefix, "0")):
                    zeros, ones = model["zeros" + depth][at], model["ones" + depth][at]
                    own = np.where(one, ones + 0.5, zeros + 0.5) / (zeros + ones + 1.0)
                    p, known = _blend(p, known, own, model["alpha" + depth][at], zeros + ones > 0)
                total += np.log10(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(total)], ["key", "n", "value"]
            )

    return run


class Lookup:
    """Hash table of 64-bit keys for whole arrays; keys that find a slot taken go to a further table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, salt: int = 0):
        self.salt, self.bits = np.uint64(salt), max(4, int(len(keys) * 2).bit_length())
        slot = self._slot(keys)
        self.keys = np.full(1 << self.bits, np.uint64((1 << 64) - 1))
        self.values = np.zeros(1 << self.bits)
        self.keys[slot], self.values[slot] = keys, values
        late = self.keys[slot] != keys
        self.rest = Lookup(keys[late], values[late], salt + 1) if late.any() else None

    def _slot(self, keys):
        return (mix(keys + self.salt) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys):
        slot = self._slot(keys)
        found = self.keys[slot] == keys
        values = np.where(found, self.values[slot], 0.0)
        if self.rest is not None:
            open_ = np.flatnonzero(~found)
            values[open_], found[open_] = self.rest(keys[open_])
        return values, found


def _bounded(table: DataFrame, total: int) -> Lookup:
    """Lookup of the keys with at least one part in ``SHARE`` of all occurrences."""
    frequent = table.where(F.col("n") * F.lit(SHARE) >= F.lit(total)).where("n > 0").select("key", "n", "value")
    frequent = frequent.toArrow()
    order = np.argsort(frequent["n"].to_numpy())  # of keys with one slot the most frequent one is found first
    return Lookup(frequent["key"].to_numpy().view(np.uint64)[order], frequent["value"].to_numpy()[order])


SCHEMA = """doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double,
            score double, bits_per_byte double"""


def score_texts(docs: DataFrame, train: str, scratch: Scratch) -> DataFrame:
    """Log-probabilities of all texts, learned from the rows where the SQL condition ``train`` holds.

    Columns: ``doc_id``, ``held_out``, ``n_tokens`` (words and one end sign),
    ``n_known`` (those seen in training), ``train_tokens``, ``base_score``
    (smoothed unigram log10 probability of the lower-cased words), ``score``
    (context-tree log10 probability of the bytes) and ``bits_per_byte`` (code
    length per byte, end sign included).

    Null text is the empty text, which has the end sign only. Equal texts score
    equally; repeated rows and a null ``doc_id`` are scored like others (a null
    id is not a training row). Without training rows every decision costs one
    bit. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.expr(train), F.lit(False)).alias("train")
    )
    counted = rows.select("text", "train").mapInArrow(_count, "kind byte, key long, n long")
    counts = scratch.keep(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sums = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("kinds")).collect()
    total = {r["kind"]: (r["n"] or 0, r["kinds"]) for r in sums}
    tokens, kinds = total.get(0, (0, 0))
    words = counts.where("kind = 0").select("key", "n", F.col("n").cast("double").alias("value"))

    near = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    grams = counts.where("kind = 1").select("key", "n").repartition(near)
    parts = grams.mapInArrow(_shallow_parts, "node long, zeros double, ones double, log_w double")
    parts = parts.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")))
    shallow = spark.sparkContext.broadcast(_shallow_model(parts.toPandas()))  # 256 x 256 nodes at most
    valued = scratch.keep(grams.mapInArrow(_gram_scores(shallow), "key long, n long, value double"), "grams")

    tables = spark.sparkContext.broadcast(
        {"word": _bounded(words, tokens), "gram": _bounded(valued, total.get(1, (0, 0))[0])}
    )
    smooth = 0.1 * (kinds + 1)

    def run(batches):
        word_table, gram_table = tables.value["word"], tables.value["gram"]
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                n = len(texts)
                columns = {}
                words, per_text = words_of(texts)
                at = np.append(0, np.cumsum(per_text + 1))
                keys = np.full(at[-1], END_WORD)
                keys[np.arange(len(words)) + np.repeat(np.arange(n), per_text)] = words
                doc = np.repeat(np.arange(n), per_text + 1)
                count, found = word_table(keys)
                part = np.where(found, np.log10((count + 0.1) / (tokens + smooth)), 0.0)
                columns["n_tokens"] = pa.array(per_text + 1)
                columns["n_known"] = pa.array(np.bincount(doc[found], minlength=n))
                columns["base"] = pa.array(np.bincount(doc, part, n))
                columns["rare_words"] = _rare(keys[~found], doc[~found], n)
                grams, per_text = grams_of(texts)
                doc = np.repeat(np.arange(n), per_text)
                value, found = gram_table(grams)
                columns["coded"] = pa.array(np.bincount(doc, value, n))
                columns["rare_grams"] = _rare(grams[~found], doc[~found], n)
                columns["bytes"] = pa.array(per_text - 1)
                columns |= {c: batch.column(c).slice(first, n) for c in ("doc_id", "train")}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = (
        "n_tokens long, n_known long, base double, rare_words array<long>, coded double, rare_grams array<long>, "
        "bytes long, doc_id long, train boolean"
    )
    scored = scratch.keep(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    unseen = F.lit(0.1 / (tokens + smooth))
    c = F.col("value")
    late_words = (
        scored.select("row", F.explode("rare_words").alias("key"))
        .join(words, "key", "left")
        .groupBy("row")
        .agg(
            F.count_if(c > 0).alias("late_known"),
            F.sum(F.log10(F.coalesce((c + 0.1) / F.lit(tokens + smooth), unseen))).alias("late_base"),
        )
    )
    late_grams = (
        scored.select("row", F.explode("rare_grams").alias("key"))
        .join(valued, "key")
        .groupBy("row")
        .agg(F.sum("value").alias("late_coded"))
    )
    full = scored.drop("rare_words", "rare_grams").join(late_words, "row", "left").join(late_grams, "row", "left")
    late = lambda name: F.coalesce(name, F.lit(0))
    score = F.col("coded") + late("late_coded")
    return full.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + late("late_known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + late("late_base")).alias("base_score"),
        score.alias("score"),
        (-score / float(np.log10(2)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )


def _rare(keys, doc, n):
    counts = np.bincount(doc, minlength=n)
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
