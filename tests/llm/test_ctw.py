import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from atomsift.llm import ctw
from atomsift.llm.scratch import Scratch
from atomsift.llm.text import chunks


def brute(train, texts, depth):
    """Context-tree weighting by recursion over dictionaries."""
    pad, end = bytes([ctw.START] * depth), bytes([ctw.END])
    counts = Counter()

    def decisions(text):
        data = pad + text.encode() + end
        for at in range(depth, len(data)):
            for bit in range(8):
                prefix = (1 << bit) | (data[at] >> (8 - bit))
                yield data[at - depth : at], prefix, (data[at] >> (7 - bit)) & 1

    for text in train:
        for context, prefix, one in decisions(text):
            for d in range(depth + 1):
                counts[context[depth - d :], prefix, one] += 1
    children = {}
    for context, prefix, _ in counts:
        if context:
            children.setdefault((context[1:], prefix), set()).add(context)

    def kt(context, prefix):
        a, b = counts[context, prefix, 0], counts[context, prefix, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, prefix):
        key = context, prefix
        if key not in memo:
            own = kt(context, prefix)
            if len(context) < depth:
                below = sum(weighted(c, prefix) for c in children.get(key, ()))
                own = float(np.logaddexp(own, below)) + math.log(0.5)
            memo[key] = own
        return memo[key]

    out = []
    for text in texts:
        total = 0.0
        for context, prefix, one in decisions(text):
            p = None
            for d in range(depth, -1, -1):
                c = context[depth - d :]
                n = counts[c, prefix, 0] + counts[c, prefix, 1]
                if n:
                    own = (counts[c, prefix, one] + 0.5) / (n + 1)
                    alpha = math.exp(kt(c, prefix) + math.log(0.5) - weighted(c, prefix)) if d < depth else 1.0
                    p = own if p is None else alpha * own + (1 - alpha) * p
            total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


TEXTS = ["the cat sat on the mat", "The cat sat.", "", None, "äöü été", "zzz qqq", "the cat", "the cat", "a" * 3000, " \t ", "dog"]


def test_scores_equal_recursion(spark, docs_of):
    rows = list(enumerate(TEXTS))
    docs = docs_of([*rows, (None, "no id")])
    got = ctw.score_texts(docs, "crc32(cast(doc_id AS string)) % 10 <> 0", Scratch(spark, "t")).collect()
    assert len(got) == len(TEXTS) + 1
    by = {r["doc_id"]: r for r in got}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    assert any(held.values())
    train = [t or "" for i, t in rows if not held[i]]
    for (i, t), want in zip(rows, brute(train, [t or "" for _, t in rows], ctw.DEPTH), strict=True):
        assert by[i]["held_out"] == held[i]
        assert math.isclose(by[i]["score"], want, rel_tol=1e-9), (i, t)
        assert math.isclose(by[i]["bits_per_byte"] * (len((t or "").encode()) + 1), -want / math.log10(2), rel_tol=1e-9)
    words = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(words.values()), len(words)
    for i, t in rows:
        tokens = [*(t or "").lower().split(), None]
        assert by[i]["n_tokens"] == len(tokens) and by[i]["n_known"] == sum(words[w] > 0 for w in tokens)
        assert by[i]["train_tokens"] == n
        want = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert math.isclose(by[i]["base_score"], want, rel_tol=1e-9)


def test_rare_keys_by_shuffle_give_the_same(spark, docs_of, monkeypatch):
    docs, train = docs_of(list(enumerate(TEXTS))), "doc_id % 3 <> 0"
    one = sorted(ctw.score_texts(docs, train, Scratch(spark, "t")).collect())
    monkeypatch.setattr(ctw, "SHARE", 20)
    two = sorted(ctw.score_texts(docs, train, Scratch(spark, "t")).collect())
    assert np.allclose([r["score"] for r in one], [r["score"] for r in two])
    assert np.allclose([r["base_score"] for r in one], [r["base_score"] for r in two])
    assert [r["n_known"] for r in one] == [r["n_known"] for r in two]


def test_counting_holds_no_more_than_a_chunk_beyond_its_limit(monkeypatch):
    """One large batch is given on in parts, with the sums of the whole."""
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(160)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 5 > 0 for i in range(160)])], ["text", "train"])
    whole = pa.Table.from_batches(list(ctw._count([batch])))
    monkeypatch.setattr(ctw, "HOLD", 1 << 10)
    parts = list(ctw._count([batch]))
    assert max(b.num_rows for b in parts) <= (1 << 20) + (1 << 10) < whole.num_rows
    total = lambda t: sorted(map(tuple, (r.values() for r in t.group_by(["kind", "key"]).aggregate([("n", "sum")]).to_pylist())))
    assert total(pa.Table.from_batches(parts)) == total(whole)


def test_pieces_hold_whole_contexts(spark, docs_of, monkeypatch):
    rng = np.random.default_rng(7)
    key = rng.integers(0, 1 << 48, 5000) & ~0xF8F800
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(5000))], ["key", "n"])
    monkeypatch.setattr(ctw, "PIECE", 300)
    pieces = list(ctw._pieces([batch, batch.slice(0, 0)]))
    near = [set(((gram >> np.uint64(8)) & np.uint64(0xFFFF)).tolist()) for gram, _ in pieces]
    assert len(pieces) > 10 and sum(map(len, near)) == len(set.union(*near))
    assert sorted(n for _, part in pieces for n in part) == list(range(5000))
    assert list(ctw._pieces([])) == []
    docs = docs_of(list(enumerate(TEXTS)))
    few = sorted(ctw.score_texts(docs, "doc_id % 3 <> 0", Scratch(spark, "t")).collect())
    monkeypatch.undo()
    assert np.allclose([r["score"] for r in few], [r["score"] for r in sorted(ctw.score_texts(docs, "doc_id % 3 <> 0", Scratch(spark, "t")).collect())])


def test_edges(spark, docs_of):
    assert ctw.score_texts(docs_of([]), "true", Scratch(spark, "t")).count() == 0
    got = ctw.score_texts(docs_of([(1, "ab")]), "false", Scratch(spark, "t")).first()
    assert math.isclose(got["bits_per_byte"], 8.0) and got["train_tokens"] == 0


def test_lookup_and_grams():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 60, 5000).astype(np.uint64))
    table = ctw.Lookup(keys, np.arange(len(keys), dtype=float))
    values, found = table(np.concatenate([keys, keys + np.uint64(1)]))
    assert found[: len(keys)].all() and (values[: len(keys)] == np.arange(len(keys))).all()
    assert not found[len(keys) :][~np.isin(keys + np.uint64(1), keys)].any()
    for _, texts in chunks(pa.array(["ab", None, "", "cdé"])):
        grams, n = ctw.grams_of(texts)
        assert n.tolist() == [3, 1, 1, 5] and len(grams) == 10
        assert [int(g) & 0xFF for g in grams] == [97, 98, 255, 255, 255, 99, 100, 0xC3, 0xA9, 255]
