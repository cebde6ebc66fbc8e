import random
import re
from collections import defaultdict

import numpy as np
import pytest

from atomsift.llm import ngram_join
from atomsift.llm.scratch import Scratch


def sets(rows, words):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    return out


def brute(rows, words, percent):
    s = sets(rows, words)
    name = {i: i for i in s}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(s)
    for i in ids:
        for j in ids:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = root(i), root(j)
                name[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in ids}


def corpus(seed, n=160):
    """Texts of many sizes, chains of copies with edits, and a passage that half of them share."""
    rnd = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            words = (rnd.choice(rows)[1] or "w").split()
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(50)}"
        else:
            words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([1, 2, 3, 9, 12, 30, 80, 200]))]
        if rnd.random() < 0.3:
            words += passage
        rows.append((i, " ".join(words).upper() if rnd.random() < 0.1 else " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, rows[3][1]), (n + 4, "x")]


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_equals_all_pairs(spark, docs_of, monkeypatch, words, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # clusters span blocks
    rows = corpus(percent)
    got = ngram_join.similar_components(docs_of(rows).repartition(3), Scratch(spark, "t"), words, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, words, percent)


def test_routing_never_misses():
    """Any two similar sets share a key, whatever their sizes and edits."""
    rng = np.random.default_rng(8)
    for percent in (90, 95, 80):
        plan = ngram_join.Plan(percent)
        for _ in range(150):
            n = int(rng.choice([9, 10, 12, 20, 50, 300, 2000]))
            a = rng.integers(0, 1 << 52, n).astype(np.uint64)
            change = int(n * (100 - percent) / 100)
            b = np.concatenate([a[int(rng.integers(0, change + 1)) :], rng.integers(0, 1 << 52, int(rng.integers(0, 2 + change // 2))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if 100 * common < percent * (len(a) + len(b) - common):
                continue
            token, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            sizes = np.array([len(a), len(b)])
            found = {(int(band[d]), int(k)) for d, band, k in _flat(ngram_join._keys(token, doc, 2, sizes, plan)) if d == 0}
            other = {(int(band[d]), int(k)) for d, band, k in _flat(ngram_join._keys(token, doc, 2, sizes, plan)) if d == 1}
            assert len(a) == len(b) == common or found & other


def test_long_sets_have_few_keys():
    """Small groups stay below the spare ones, so keys for pairs of them are rare."""
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for n in (1000, 9000, 30_000, 33_000, 36_000):
            token = np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64))
            parts = ngram_join._keys(token, np.zeros(len(token), np.int64), 1, np.array([len(token)]), ngram_join.Plan(percent))
            assert sum(len(key) for _, _, key in parts) < 0.8 * n


def test_keys_follow_the_tokens_that_may_differ():
    """A text has about as many keys as tokens may differ, also below the top of its band."""
    rng = np.random.default_rng(6)
    for percent, most in ((80, 0.42), (90, 0.19)):
        plan = ngram_join.Plan(percent)
        for n in rng.integers(150, 6000, 25):
            token = np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64))
            parts = ngram_join._keys(token, np.zeros(len(token), np.int64), 1, np.array([len(token)]), plan)
            own, more = len(parts[0][2]), sum(len(key) for _, _, key in parts[1:])
            assert own <= n * (100 - percent) / percent + 1 and own + more < 2 * own
        sizes = rng.integers(150, 6000, 200)
        token = rng.integers(0, 1 << 52, sizes.sum()).astype(np.uint64)
        parts = ngram_join._keys(token, np.repeat(np.arange(200), sizes), 200, sizes, plan)
        assert sum(len(key) for _, _, key in parts) < most * sizes.sum()


def test_routing_at_the_limit():
    """Pairs that are just similar share a key, of sizes everywhere in a band and of one or two bands."""
    rng = np.random.default_rng(9)
    for percent in (80, 85, 86, 90):
        plan = ngram_join.Plan(percent)
        for n in [*range(4, 60), *rng.integers(60, 900, 60)]:
            for longer in (0, n * (100 - percent) // percent, int(rng.integers(0, n // 4 + 1))):
                m = n + longer
                common = -(-percent * (n + m) // (100 + percent))
                if common > n:
                    continue
                token = rng.integers(0, 1 << 52, m + n - common).astype(np.uint64)
                both = np.concatenate([token[:n], token[:common], token[n:]])
                doc, sizes = np.repeat([0, 1], [n, m]), np.array([n, m])
                found = [(d, int(band), int(k)) for d, band, k in (
                    (d, band[d], k) for d, band, k in _flat(ngram_join._keys(both, doc, 2, sizes, plan))
                )]
                assert n == m == common or {x[1:] for x in found if x[0] == 0} & {x[1:] for x in found if x[0] == 1}


def test_count_vectors_of_one_and_four_bytes():
    few, many = np.arange(300, dtype=np.uint64), np.full(300, 7, np.uint64)
    sizes = np.array([300, 300])
    made = ngram_join._count_vectors(np.concatenate([few, many]), np.repeat([0, 1], 300), sizes)
    assert len(made[1]) == 4 * len(made[0]) == 4 * ngram_join._widths(sizes)[0]
    points = ngram_join._fold(made, sizes)
    assert points.sum(1).tolist() == [300, 300] and points[1].max() == 300


def _flat(parts):
    for owner, band, key in parts:
        for d, k in zip(owner, key, strict=True):
            yield d, band, k


def test_tree_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(5, 60, 200))
    tokens = [np.unique(rng.integers(0, 400, s)).astype(np.uint64) for s in sizes]
    sizes = np.array([len(t) for t in tokens])
    points = ngram_join.group_counts(np.concatenate(tokens), np.repeat(np.arange(200), sizes), 200, 16)
    tree = ngram_join.BoxTree(points, sizes)
    for q in range(0, 200, 7):
        found = set(tree.search(points[q], int(sizes[q]), lambda a, b: -(-(a + b) // 5)).tolist())
        want = {p for p in range(200) if len(np.intersect1d(tokens[p], tokens[q])) >= -(-(sizes[p] + sizes[q]) // 5)}
        assert want <= found


def test_one_of_each_group_stays(spark, docs_of):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(5, text), (3, text + " end"), (7, text), (7, text), (8, "other " * 9), (9, None), (None, text), (8, "other " * 9)]
    kept = ngram_join.drop_similar(docs_of(rows), Scratch(spark, "t"))
    assert kept.columns == docs_of([]).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 8, 9]
    assert ngram_join.similar_components(docs_of([]), Scratch(spark, "t")).count() == 0


def test_star_edges_connect_keys_over_tasks(spark):
    rows = [(k % 3, i) for i, k in enumerate(range(600))]
    keyed = spark.createDataFrame(rows, "key long, node long")
    edges = [(r["a"], r["b"]) for r in ngram_join.star_edges(keyed, Scratch(spark, "t")).collect()]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, todo = set(), [0]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x]
    assert seen == {i for i in range(600) if i % 3 == 0}


def test_ids_that_share_and_differ_in_texts(spark, docs_of):
    """Links of every text of a repeated id, against all pairs."""
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    text = lambda words: " ".join(words)
    rows = [(1, text(base)), (2, text(base)), (2, text(other)), (3, text([*other, "tail"]))]  # 3 links with the other text of 2
    rows += [(10, text(f"x{i}" for i in range(50))), (11, text(f"y{i}" for i in range(50))), (11, text(f"x{i}" for i in range(50)))]
    rows += [(12, text([*(f"y{i}" for i in range(50)), "end"])), (13, None), (13, text(f"z{i}" for i in range(9))), (13, "")]
    rows += [(20, text(["only", *other[:30]])), (20, text(["only", *other[:30]])), (None, text(base))]
    got = ngram_join.similar_components(docs_of(rows), Scratch(spark, "test"), words=3, percent=90).collect()
    shingles = lambda t: {tuple(t.lower().split()[i : i + 3]) for i in range(len(t.split()) - 2)} if t else set()
    sets = [(d, shingles(t)) for d, t in rows]
    name = {d: d for d, _ in rows if d is not None}
    for _ in rows:
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 90 * len(x | y):
                    name[a] = name[b] = min(name[a], name[b])
    want = sorted(((d, len(x), name[d] if x else d) for d, x in sets if d is not None))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    kept = ngram_join.drop_similar(docs_of(rows), Scratch(spark, "test"), words=3, percent=90).collect()
    assert sorted({r["doc_id"] for r in kept if r["doc_id"] is not None}) == sorted(d for d, c in name.items() if d == c)
