"""Decontamination, quality, toxicity, embedding near-duplicates, components, pipeline."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from atomsift.llm import decontaminate, neardup, quality, toxicity
from atomsift.llm.components import connected_components
from atomsift.llm.scratch import Scratch
from atomsift.llm.text import chunks


def edit(pattern, text):
    """Least edit distance of the pattern to a substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rnd = random.Random(3)
    for _ in range(1500):
        p = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 80))]
        t = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 30))] + (p if rnd.random() < 0.5 else [])
        if t and rnd.random() < 0.5:
            t[rnd.randrange(len(t))] = 9
        found, want = decontaminate.distance_within(p, t, 9), edit(p, t)
        assert (found is None) == (want > 9) and (found is None or found[0] == want)


def test_items_found_like_brute_force(spark, docs_of):
    rnd = random.Random(6)
    items = [[f"w{rnd.randrange(60)}" for _ in range(rnd.choice([1, 2, 3, 5, 7, 8, 16, 40, 90]))] for _ in range(36)]
    rows = []
    for d in range(60):
        words = [f"w{rnd.randrange(60)}" for _ in range(30)]
        for _ in range(rnd.randint(0, 2)):
            copy = list(rnd.choice(items))
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(9)}"
            words += [*copy, "end"]
        rows.append((d, ", ".join(words).upper()))
    rows += [(100, None), (101, ""), (102, " ".join(items[0])), (103, "x")]
    bench = spark.createDataFrame(
        [*((i, "  ".join(w)) for i, w in enumerate(items)), (90, None), (91, "!!")], "item_id long, text string"
    )
    docs = docs_of(rows)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(docs, bench).collect()}
    want = {}
    for d, text in rows:
        words = (text or "").lower().replace(",", "").split()
        for i, item in enumerate(items):
            if words and edit(item, words) <= len(item) // decontaminate.WORDS_PER_EDIT:
                want[d, i] = edit(item, words)
    assert got == want
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_items(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0


def test_spans_of_edited_items(spark, docs_of):
    item = [f"a{k}" for k in range(24)]
    texts = {1: item, 2: item[1:], 3: item[:-1], 4: [*item[:5], "new", *item[5:]], 5: ["b0", *item[1:]], 6: item[:9] + item[11:]}
    docs = docs_of([(d, " ".join(["one", "two", *w, "three"])) for d, w in texts.items()])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_items(docs, bench).collect()}
    want = {d: " ".join(w if d != 5 else w[1:]) for d, w in texts.items()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {d: text[d].encode()[r["start"] : r["end"]].decode() for d, r in found.items()} == want
    assert [found[d]["distance"] for d in range(1, 7)] == [0, 1, 1, 1, 1, 2]


def test_words_of_any_script():
    import unicodedata

    def words(text):
        out, word = [], ""
        for c in text:
            single = "\u0e00" <= c < "\u0e80" or "\u3040" <= c < "\u3100" or "\u3400" <= c < "\ua000" or c >= "\U00020000"
            inside = unicodedata.category(c)[0] in "LNM"
            if word and (single or not inside):
                out, word = [*out, word], ""
            if inside and single:
                out.append(c)
            elif inside:
                word += c.lower() if c.isascii() else c
        return [*out, word] if word else out

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aB3 é\u0301\u2019\u201c\u2014\u00a0\u3002\uff0c\u3042\u30ab\u6f22\u5b57\u0e01\u0e34\U00020001\U0001f600я.") for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    texts += [None, ""]
    for _, part in chunks(pa.array(texts), size=300):
        plain = decontaminate.plain_words(part)
        got = [[] for _ in range(len(part))]
        for d, a, b in zip(plain.doc, plain.starts, plain.ends, strict=True):
            got[d].append(plain.data[a:b].tobytes().decode())
        assert got == [words(part.raw[a:b].tobytes().decode()) for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]


def test_items_in_unspaced_scripts_and_typographic_signs(spark, docs_of):
    chinese, thai = "\u54ea\u4e00\u5ea7\u57ce\u5e02\u662f\u6cd5\u56fd\u7684\u9996\u90fd", "\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e\u0e2d\u0e22\u0e39\u0e48"
    latin = "the quick brown fox isn't over the lazy dog at all"
    bench = spark.createDataFrame([(1, chinese + "\uff1f"), (2, thai), (3, latin)], "item_id long, text string")
    docs = docs_of(
        [
            (1, "\u95ee\u9898\uff1a" + chinese + "\u3002\u7b54\u6848\u5728\u4e0b\u9762"),
            (2, "\u0e02\u0e49\u0e2d" + thai + "\u0e04\u0e23\u0e31\u0e1a"),
            (3, "so \u201cthe quick\u2014brown\u00a0fox isn\u2019t over \u2018the lazy dog\u2019 at all\u2026\u201d he said"),
            (4, "\u95ee\u9898\uff1a" + chinese[::-1]),
        ]
    )
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start"], r["end"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): 0, (2, 2): 0, (3, 3): 0}
    assert got[1, 1][1:] == (9, 9 + 3 * len(chinese))
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {4}


def graded(n, seed=1):
    rnd = random.Random(seed)
    texts, grades = [], []
    for _ in range(n):
        g = rnd.randrange(4)
        words = [f"{rnd.choice('abcdefg')}{rnd.choice('aeiou')}{rnd.choice('nrst')}" for _ in range(40)]
        texts.append(" ".join(w + "!" * (rnd.random() > g / 3) for w in words))
        grades.append(g)
    return texts, grades


def test_ordinal_grades(spark, docs_of):
    texts, grades = graded(600)
    docs = docs_of([*enumerate(texts), (900, None), (901, ""), (902, texts[0]), (902, texts[0]), (None, texts[1])])
    ratings = spark.createDataFrame([*enumerate(grades[:400]), (3, None), (None, 1)], "doc_id long, grade int")
    model = quality.train(docs, ratings, "grade")
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    got = {r["doc_id"]: r for r in quality.rate(docs, model, least=2).collect()}
    held = range(400, 600)
    expected = np.array([got[i]["expected_grade"] for i in held])
    assert np.abs(expected - np.array(grades[400:])).mean() < 0.6
    assert np.mean([(got[i]["tail_probability"] >= 0.5) == (grades[i] >= 2) for i in held]) > 0.85
    assert got[900]["expected_grade"] == got[901]["expected_grade"]
    kept = quality.select(docs, model, least=2)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["keep"]}
    one = quality.train(docs, ratings.where("grade = 1"), "grade")
    assert quality.rate(docs, one, least=1).where("keep").count() == docs.count()
    assert quality.rate(docs.limit(0), one, least=1).count() == 0
    assert quality.rate(docs, quality.train(docs, ratings.limit(0), "grade"), least=1).count() == docs.count()


def test_gradient_of_the_cumulative_link():
    row, column, value = np.array([0, 0, 1, 2]), np.array([1, 2, 1, 3]), np.array([1.0, 0.5, 1.0, 2.0])
    model = quality.fit(row, column, value, np.array([0, 1, 2]), np.array([0, 1, 2]), steps=400)
    tails = model.tails(model.latent(row, column, value, 3))
    assert tails[0, 0] < 0.5 < tails[1, 0] and tails[1, 1] < 0.5 < tails[2, 1]


def test_fit_is_the_penalised_maximum():
    """At the fitted weights and thresholds the plain loss, differentiated by differences, is flat."""
    rng = np.random.default_rng(2)
    n, used, decay = 80, 6, 0.02
    row, column = np.repeat(np.arange(n), 3), rng.integers(0, used, 3 * n)
    value = rng.normal(size=3 * n)
    dense = np.zeros((n, used))
    np.add.at(dense, (row, column), value)
    y = np.digitize(dense @ np.linspace(-1, 1, used) + rng.logistic(size=n), [-1.0, 0.2, 1.5])
    model = quality.fit(row, column, value, y, np.arange(4), steps=1200, decay=decay)

    def loss(p):
        cuts = np.concatenate([[-np.inf], p[used:], [np.inf]])
        z = dense @ p[:used]
        mass = 1 / (1 + np.exp(z - cuts[y + 1])) - 1 / (1 + np.exp(z - cuts[y]))
        return -np.log(mass).mean() + decay / 2 * (p[:used] ** 2).sum()

    at = np.concatenate([model.weights[:used], model.thresholds])
    slopes = [(loss(at + step) - loss(at - step)) / 2e-5 for step in 1e-5 * np.eye(len(at))]
    assert np.abs(slopes).max() < 1e-4
    assert (np.diff(model.thresholds) > 0).all() and not model.weights[used:].any()


def test_network_gradients():
    p = {k: v.astype(float) for k, v in toxicity.initial(1).items()}
    rng = np.random.default_rng(0)
    x, index = rng.normal(size=(9, 2 * toxicity.SIZE)), rng.integers(0, 9, (5, 7))
    there = (np.arange(7) < np.array([7, 3, 1, 5, 6])[:, None]).astype(float)
    y = np.array([1, 0, 1, 0, 0])
    _, g, d_x = toxicity.gradients(p, x, index, there, y)
    for name in ("xf", "hf", "cf", "xb", "hb", "cb", "attend", "out", "bias"):
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        value, losses = p[name][at], []
        for step in (1e-5, -1e-5):
            p[name][at] = value + step
            losses.append(toxicity.gradients(p, x, index, there, y)[0])
        p[name][at] = value
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-6
    assert d_x.shape == x.shape


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 23, 24, 25, 40, 41, 500])
    text, first, length = toxicity.windows(sizes)
    starts = np.cumsum(sizes) - sizes
    for t, n in enumerate(sizes):
        mine = text == t
        spans = [(f - starts[t], f - starts[t] + k) for f, k in zip(first[mine], length[mine], strict=True)]
        assert sorted({w for a, b in spans for w in range(a, b)}) == list(range(n))
        assert all(a[1] > b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_toxic_texts_held_out(spark, docs_of):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["ta", "re", "li", "mo", "su", "ne"]) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rnd.choice([10, 60, 200]))]
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "Scum!", "rotten"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = docs_of([*rows, (500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1])])
    model = toxicity.train(docs, spark.createDataFrame([*labels, (7, None)], "doc_id long, toxic int"), "doc_id < 300")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    right = [got[i]["predicted"] == toxic for i, toxic in labels[300:]]
    assert np.mean(right) > 0.9
    assert got[500]["score"] == got[501]["score"] == 0 and np.isclose(got[502]["score"], got[0]["score"])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), "true")
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_toxic_texts_that_are_long_are_learnt(spark, docs_of, monkeypatch):
    """A class of long texts is not lost; past the bound its shortest texts stay."""
    rnd = random.Random(4)
    clean = lambda n: [rnd.choice(["tare", "limo", "sune", "reta", "molisu"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(60):
        words = clean(4000 if i % 2 else 50)
        for at in range(10, len(words), 40) if i % 2 else ():
            words[at] = rnd.choice(["vile", "scum", "rotten"])
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    docs, table = docs_of([*rows, (1, "vile")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, table, "doc_id < 40")
    got = {(r["doc_id"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    assert got >= {(i, i % 2) for i in range(60)}
    monkeypatch.setattr(toxicity, "FIT_CHARS", 100)
    assert toxicity._longest_kept([(True, 500, 1), (True, 900, 1), (False, 30, 2), (False, 40, 1), (False, 90, 1)]) == {True: 500, False: 40}
    assert toxicity._longest_kept([]) == {True: 0, False: 0}


def brute_links(x, least):
    units = {}
    for i, v in x:
        ok = v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        units[i] = np.array(v, float) / np.linalg.norm(v) if ok else None
    links = {i: {j for j in units if j != i and a is not None and units[j] is not None and a @ units[j] >= least} for i, a in units.items()}
    name = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in name:
                name[k] = i
                todo += links[k]
    return {i: (len(links[i]), name[i], name[i] == i) for i in links}


def test_vectors_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "CELL_ROWS", 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    x = [v.tolist() for v in np.concatenate([base, base[:30] + rng.normal(0, 0.05, (30, 8)), np.repeat(base[:1], 50, 0), base[1] + rng.normal(0, 0.02, (70, 8))])]
    x += [None, [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [], [1e200] * 8, [1e-200] * 8]
    rows = [(i, v, 1) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table, Scratch(spark, "t")).collect()}
    want = brute_links([(i, None if v is None else [c / max(map(abs, v)) if c is not None and np.isfinite(c) and any(v) else c for c in v] if v and all(c is not None for c in v) else v) for i, v, _ in rows], 0.9)
    assert set(got) == set(want)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found >= 0.95 * true and all(got[i][0] <= want[i][0] for i in got)
    assert np.mean([got[i] == want[i] for i in got]) > 0.95
    assert neardup.near_duplicates(table.limit(0), Scratch(spark, "t")).count() == 0


def test_links_of_a_tight_group_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_ROWS", 48)
    monkeypatch.setattr(neardup, "BLOCK", 300)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 64))
    x[:800] = x[0] + rng.normal(0, 0.2, (800, 64))
    x[800:1000] = x[1000:1200] + rng.normal(0, 0.45, (200, 64))
    x[1200:1300] = x[1200]
    x = x[rng.permutation(len(x))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table, Scratch(spark, "t")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    name = np.arange(len(u))
    while (low := np.where(near | np.eye(len(u), dtype=bool), name[None, :], len(u)).min(1)).tolist() != name.tolist():
        name = low
    assert got == {i: (near[i].sum(), name[i], name[i] == i) for i in range(len(u))}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    name = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(400):
        for a, b in pairs:
            if a != b:
                name[a] = name[b] = min(name[a], name[b])
    assert got == name
    assert connected_components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_scratch_tables_go(spark):
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.range(3).toDF("x"))
    files = kept.inputFiles()
    scratch.drop(kept)
    from pathlib import Path
    from urllib.parse import urlparse

    assert files and not any(Path(urlparse(f).path).exists() for f in files)


def test_word_hash_is_by_content():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab é\t") for _ in range(rnd.randint(0, 40))) for _ in range(300)] + [None]
    seen = {}
    for first, part in chunks(pa.array(texts), size=100):
        h = part.word_hash()
        for k in range(len(h)):
            word = part.data[part.starts[k] : part.ends[k]].tobytes()
            assert seen.setdefault(word, h[k]) == h[k]
        for t in range(len(part)):
            assert (part.doc == t).sum() == len((texts[first + t] or "").split())
    assert len(set(seen.values())) == len(seen)


def test_stages_on_a_small_corpus(spark, docs_of, workdir):
    good = [" ".join(f"{a}{b}" for b in random.Random(i).sample(range(500), 60)) for i, a in enumerate("abcdefgh" * 6)]
    rows = [(i, t + (" a@b.cd." if i % 4 == 0 else ".")) for i, t in enumerate(good)]
    rows += [(100 + i, t.upper().replace(" ", "!! ")) for i, t in enumerate(good[:20])]
    item = " ".join(f"q{k}" for k in range(20))
    rows += [(200, good[0] + ". " + good[0][:5]), (201, good[5] + " more " + item + " " + good[7])]
    docs = docs_of(rows).drop("key")
    docs.write.parquet(workdir + "/documents.parquet")
    labels = [(i, int(i < 100), 0) for i, _ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(workdir + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(workdir + "/benchmark.parquet")
    steps, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, workdir)
        steps[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
            at = spark.createDataFrame(steps[name], docs.schema)
    ids = {name: {r["doc_id"] for r in rows_} for name, rows_ in steps.items()}
    assert ids["quality"] >= set(range(48)) and not ids["quality"] & set(range(100, 120))
    assert 200 not in ids["near copies"] and set(range(48)) <= ids["near copies"]
    assert 201 in ids["near copies"] and 201 not in ids["benchmark"] and set(range(48)) <= ids["benchmark"]
    changed = {r["doc_id"]: r for r in steps["personal data"]}
    assert "[email]" in changed[4]["text"] and changed[4]["n_chars"] == len(changed[4]["text"])
    packed = corpus_pipeline.run(spark, workdir)
    assert {r["doc_id"] for r in packed.collect()} == ids["personal data"] == ids["packing"]
