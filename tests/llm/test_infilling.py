"""Fill-in-the-middle: cuts like plain slicing, exact round trips, chunk borders, memory, edges."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomsift.llm import infilling
from atomsift.llm.infilling import CACHE_BYTES, LEAST_CHUNK, MOST_CHUNK, Chunks, Measured, borders, infill, restore


def plain(doc_id, text):
    """The example by slicing the text."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def some_text(rnd, n):
    return "".join(rnd.choice("ab c\n\td é漢😀́") for _ in range(n))


def test_like_slicing(spark, docs_of):
    rnd = random.Random(8)
    shared = some_text(rnd, 9000)
    rows = [(d, some_text(rnd, rnd.choice([0, 1, 2, 50, 3000])) + (shared if d % 3 == 0 else "")) for d in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (None, None), (5, "same id"), (5, "same id"), (202, "😀")]
    rows += [(203, "x" * 300000), (204, "x<S>y"), (205, "<P" + ">"), (206, "a" * (LEAST_CHUNK - 1) + "<M>"), (207, "<P><")]
    docs = docs_of(rows)
    got = infill(docs).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plain(d, t) for d, t in rows), key=repr)
    texts = sorted(t or "" for _, t in rows)
    assert sorted(r["back"] for r in got) == texts
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill(docs_of([])).count() == 0


def test_words(spark, docs_of):
    text = "  eins zwei\tdrei\n\nvier é " * 900
    assert Measured(text.encode(), Chunks("words")).units == len(re.findall(r"\S+", text))
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    measured = Measured(text.encode(), Chunks("words"))
    for k in (0, 1, 2, 700, len(starts) - 1, len(starts)):
        want = 0 if k == 0 else len(text.encode()) if k >= len(starts) else len(text[: starts[k]].encode())
        assert measured.byte_of(k) == want
    row = infill(docs_of([(1, text)]), unit="words", plain_percent=0).first()
    assert row["n"] == len(starts) and row["form"] != "plain"
    with pytest.raises(ValueError):
        Chunks("lines")


def test_every_cut_and_marks_over_borders():
    rnd = random.Random(2)
    text = some_text(rnd, 4000)
    measured = Measured(text.encode(), Chunks())
    assert len(measured.ends) > 3
    assert [measured.byte_of(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    for end in measured.ends[:-1]:
        raw = text.encode()
        for shift in range(4):  # a mark laid over a border, also where it moves that border
            marked = raw[: end - shift] + b"<M>" + raw[end - shift :]
            assert Measured(marked, Chunks()).marked
    assert not measured.marked


def test_borders_follow_content(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 200_000).astype(np.uint8)
    ends = borders(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= MOST_CHUNK and sizes[:-1].min() >= LEAST_CHUNK
    moved = borders(np.concatenate([rnd.integers(0, 256, 777).astype(np.uint8), data]))
    assert len({e + 777 for e in ends} & set(moved)) > 0.9 * len(ends)
    monkeypatch.setattr(infilling, "PIECE", 5000)
    assert borders(data) == ends
    assert borders(np.zeros(0, np.uint8)) == [] and borders(np.zeros(3, np.uint8)) == [3]


def test_shared_chunks_are_remembered_within_bounds(monkeypatch):
    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 123, 100_000).astype(np.uint8).tobytes()
    chunks = Chunks()
    Measured(text, chunks)
    assert chunks.hits == 0
    Measured(b"something in front " + text, chunks)
    assert chunks.hits > 0.9 * len(chunks.known)
    monkeypatch.setattr(infilling, "CACHE_BYTES", 20_000)
    small = Chunks()
    assert Measured(text, small).units == len(text)
    assert small.held <= 20_000 < CACHE_BYTES and small.held == sum(map(len, small.known))
