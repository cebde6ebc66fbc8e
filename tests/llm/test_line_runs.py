"""Line deduplication: whole results against plain counting, runs that merge, reopening, edges."""

import random
import re
from collections import defaultdict

from atomsift.llm.line_runs import LineRuns, dedup_lines, line_key, line_pairs
from atomsift.llm.scratch import Scratch

WS = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def plain(rows, least_chars, least_docs):
    """Per row: number of lines, number dropped, kept text."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: WS.sub("", line).translate(lower)
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= least_chars:
                held[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        common = lambda line: len(held.get(key(line), ())) >= least_docs
        kept = [x for x in lines if d is None or not common(x) or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def compare(spark, docs_of, rows, batches=6, fanout=4):
    got = dedup_lines(docs_of(rows), Scratch(spark, "test"), 8, 3, batches, fanout).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows, 8, 3), key=repr)


def test_like_plain_counting(spark, docs_of):
    rnd = random.Random(4)
    shared = [f"shared line number {i} é😀" for i in range(12)]
    rows = []
    for d in range(80):
        lines = [rnd.choice(shared) if rnd.random() < 0.4 else f"own {d} {rnd.randrange(9)}" for _ in range(rnd.randrange(9))]
        lines = [rnd.choice(["", " ", "\t", "\x0b "]) + (x.upper() if rnd.random() < 0.3 else x) + rnd.choice(["", "\r"]) for x in lines]
        rows.append((d, "\n".join(lines)))
    compare(spark, docs_of, rows)
    compare(spark, docs_of, rows, batches=1)
    compare(spark, docs_of, rows, batches=5, fanout=2)


def test_edges(spark, docs_of):
    line = "exactly this line"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (5, line), (5, line), (6, f"{line}\n{line}\nrest"), (None, line)]
    rows += [(None, None), (7, f"x\n  {line.upper()}\t"), (8, "seven77"), (9, "seven77"), (10, "seven77")]
    rows += [(11, "\n".join(["a very long text of lines", line] * 20000))]
    compare(spark, docs_of, rows)
    compare(spark, docs_of, [])
    compare(spark, docs_of, [(1, None)])


def test_case_and_blanks_are_ascii_only(spark, docs_of):
    rows = [(d, t) for d, t in enumerate(["ÄÖÜ ÄÖÜ ÄÖÜ", "äöü äöü äöü", "äöü äöü äöü", " äöü äöü äöü", "äöü äöü äöü\x0c"])]
    compare(spark, docs_of, rows)


def test_runs_merge_and_batches_repeat(spark, docs_of):
    root = f"{Scratch(spark, 'test').root}/runs"
    runs = LineRuns(spark, root, buckets=3, fanout=2)
    batches = [[(d, f"line of the batch {d // 4}\nanother line {d}") for d in range(4 * b, 4 * b + 4)] for b in range(5)]
    for batch in batches[:3]:
        runs.add(line_pairs(docs_of(batch), 8))
    assert sorted(runs.runs) == [(0, 2, 2), (1, 0, 1)]
    again = LineRuns(spark, root, buckets=3, fanout=2)
    assert sorted(again.runs) == sorted(runs.runs)
    again.add(line_pairs(docs_of(batches[1]), 8))  # nothing new: an empty run
    assert sorted(again.runs) == [(2, 0, 3)]
    for batch in batches[3:]:
        again.add(line_pairs(docs_of(batch), 8))
    pairs = [tuple(r) for r in again.pairs().collect()]
    want = {(line_key(x.encode()), d) for b in batches for d, t in b for x in t.split("\n")}
    assert len(pairs) == len(want) and {(bytes(k), d) for k, d in pairs} == want
    plans = again.pairs().groupBy("key", "doc_id").count()._jdf.queryExecution().toString()
    assert "Bucketed: true" in plans and "Exchange" not in plans
    again.delete()
    assert again.pairs().count() == 0


def test_runs_refuse_other_buckets(spark, docs_of):
    root = f"{Scratch(spark, 'test').root}/runs"
    LineRuns(spark, root, buckets=3).add(line_pairs(docs_of([(1, "a line of text")]), 8))
    try:
        LineRuns(spark, root, buckets=4)
    except ValueError as error:
        assert "3 buckets" in str(error)
    else:
        raise AssertionError("runs of three buckets were opened with four")
