import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from atomsift.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    rnd = random.Random(2)
    signs = "ab Zé\n\t  '1.,!sdtmÖß½²ªx  <|>_-\r\x1c中\x85\xa0"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += ["it's we'll  \n x", "<|endoftext|> a<|endoftext|>", "  lead", "trail  "]
    for text, coded in zip(texts, packing.Encoder(PATH)(texts), strict=True):
        assert np.frombuffer(coded, "<u4").tolist() == reference_ids(text) + [0]


def test_shard_is_whole_balanced_and_full():
    rnd = random.Random(5)
    for n in (0, 1, 2, 60, 700):
        lengths = [rnd.choice([1, 5, 300, 1023, 1024, 1025, 3000, rnd.randint(1, 900)]) for _ in range(n)]
        pieces = packing.pack_shard(lengths)
        seen, rooms = defaultdict(list), defaultdict(list)
        for d, s, k, q, o in pieces:
            seen[d].append((s, k))
            rooms[q].append((o, k))
        for d, length in enumerate(lengths):
            at = 0
            for s, k in sorted(seen[d]):
                assert s == at and k > 0
                at += k
            assert at == length
        for spans in rooms.values():
            at = 0
            for o, k in sorted(spans):
                assert o == at
                at += k
            assert at <= 1024
        assert len(rooms) == -(-sum(lengths) // 1024) or len(rooms) <= sum(lengths) // 1024 + 1
        assert sorted(rooms) == list(range(len(rooms)))


def test_lowest_cost_first():
    # the long piece makes its sequence dear, so the small ones go to the other
    pieces = packing.pack_shard([900, 600, 200, 100, 40])
    home = {d: q for d, _, _, q, _ in pieces}
    assert home[2] == home[3] == home[1] != home[0]


def test_table(spark, docs_of):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 30_000), (5, "x"), (5, "x"), (None, "lost")]
    got = packing.pack(docs_of(rows).repartition(2), PATH).collect()
    total = sum(r["length"] for r in got)
    assert total == sum(len(reference_ids(t or "")) + 1 for _, t in rows)
    assert {r["doc_id"]: r["doc_tokens"] for r in got}[2] == 1
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == 2 * (len(reference_ids("x")) + 1)
    fills = defaultdict(int)
    for r in got:
        fills[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert max(fills.values()) <= 1024
    assert packing.pack(docs_of([]), PATH).count() == 0


def test_layout_does_not_follow_batches(spark, docs_of):
    docs = docs_of([(i, f"w{i} " * 150) for i in range(40)]).repartition(1).sortWithinPartitions("doc_id")
    want = sorted(map(tuple, packing.pack(docs, PATH, 4).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, packing.pack(docs, PATH, 4).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stages_bound_the_bytes_of_batches(spark):
    import corpus_pipeline

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('plain word ', 400) AS text", "4400L AS n_chars").repartition(1)

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    def most(frame):
        return frame.mapInArrow(largest, "size long").agg({"size": "max"}).first()[0]

    kept = spark.conf.get(limit, None)
    try:
        for _, stage in (s for s in corpus_pipeline.STAGES if s[0] in ("personal data", "packing")):
            spark.conf.unset(limit)
            assert most(docs) > 12_000_000
            stage(spark, docs, "")
            assert most(docs) < 5_000_000
        spark.conf.set(limit, "1m")
        corpus_pipeline.redact(spark, docs, "")
        assert spark.conf.get(limit) == "1m"  # a limit of one's own stays
    finally:
        spark.conf.set(limit, kept) if kept is not None else spark.conf.unset(limit)
