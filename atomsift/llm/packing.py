"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A partition is packed as a stream of shards of about ``SHARD`` sequences. In a
shard whole sequences are cut from long documents first; what is left is taken
in descending length, and each piece goes to the sequence with the lowest
estimated cost (linear plus quadratic in the lengths of its pieces) among those
with room for it. If none has room for all of it, the cheapest one with any room
takes a part. A shard opens as few sequences as its tokens need, so less than one
sequence of padding is left in a shard, and no row ever leaves its task.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import CHUNK_BYTES

LENGTH = 1024
SHARD = 512
QUADRATIC = 1 / 1024  # cost of a token pair against that of a token
END_ID = 0
CACHED = 400_000

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACE = r" \t\n\x0b\f\r"
# Fixed value: how byte-level BPE vocabularies of this family cut text, for the characters outside _OTHER.
_CUT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_OTHER = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]")
_SPECIAL = "<|endoftext|>"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts. Parts between cuts are encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of a part between cuts, from the vocabulary's merges."""
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, closed by ``END_ID``."""
        cuts = [None if _SPECIAL in t or _OTHER.search(t) else _CUT.findall(t) for t in texts]
        new = set().union(*(c for c in cuts if c)) - self.known.keys()
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = set().union(*(c for c in cuts if c))
        for piece in new:
            self.known[piece] = self._piece(piece)
        get, end = self.known.__getitem__, array("I", [END_ID]).tobytes()
        return [
            (self._whole(t) if c is None else b"".join(map(get, c))) + end for t, c in zip(texts, cuts, strict=True)
        ]


def cost(length):
    return length + QUADRATIC * length * length


def pack_shard(lengths: list[int], size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of every piece; sequences number from 0."""
    pieces, rest, used = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // size
        pieces += [(d, i * size, size, used + i, 0) for i in range(whole)]
        used += whole
        if n % size:
            rest.append((n % size, d, whole * size))
    left = sum(r[0] for r in rest)
    open_ = -(-left // size)
    room, spent = np.full(open_, size), np.zeros(open_)
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            price = np.where(room >= n, spent, np.inf)
            at = int(price.argmin())
            if price[at] == np.inf:
                at = int(np.where(room > 0, spent, np.inf).argmin())
            part = min(n, int(room[at]))
            pieces.append((d, start, part, used + at, size - int(room[at])))
            room[at] -= part
            spent[at] += cost(part)
            n, start = n - part, start + part
    return pieces


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, size: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` tokens.

    One row per piece: ``doc_id``, ``start`` (its document's ids before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (ids of
    the document with the closing 0), ``sequence_id`` and ``offset`` in it. Every
    id lies in exactly one piece; sequences have no gaps.

    Null and empty texts consist of the closing 0. Repeated rows and equal
    ``doc_id`` are documents of their own. A very long text fills sequences of its
    own; an empty table gives an empty table; other columns are ignored. The
    result depends on how the rows are dealt to partitions, not on the attempt.
    """

    def run(batches):
        encode = Encoder(tokenizer)
        base = TaskContext.get().partitionId() << 36
        ids: list[bytes] = []
        names: list = []
        held = 0

        def flush():
            nonlocal base, held
            pieces = pack_shard([len(x) // 4 for x in ids], size)
            cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = list(zip(*pieces, strict=True)) if pieces else [()] * 5
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in columns[0]], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(cut, pa.binary()),
                    pa.array([len(ids[d]) // 4 for d in columns[0]], pa.int64()),
                    pa.array([base + q for q in columns[3]], pa.int64()),
                    pa.array(columns[4], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            base += 1 + max(columns[3], default=0)
            ids.clear()
            names.clear()
            held = 0
            return out

        def hold(texts):
            nonlocal held
            for coded in encode(texts):
                ids.append(coded)
                held += len(coded) // 4

        # chunks go on over the ends of batches, so that their size does not show in the result
        texts, taken = [], 0
        for batch in batches:
            doc_ids, column = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                texts.append(column[row].as_py() or "")
                names.append(doc_ids[row].as_py())
                taken += len(texts[-1])
                if taken < CHUNK_BYTES:
                    continue
                hold(texts)
                texts, taken = [], 0
                # all documents of the chunk belong to the shard
                if held >= SHARD * size:
                    yield flush()
        hold(texts)
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
