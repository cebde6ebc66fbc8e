"""URL filter: longest-prefix rules, then a character language-model ratio.

Two variable-order Markov models, one of accepted and one of rejected URLs, are
smoothed from the empty context up to three characters (Witten-Bell: an order's
weight is its count against the number of different characters seen there). An
URL without a rule is judged by the difference of its two log-likelihoods per
character against a threshold calibrated on the URLs that the rules decide, each
scored by models that were counted without it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import chunks

ORDER = 3
SYMBOLS = 32  # letters, one digit class, four signs, one class for the rest
BINS = 4096
SPAN = 16.0  # log-likelihood differences per character lie well within


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an URL; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_replace(rest, r"(?s)[/?#].*$", "")
    path = F.substr(rest, F.length(host) + 1)
    path = F.regexp_replace(path, r"(?s)[?#].*$", "")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        named = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return named & F.startswith(path, F.lit(self.path))


def apply_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``ruled`` (the rule's verdict); the longest rule wins."""
    host, path = parts(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def _alphabet() -> np.ndarray:
    code = np.full(256, 31, np.uint8)
    code[97:123] = np.arange(26)
    code[48:58] = 26
    for i, sign in enumerate(b"./-_"):
        code[sign] = 27 + i
    return code


def _grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Gram numbers (context and character, five bits each) and their text numbers."""
    code = _alphabet()[texts.data].astype(np.int32)
    n = len(code)
    doc = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    place = np.arange(n) - texts.offsets[doc] if n else np.zeros(0, np.int64)
    gram = code.copy()
    for back in range(1, ORDER + 1):
        earlier = np.full(n, SYMBOLS - 1, np.int32)  # before the start stands the class of other signs
        earlier[back:] = code[: n - back] if n > back else code[:0]
        earlier[place < back] = SYMBOLS - 1
        gram |= earlier << (5 * back)
    return gram, doc


def _model(counts: np.ndarray) -> np.ndarray:
    """log P(character | context) for every gram, from counts of all grams."""
    p = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, SYMBOLS**order, SYMBOLS).sum(0)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        p = np.tile(p, (len(n) // len(p), 1))
        p = (n + kinds * p) / np.maximum(total + kinds, 1) + np.where(total > 0, 0, 1) * p
    return np.log(p).ravel()


SIDES = ("allow0", "allow1", "block0", "block1")  # verdict and half of the URLs


def _count_grams(batches):
    sums = {v: np.zeros(SYMBOLS ** (ORDER + 1), np.int64) for v in SIDES}
    for batch in batches:
        side = np.array(batch.column("side").to_pylist(), object)
        for first, texts in chunks(batch.column("place")):
            gram, doc = _grams(texts)
            mine = side[first : first + len(texts)][doc]
            for v in sums:
                sums[v] += np.bincount(gram[mine == v], minlength=len(sums[v]))
    for v, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["side", "gram", "n"]
        )


def _place(df: DataFrame) -> DataFrame:
    return df.withColumn("place", F.concat("host", "path"))


def _half():
    """0 or 1; equal URLs are in the same half."""
    return F.pmod(F.xxhash64("host", "path"), F.lit(2))


def count(ruled: DataFrame) -> dict[str, np.ndarray]:
    """Counts of every gram in all ruled URLs, by verdict and half; 32**4 entries each whatever the input."""
    known = _place(ruled.where("ruled IS NOT NULL")).select("place", F.concat("ruled", _half().cast("string")).alias("side"))
    rows = known.mapInArrow(_count_grams, "side string, gram long, n long")
    table = rows.groupBy("side", "gram").agg(F.sum("n").alias("n")).toArrow()
    sums = {}
    for v in SIDES:
        own = table.filter(pa.compute.equal(table["side"], v))
        sums[v] = np.zeros(SYMBOLS ** (ORDER + 1))
        sums[v][own["gram"].to_numpy()] = own["n"].to_numpy()
    return sums


def fit(allow: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio (accepted over rejected) of every gram; zeros if one side has none."""
    if not allow.any() or not block.any():
        return np.zeros(SYMBOLS ** (ORDER + 1), np.float32)
    return (_model(allow) - _model(block)).astype(np.float32)


def score(pages: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Adds ``score``: mean log-likelihood ratio per character of host and path; 0 for empty ones."""
    shared = pages.sparkSession.sparkContext.broadcast(ratios)
    columns = pages.columns

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, texts in chunks(batch.column("place")):
                gram, doc = _grams(texts)
                total = np.bincount(doc, shared.value[gram], minlength=len(texts))
                out[first : first + len(texts)] = total / np.maximum(np.diff(texts.offsets), 1)
            arrays = [batch.column(c) for c in columns] + [pa.array(out)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return _place(pages).mapInArrow(run, schema + ", score double")


def calibrate(scored: DataFrame) -> float:
    """Threshold with the best balanced accuracy on the ruled URLs, from a histogram of all of them."""
    bin_of = F.floor((F.col("score") + SPAN / 2) * (BINS / SPAN)).cast("int")
    rows = scored.where("ruled IS NOT NULL").groupBy(F.least(F.greatest(bin_of, F.lit(0)), F.lit(BINS - 1)).alias("bin"))
    hist = np.zeros((2, BINS))
    for r in rows.agg(
        F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")
    ).collect():
        hist[:, r["bin"]] = r["allow"], r["block"]
    if not hist.sum(1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(hist, 1)], 1) / hist.sum(1, keepdims=True)
    gain = below[1] - below[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[[0, -1]].mean() * (SPAN / BINS) - SPAN / 2)


def filter_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every page.

    A rule's verdict stands; other pages are allowed if their score reaches the
    threshold. Scores come from all ruled URLs; for the threshold each half of them
    is scored by the other half (0 where that has one verdict only). Null, empty or malformed URLs have empty host and path, no rule and
    score 0. Equal URLs get equal verdicts; repeated rows stay repeated; an empty
    table gives an empty table. Other columns are not read.
    """
    ruled = apply_rules(pages.select("page_id", F.col("url").cast("string").alias("url")), rules).drop("url")
    n = count(ruled)
    known = ruled.where("ruled IS NOT NULL")
    crosswise = [score(known.where(_half() == h), fit(n[f"allow{1 - h}"], n[f"block{1 - h}"])) for h in (0, 1)]
    threshold = calibrate(crosswise[0].unionByName(crosswise[1]))
    scored = score(ruled, fit(n["allow0"] + n["allow1"], n["block0"] + n["block1"]))
    method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
