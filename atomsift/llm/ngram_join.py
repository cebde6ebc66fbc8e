"""N-gram Jaccard join with count-vector trees.

Tokens (word n-grams) are hashed into groups. Two uses of the groups:

* Routing. If two sets differ in at most T tokens and are split over more than T
  groups, some group has the same tokens in both. The content of a group is
  therefore a key that similar texts share, and one that takes several equal
  tokens, so a passage or line that many texts have in common rarely makes one.
  With D tokens that may differ, the D + 1 groups of a text that come first in an
  order by content do: the first group that both have in common is among them.
  Sets are banded by size, so that T fits; a set that may be similar to smaller
  ones of the band below is routed there, too. In each band texts are joined into
  clusters over equal keys (star edges from a range sort, so a key of any size is
  split over tasks); bands do not mix, which keeps clusters small.
* Search. Inside a cluster, group counts are points of a tree of bounding boxes.
  The sum of coordinate minima of a query and a box bounds the overlap with all
  texts in it; boxes and points below the needed overlap are cut off. What is left
  makes smaller clusters, and only their token sets are fetched and verified.
  Pairs already connected need no look.

Texts with equal sets are one text throughout. Clusters beyond ``BLOCK`` texts or
``BLOCK_TOKENS`` tokens are dealt in blocks, one task for each pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import join_groups
from .components import connected_components
from .scratch import Scratch
from .text import chunks, lists, mix

TOKEN_BITS = 52  # 12 bits number the text within a chunk
BLOCK, BLOCK_TOKENS = 1024, 1 << 19
FANOUT = 16
SALTS = (0x1F3D, 0x2E5B)
BROADCAST_ROWS = 1 << 19  # 48 bytes each at most
SELECTIVE_FROM = 86  # from this percentage on few groups hold less than two tokens


def token_sets(texts, words: int):
    """Distinct tokens of each text, ascending by text and token, with text numbers.

    A token is a run of ``words`` words; a text with fewer words has the whole run as its token.
    """
    h, doc = texts.word_hash(), texts.doc
    per_text = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
    size = np.minimum(per_text, words)
    starts = np.maximum(per_text - words + 1, np.minimum(per_text, 1))
    doc_of = np.repeat(np.arange(len(texts)), starts)
    at = np.arange(len(doc_of)) - np.repeat(np.cumsum(starts) - starts, starts) + first[doc_of]
    token = size[doc_of].astype(np.uint64)
    for j in range(words):
        has = j < size[doc_of]
        step = mix(token ^ (h[np.minimum(at + j, max(len(h) - 1, 0))] + np.uint64(j))) if len(h) else token
        token = np.where(has, step, token)
    key = np.sort((doc_of.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (token >> np.uint64(64 - TOKEN_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & np.uint64((1 << TOKEN_BITS) - 1), (key >> np.uint64(TOKEN_BITS)).astype(np.int64)


class Plan:
    """Group numbers for set sizes: bands of sizes with a common number of groups."""

    def __init__(self, percent: int):
        self.percent = percent
        selective = percent >= SELECTIVE_FROM
        # size ratio of a band, share of groups beyond the least number: more of them than empty ones are to be expected
        self.ratio, self.spare = (1.4, 1 / 32) if selective else (2.0, 1 / 8)
        # sizes below this are similar to equal sets only
        self.least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1) / self.least) / np.log(self.ratio) + 1e-9).astype(np.int64)

    def top(self, band: np.ndarray) -> np.ndarray:
        """No set of the band has more tokens."""
        return np.ceil(self.least * self.ratio ** (band + 1.0)).astype(np.int64) + 1

    def groups(self, band: np.ndarray, n: np.ndarray):
        """Number of groups for pairs whose smaller set is in the band, and how many a set of ``n`` may have for itself."""
        differ = self.top(band) * (100 - self.percent) // self.percent
        spare = 1 + np.floor(differ * self.spare).astype(np.int64)
        # the largest similar set; sets from bands above meet the smaller ones of the band only
        other = np.where(self.band(n) > band, np.minimum(self.top(band), n), 100 * n // self.percent)
        own = (100 - self.percent) * (n + other) // (100 + self.percent)
        return differ + 1 + spare, np.minimum(own, differ)

    def lowest(self, n: np.ndarray) -> np.ndarray:
        """The lowest band in which a set of this size may have a similar one."""
        smallest = np.maximum(-(-n * self.percent // 100) - 1, self.least)
        return np.maximum(np.minimum(self.band(smallest), self.band(n)), 0)


def _keys(token, doc, n_docs, sizes, plan: Plan):
    """Routing keys: text, band and key, for one group more than may differ.

    Groups of many tokens come first, equal ones by their key. Groups that are the same in two texts have the
    same place in this order, and at most those that differ come before the first of them. If that one may be
    an empty group, each two empty groups make a key as well.
    """
    own, lowest = plan.band(sizes), plan.lowest(sizes)
    out = []
    for lower in range(int((own - lowest).max(initial=0)) + 1):
        band = own - lower
        use = (sizes >= plan.least) & (band >= lowest)
        count, differ = plan.groups(np.maximum(band, 0), sizes)
        count = np.where(use, count, 0)
        base = np.concatenate([[0], np.cumsum(count)])
        mine = use[doc]
        t, d = token[mine], doc[mine]
        spread = mix(t + np.uint64(0x51ED2701))
        g = ((spread >> np.uint64(32)) * count[d].astype(np.uint64)) >> np.uint64(32)
        slot = base[d] + g.astype(np.int64)
        held = np.bincount(slot, minlength=base[-1])
        other = mix(t + np.uint64(0xA24BAED4))
        low = np.bincount(slot, (other & np.uint64(0xFFFFFFFF)).astype(float), base[-1]).astype(np.uint64)
        high = np.bincount(slot, (other >> np.uint64(32)).astype(float), base[-1]).astype(np.uint64)
        owner = np.repeat(np.arange(n_docs), count)
        number = np.arange(base[-1]) - base[owner]
        place = mix(band[owner].astype(np.uint64) * np.uint64(1 << 40) + number.astype(np.uint64))
        key = mix(place ^ mix(low + mix(high + held.astype(np.uint64))))
        order = np.lexsort((key, -held, owner))
        first = order[(number <= differ[owner]) & (held[order] > 0)]  # numbers also count the rows of the sorted texts
        owners, keys = [owner[first]], [key[first]]
        empty = np.bincount(owner[held == 0], minlength=n_docs)
        for text in np.flatnonzero(use & (empty >= count - differ)):
            at = slice(base[text], base[text + 1])
            few = key[at][held[at] == 0]
            i, j = np.triu_indices(len(few), 1)
            owners.append(np.full(len(i), text))
            keys.append(mix(few[i] * np.uint64(3) + few[j]))
        owner, key = np.concatenate(owners), np.concatenate(keys)
        order = np.argsort(owner, kind="stable")
        out.append((owner[order], band, key[order]))
    return out


def _count_vectors(token, doc, sizes) -> list[bytes]:
    """Group counts of each text, about eight tokens a group; any coarser grouping is a sum of these.

    A count takes a byte, or four if the text has larger ones.
    """
    width = _widths(sizes)
    base = np.concatenate([[0], np.cumsum(width)])
    slot = base[doc] + ((mix(token) >> np.uint64(40)).astype(np.int64) & (width[doc] - 1))
    counts = np.minimum(np.bincount(slot, minlength=base[-1]), _MOST).astype("<u4")
    parts = [counts[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]
    return [(c.astype("u1") if c.max() < 256 else c).tobytes() for c in parts]


_MOST = (1 << 32) - 1


def _widths(sizes) -> np.ndarray:
    return (2 ** np.clip(np.ceil(np.log2(np.maximum(sizes, 1) / 8)), 4, 12)).astype(np.int64)


def _fold(counts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Points of one width from count vectors of several: groups are taken modulo the least width."""
    rows = [np.frombuffer(c, f"<u{len(c) // w}") for c, w in zip(counts, _widths(sizes), strict=True)]
    width = min(map(len, rows))
    return np.stack([r.reshape(-1, width).sum(0, dtype=np.int64) for r in rows])


def screen_block(ids, side, sizes, counts, percent: int) -> list[tuple[int, int]]:
    """Edges that connect all texts of a block whose overlap may be large enough."""
    order = np.lexsort((ids, sizes))
    ids, side, sizes = ids[order], side[order], sizes[order]
    tree = BoxTree(_fold([counts[i] for i in order], sizes), sizes)
    across = len(np.unique(side)) > 1
    name = np.arange(len(ids))
    edges = []
    for q in range(len(ids)):
        found = tree.search(tree.points[q], int(sizes[q]), needed(percent))
        found = found[(found > q) & (name[found] != name[q])]
        if across:
            found = found[side[found] != side[q]]
        for p in found:
            if name[p] != name[q]:
                edges.append((int(ids[q]), int(ids[p])))
                name[name == name[p]] = name[q]
    return edges


def needed(percent: int):
    """The overlap that two sets of given sizes need to be similar."""
    return lambda a, b: -(-percent * (a + b) // (100 + percent))


def set_sums(token: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each text's set, from the sum of its tokens' hashes."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + np.uint64(salt)))])
    return mix(run[starts[1:]] - run[starts[:-1]]).view(np.int64)


def _fingerprints(words: int, plan: Plan):
    """Rows of each text: one with ``first`` for the text itself, and one more for each further band."""

    def run(batches):
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                n = len(texts)
                token, doc = token_sets(texts, words)
                sizes = np.bincount(doc, minlength=n)
                sums = [set_sums(token, sizes, salt) for salt in SALTS]
                vectors = _count_vectors(token, doc, sizes)
                for lower, (owner, band, key) in enumerate(_keys(token, doc, n, sizes, plan)):
                    counts = np.bincount(owner, minlength=n)
                    some = np.arange(n) if lower == 0 else np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(first + some)),
                            pa.array(sizes[some]),
                            *(pa.array(x[some]) for x in sums),
                            pa.array(np.full(len(some), lower == 0)),
                            pa.array(band[some].astype(np.int32)),
                            pa.array([vectors[i] for i in some], pa.binary()),
                            lists(key.view(np.int64), counts[some]),
                        ],
                        ["doc_id", "n", "sum_a", "sum_b", "first", "band", "counts", "keys"],
                    )

    return run


def _stars(batches):
    """Edges from each row to the first row of its key in the task; and the task's first and last row."""
    key_now, head_now, first, last = None, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        begins = np.concatenate([[key[0] != key_now], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        head = np.where(at >= 0, node[np.maximum(at, 0)], head_now if head_now is not None else 0)
        first = first or (int(key[0]), int(node[0]))
        key_now, head_now = key[-1], head[-1]
        last = int(key[-1]), int(node[-1])
        pair = np.unique(np.stack([node, head], 1)[node != head], axis=0)
        if len(pair):
            nothing = pa.nulls(len(pair), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1]), nothing], ["a", "b", "key"]
            )
    if first:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[1] for x in (first, last)]), pa.nulls(2, pa.int64()), pa.array([x[0] for x in (first, last)])],
            ["a", "b", "key"],
        )


def star_edges(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes of each key; ``keyed`` has ``key`` and ``node``.

    Rows are range-partitioned on both columns, so one key may span tasks. What
    ties its parts together are the first and last rows of the tasks (two rows a task).
    """
    ordered = keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    made = scratch.keep(ordered.mapInArrow(_stars, "a long, b long, key long"), "stars")
    ends = made.where("key IS NOT NULL").select("key", F.col("a").alias("node"))
    ties = ends.join(ends.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b")
    return made.where("key IS NULL").select("a", "b").union(ties).where("a <> b").distinct()


class BoxTree:
    """Points (group counts) under boxes of their coordinate maxima, level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points = points
        self.levels = []
        high, least = points, sizes
        while len(high) > FANOUT:
            cut = np.arange(0, len(high), FANOUT)
            high, least = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(least, cut)
            self.levels.append((high, least))
        self.sizes = sizes

    def search(self, point: np.ndarray, size: int, needed) -> np.ndarray:
        """Points whose bound on the overlap reaches ``needed(size, their size)``."""
        at = None
        for high, least in reversed(self.levels):
            at = np.arange(len(high)) if at is None else _children(at, len(high))
            at = at[np.minimum(high[at], point).sum(1, dtype=np.int64) >= needed(size, least[at])]
        at = np.arange(len(self.points)) if at is None else _children(at, len(self.points))
        return at[np.minimum(self.points[at], point).sum(1, dtype=np.int64) >= needed(size, self.sizes[at])]


def _children(at: np.ndarray, n: int) -> np.ndarray:
    below = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    return below[below < n]


def group_counts(token: np.ndarray, text: np.ndarray, n: int, groups: int) -> np.ndarray:
    group = (mix(token) >> np.uint64(40)).astype(np.int64) % groups
    counts = np.bincount(text * groups + group, minlength=n * groups).reshape(n, groups)
    return np.minimum(counts, 65535).astype(np.uint16) if counts.max(initial=0) < 65536 else counts


def link_block(ids, side, tokens, offsets, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked in a block: ``100 |A & B| >= percent |A | B|``.

    ``side`` tells two blocks apart: if both occur, only pairs across them are compared.
    """
    sizes = np.diff(offsets)
    order = np.lexsort((ids, sizes))
    ids, side, sizes = ids[order], side[order], sizes[order]
    parts = [tokens[offsets[o] : offsets[o + 1]] for o in order]
    n = len(ids)
    flat = np.concatenate(parts) if n else tokens
    _, dense = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    groups = int(2 ** np.clip(np.ceil(np.log2(max(sizes.mean(), 1) / 4)), 4, 9))
    tree_rows = np.arange(n)
    points = group_counts(flat, np.repeat(np.arange(n), sizes), n, groups)
    tree = BoxTree(points, sizes)
    across = len(np.unique(side)) > 1
    name, mark = tree_rows.copy(), np.zeros(int(dense.max(initial=0)) + 1, bool)
    edges = []
    for q in range(n):
        found = tree.search(points[q], int(sizes[q]), needed(percent))
        found = found[(found > q) & (name[found] != name[q])]
        if across:
            found = found[side[found] != side[q]]
        if not len(found):
            continue
        own = dense[starts[q] : starts[q + 1]]
        mark[own] = True
        widths = sizes[found]
        at = np.repeat(starts[found] - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())
        common = np.add.reduceat(mark[dense[at]], np.cumsum(widths) - widths, dtype=np.int64)
        mark[own] = False
        for p in found[100 * common >= percent * (sizes[q] + widths - common)]:
            if name[p] != name[q]:
                edges.append((int(ids[q]), int(ids[p])))
                name[name == name[p]] = name[q]
    return edges


def _cluster_tokens(words: int):
    """The token sets of rows whose text is the node's; other texts of the same id are left out."""

    def run(batches):
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                n = len(texts)
                token, doc = token_sets(texts, words)
                sizes = np.bincount(doc, minlength=n)
                wanted = [batch.column(c).slice(first, n) for c in ("cluster", "blocks", "node")]
                hit = np.ones(n, bool)
                for name, salt in zip(("sum_a", "sum_b"), SALTS):
                    hit &= set_sums(token, sizes, salt) == batch.column(name).slice(first, n).to_numpy()
                token = token[np.repeat(hit, sizes)]
                at = pa.array(np.flatnonzero(hit))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in wanted), lists(token.view(np.int64), sizes[hit])],
                    ["cluster", "blocks", "node", "tokens"],
                )

    return run


def _link(percent: int):
    def run(table: pa.Table) -> pa.Table:
        tokens = table["tokens"].combine_chunks()
        offsets = tokens.offsets.to_numpy().astype(np.int64)
        flat = tokens.values.to_numpy().view(np.uint64)
        edges = link_block(table["node"].to_numpy(), table["side"].to_numpy(), flat, offsets, percent)
        return _edge_table(edges)

    return run


def similar_components(docs: DataFrame, scratch: Scratch, words: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)`` for every row.

    A text's set holds its distinct runs of ``words`` words (A-Z lower-cased); two
    texts link if ``100 * |A & B| >= percent * |A | B|``. ``class_id`` is the
    smallest ``doc_id`` with the same set, ``component_id`` the smallest one
    reachable over links.

    Null, empty and blank texts have an empty set, link with nothing, and are
    their own class and component. A text with fewer words has one token. Texts
    of any length are taken whole. Rows with equal text are one class; an id with
    several texts connects them and has the links of each. Null ids link nothing and
    stay null. An empty table gives an empty table; other columns are ignored. The
    answer is exact up to collisions of 52-bit hashes of tokens and 64-bit hashes of sets.
    """
    plan, mark = Plan(percent), len(scratch.tables)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n long, sum_a long, sum_b long, first boolean, band int, counts binary, keys array<long>"
    prints = scratch.keep(rows.mapInArrow(_fingerprints(words, plan), schema), "prints")
    # a set is a node of its own, whatever ids hold it
    usable = prints.where("n > 0 AND doc_id IS NOT NULL").withColumn("node", F.xxhash64("n", "sum_a", "sum_b"))
    classes = usable.where("first").groupBy("node", "n", "sum_a", "sum_b").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")
    # one row per class keeps its keys; single texts, which are most, need no join for that
    groups = classes.where("copies > 1").select("node", "class_id")
    shown = prints.where("first").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("n", "sum_a", "sum_b")).alias("node"))
    member = shown.join(groups, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), "node"
    )
    member = scratch.keep(member, "members")
    copies = scratch.keep(member.where("doc_id <> class_id").select("doc_id", "node").distinct(), "copies")
    # a text stands in a band as a point of its own
    point = F.xxhash64("node", "band")
    single = usable.where(F.size("keys") > 0).join(_sized(copies), ["doc_id", "node"], "left_anti")
    keyed = single.select(F.explode("keys").alias("key"), point.alias("node"))
    clusters = connected_components(star_edges(keyed, scratch), scratch)
    places = single.select(point.alias("point"), "node", "n", "counts").join(clusters.withColumnRenamed("id", "point"), "point")
    places = places.select("node", "n", "counts", F.col("component").alias("cluster"))
    near = connected_components(_screened(places, scratch, percent), scratch)
    near = near.select(F.col("id").alias("node"), F.col("component").alias("cluster")).join(classes, "node")
    edges = _verified(rows, near, scratch, words, percent)
    # an id with several texts connects them
    several = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").drop("most")
    edges = edges.union(member.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"))
    linked = connected_components(edges, scratch).select(F.col("id").alias("node"), "component")
    smallest = linked.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = scratch.keep(linked.join(smallest, "component").select("node", "component_id"), "linked")
    scratch.since(mark, member, linked)
    joined = member.join(linked, "node", "left")
    return joined.select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def drop_similar(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that a smaller id is connected with, all columns kept.

    Rows with null ids stay; of rows with the same id and text one stays.
    """
    mark = len(scratch.tables)
    found = similar_components(docs, scratch, words, percent).select("doc_id", "component_id")
    found = scratch.keep(found.where("doc_id IS NOT NULL"), "found")
    dropped = scratch.keep(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    repeated = scratch.keep(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    scratch.since(mark, dropped, repeated)
    kept = docs.join(_sized(dropped), "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    few = _sized(repeated)
    once = kept.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(few, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def _sized(ids: DataFrame) -> DataFrame:
    """A table of ids, marked for broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _blocks(texts: DataFrame, weight, most: int) -> DataFrame:
    """Each cluster with the number of blocks that hold ``BLOCK`` texts or ``most`` of ``weight`` at the most, on average."""
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(weight) / most)).cast("int")
    return texts.groupBy("cluster").agg(parts.alias("blocks"))


def _pairs(texts: DataFrame, *columns: str) -> DataFrame:
    """Texts dealt to pairs of blocks ``(cluster, i, j)``; one block, and each with itself, is a pair of its own."""
    dealt = texts.withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side", *columns
    )


def _screened(places: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Edges that connect what the group counts leave possible in each cluster."""
    places = scratch.keep(places, "places")
    blocks = _blocks(places, F.length("counts"), 2 * BLOCK_TOKENS)
    pairs = _pairs(join_groups(places, blocks, ["cluster"]), "n", "counts")

    def run(table: pa.Table) -> pa.Table:
        ids, side, sizes = (table[c].to_numpy() for c in ("node", "side", "n"))
        return _edge_table(screen_block(ids, side, sizes, table["counts"].to_pylist(), percent))

    return pairs.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def _edge_table(edges) -> pa.Table:
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _verified(rows: DataFrame, near: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Edges between linked sets; ``near`` has ``node``, ``cluster``, the size and sums of the set and an id that holds it."""
    near = scratch.keep(near.select("node", "cluster", "n", "sum_a", "sum_b", F.col("class_id").alias("holder")), "near")
    blocks = _blocks(near, "n", BLOCK_TOKENS)
    members = scratch.keep(join_groups(near, blocks, ["cluster"]).drop("n"), "clusters")
    wanted = rows.join(_sized(members), rows["doc_id"] == members["holder"])
    sets = wanted.select("cluster", "blocks", "node", "sum_a", "sum_b", "text").mapInArrow(
        _cluster_tokens(words), "cluster long, blocks int, node long, tokens array<long>"
    )
    return _pairs(sets, "tokens").groupBy("cluster", "i", "j").applyInArrow(_link(percent), "a long, b long")
