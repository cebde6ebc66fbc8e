"""Every operator as a query over the benchmark tables, with its SQL twin."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, hash_key
from ..functions.vectors import squared_norm
from ..operators import analysis as A
from ..operators import agglomerate, auto, birch, cells, coverage, embedding, hdbscan, hierarchy, kmeans, lift, neighbors, reduction, sampling, soap
from ..operators import export as EX
from ..operators import provenance as P
from ..operators import splits as S
from ..operators import stats as ST
from ..operators.ranking import join_groups
from ..session import materialize
from . import oracles as O
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def spread(df: DataFrame, *keep: str) -> DataFrame:
    """keep, pc, v rounded: a vector column as comparable rows."""
    return rounded(ST.long_form(df, *keep), 6, "v")


# ---------------------------------------------------------------- files and frames

NUMBERED = "numbered AS (SELECT CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS file_id, c_name AS file_path FROM customer)"


def _files(spark, d):
    return P.number_files(T.table(spark, d, "customer").select(F.col("c_name").alias("file_path")))


@query("file_numbering", f"WITH {NUMBERED} SELECT * FROM numbered")
def file_numbering(spark, d):
    return _files(spark, d).select("file_id", "file_path")


@query("file_select_stride", f"WITH {NUMBERED} SELECT * FROM numbered WHERE file_id % 7 = 0")
def file_select_stride(spark, d):
    return P.select_files(_files(spark, d), "stride", file_stride=7).select("file_id", "file_path")


@query(
    "file_select_random",
    f"WITH {NUMBERED} SELECT * FROM numbered ORDER BY {O.hash_key(3, 'file_id')}, file_id LIMIT 100",
)
def file_select_random(spark, d):
    return P.select_files(_files(spark, d), "random", random_count=100, seed=3).select("file_id", "file_path")


FRAMES = (
    f"{O.FILES}, frames AS (SELECT CAST(file_id AS INTEGER) AS file_id, CAST(row_number() OVER "
    "(PARTITION BY file_id ORDER BY o_orderkey) - 1 AS INTEGER) AS source_struct_id, o_orderkey FROM files)"
)


@query(
    "frame_stride",
    f"WITH {FRAMES} SELECT file_id, source_struct_id, o_orderkey, source_struct_id // 3 AS struct_id "
    "FROM frames WHERE source_struct_id % 3 = 0",
)
def frame_stride(spark, d):
    return P.stride_frames(T.order_frames(spark, d), 3)


@query("unique_species", "SELECT DISTINCT l_returnflag AS symbol FROM lineitem")
def unique_species(spark, d):
    return P.unique_species(T.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "symbol"))


@query("species_override", "SELECT 'C' AS symbol, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 2")
def species_override(spark, d):
    atoms = T.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("status")
    )
    return P.override_species(atoms).groupBy("symbol", "status").agg(F.count("*").alias("n"))


@query(
    "species_filter",
    "SELECT l_orderkey AS struct_id, l_returnflag AS symbol, l_quantity AS f0 FROM lineitem WHERE l_returnflag IN ('A', 'R')",
)
def species_filter(spark, d):
    atoms = T.line_forces(spark, d)
    return atoms.filter(F.col("symbol").isin("A", "R")).select("struct_id", "symbol", F.col("force")[0].alias("f0"))


# ---------------------------------------------------------------- provenance


@query(
    "provenance_build",
    f"WITH {O.ATOMS} SELECT file_id, struct_id, atom_id, symbol, is_fixed, source_struct_id, "
    "row_number() OVER (ORDER BY file_id, struct_id, atom_id) - 1 AS row_id FROM atoms",
)
def provenance_build(spark, d):
    atoms = T.line_atoms(spark, d).drop("row_id")
    return P.number_atoms(atoms).select(
        "file_id", "struct_id", "atom_id", "symbol", "is_fixed", "source_struct_id", "row_id"
    )


@query(
    "filemap_lookup",
    f"WITH {O.FILES}, {O.FILEMAP} SELECT o_orderkey, CAST(file_id AS INTEGER) AS file_id, file_path "
    "FROM files LEFT JOIN fmap ON file_id = fid",
)
def filemap_lookup(spark, d):
    frames = T.frame_files(spark, d).select("o_orderkey", F.col("file_id").cast("int").alias("file_id"))
    return P.attach_paths(frames, T.filemap(spark, d))


@query(
    "force_projection", "SELECT l_orderkey AS struct_id, l_quantity AS fx, l_tax AS fz FROM lineitem"
)
def force_projection(spark, d):
    out = P.project_forces(T.line_forces(spark, d), (0, 2))
    return out.select("struct_id", F.col("force")[0].alias("fx"), F.col("force")[1].alias("fz"))


@query(
    "fixed_mask",
    f"WITH {O.ATOMS} SELECT file_id, atom_id IN (0, 2) AS is_fixed, count(*) AS n FROM atoms GROUP BY ALL",
)
def fixed_mask(spark, d):
    flagged = T.line_atoms(spark, d).withColumn(
        "is_fixed", P.fixed_flag(F.array(F.lit(0), F.lit(2)), F.col("atom_id"))
    )
    return flagged.groupBy("file_id", "is_fixed").agg(F.count("*").alias("n"))


@query(
    "force_gate",
    "WITH m AS (SELECT l_orderkey, bool_or(l_tax = 0.08) AS missing FROM lineitem GROUP BY 1) "
    "SELECT NOT bool_or(missing) AS complete, count(*) FILTER (missing) AS missing_frames, count(*) AS frames FROM m",
)
def force_gate(spark, d):
    atoms = T.line_forces(spark, d).withColumn("file_id", F.lit(0))
    return P.forces_complete(atoms.withColumn("force", F.when(F.col("force")[2] != 0.08, F.col("force"))))


@query(
    "descriptor_append",
    "SELECT l_orderkey AS struct_id, l_extendedprice AS x0, l_discount AS x1, l_quantity AS x2, l_tax AS x3, "
    "l_extendedprice AS soap0 FROM lineitem",
)
def descriptor_append(spark, d):
    atoms = T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("struct_id"),
        F.lit(0).alias("file_id"),
        F.array("l_extendedprice", "l_discount").alias("x"),
        F.array("l_quantity", "l_discount", "l_tax").alias("force"),
    )
    out, _ = P.append_forces(atoms, (0, 2))
    x = F.col("x")
    return out.select(
        "struct_id", x[0].alias("x0"), x[1].alias("x1"), x[2].alias("x2"), x[3].alias("x3"), F.slice(x, 1, 1)[0].alias("soap0")
    )


@query(
    "box_select",
    "SELECT l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem "
    "WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05",
)
def box_select(spark, d):
    matrix = T.table(spark, d, "lineitem").select(T.line_features())
    inside = P.select_box(matrix, {0: (10, 20), 2: (0.02, 0.05)})
    return inside.select(*[F.col("x")[i].alias(f"x{i}") for i in range(4)])


BOX = (
    f"{O.ATOMS}, {O.FILEMAP}, sel AS (SELECT row_id FROM lines WHERE l_quantity BETWEEN 10 AND 20 "
    "AND l_extendedprice BETWEEN 20000 AND 60000), org AS (SELECT row_id, file_id, struct_id, atom_id, symbol, "
    "is_fixed, file_path FROM atoms JOIN sel USING (row_id) LEFT JOIN fmap ON file_id = fid)"
)


def _box_origins(spark, d):
    inside = P.select_box(T.line_matrix(spark, d), {0: (10, 20), 1: (20000, 60000)})
    return P.origins(inside, T.line_atoms(spark, d), T.filemap(spark, d))


@query("box_origins", f"WITH {BOX} SELECT * FROM org")
def box_origins(spark, d):
    return _box_origins(spark, d)


@query(
    "group_summary_detail",
    f"WITH {BOX} SELECT file_path, struct_id, symbol, is_fixed, count(*) AS n_atoms FROM org "
    "WHERE file_path IS NOT NULL GROUP BY 1, 2, 3, 4",
)
def group_summary_detail(spark, d):
    return P.group_detail(_box_origins(spark, d))


@query(
    "group_summary_total",
    f"WITH {BOX} SELECT file_path, struct_id, count(*) AS n_atoms_total FROM org "
    "WHERE file_path IS NOT NULL GROUP BY 1, 2",
)
def group_summary_total(spark, d):
    return P.group_total(_box_origins(spark, d))


@query(
    "take_rows",
    "SELECT o_orderkey AS pos, o_custkey AS row_id, c_acctbal AS v FROM orders JOIN customer ON o_custkey = c_custkey",
)
def take_rows(spark, d):
    matrix = T.table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.array("c_acctbal").alias("x"))
    wanted = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("row_id"))
    return P.take_rows(matrix, wanted).select("pos", "row_id", F.col("x")[0].alias("v"))


@query(
    "matrix_health",
    "SELECT count(*) AS rows, false AS has_nan, true AS has_inf, 'infinity'::DOUBLE AS abs_max FROM lineitem",
)
def matrix_health(spark, d):
    odd = F.when(F.col("l_tax") == 0.08, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    return ST.health_report(T.table(spark, d, "lineitem").select(F.array("l_quantity", odd).alias("x")))


@query(
    "sanitize_clip",
    "SELECT l_orderkey, least(greatest(l_extendedprice, -50000.0::DOUBLE), 50000.0::DOUBLE) AS x0, l_tax AS x1 "
    "FROM lineitem WHERE l_tax <> 0.08",
)
def sanitize_clip(spark, d):
    odd = F.when(F.col("l_tax") == 0.08, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    rows = T.table(spark, d, "lineitem").select("l_orderkey", F.array("l_extendedprice", odd).alias("x"))
    return ST.sanitize(rows, bound=50000.0).select("l_orderkey", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


# ---------------------------------------------------------------- lifting and splits

HITS = (
    f"{O.ATOMS}, {O.FILEMAP}, sel AS (SELECT row_id FROM lines ORDER BY {O.hash_key(7, 'row_id')}, row_id LIMIT 3000), "
    "hits AS (SELECT file_id, struct_id, count(*) AS n_atoms_hit FROM atoms JOIN sel USING (row_id) GROUP BY 1, 2)"
)
HIT_COLUMNS = "SELECT file_id, struct_id, n_atoms_hit, file_path FROM {} LEFT JOIN fmap ON file_id = fid"


def _lift(spark, d, **choice):
    atoms = materialize(T.line_atoms(spark, d), "atoms")
    chosen = sampling.random_sample(atoms.select("row_id"), 3000, 7)
    return atoms, lift.atoms_to_structures(chosen, atoms, T.filemap(spark, d), **choice)


@query("lift_all", f"WITH {HITS} {HIT_COLUMNS.format('hits')}")
def lift_all(spark, d):
    return _lift(spark, d, choose="all")[1]


@query(
    "lift_top",
    f"WITH {HITS}, top AS (SELECT * FROM hits ORDER BY n_atoms_hit DESC, file_id, struct_id LIMIT 50) "
    f"{HIT_COLUMNS.format('top')}",
)
def lift_top(spark, d):
    return _lift(spark, d, choose="top", top_k=50)[1]


@query(
    "lift_threshold",
    f"WITH {HITS}, thr AS (SELECT * FROM hits WHERE n_atoms_hit >= 2) {HIT_COLUMNS.format('thr')}",
)
def lift_threshold(spark, d):
    return _lift(spark, d, choose="threshold", min_atoms_per_struct=2)[1]


@query(
    "lift_atoms_from_structs",
    f"WITH {HITS}, thr AS (SELECT * FROM hits WHERE n_atoms_hit >= 2) "
    "SELECT row_id FROM atoms SEMI JOIN thr USING (file_id, struct_id)",
)
def lift_atoms_from_structs(spark, d):
    atoms, chosen = _lift(spark, d, choose="threshold", min_atoms_per_struct=2)
    return lift.structure_atoms(atoms, chosen)


VAL = (
    "n AS (SELECT count(*) AS c FROM orders), val AS (SELECT o_orderkey AS frame_id, o_totalprice AS energy, "
    f"row_number() OVER (ORDER BY {O.hash_key(42, 'o_orderkey')}, o_orderkey) AS rn FROM orders)"
)
VAL_SIZE = "greatest(1, CAST(round_even(20 * c / 100.0, 0) AS BIGINT))"


def _val(spark, d):
    frames = T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("frame_id"), F.col("o_totalprice").alias("energy")
    )
    return S.validation_split(frames, 20, 42)


@query("val_split", f"WITH {VAL} SELECT frame_id, energy FROM val, n WHERE rn <= {VAL_SIZE}")
def val_split(spark, d):
    return _val(spark, d)[0]


@query("train_complement", f"WITH {VAL} SELECT frame_id, energy FROM val, n WHERE rn > {VAL_SIZE}")
def train_complement(spark, d):
    return _val(spark, d)[1]


UNIVERSE = (
    f"{O.FILES}, {O.FILEMAP}, uni AS (SELECT DISTINCT CAST(file_id AS INTEGER) AS file_id, "
    "CAST(o_orderkey AS INTEGER) AS struct_id, file_path "
    "FROM files JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN fmap ON file_id = fid)"
)
USED = (
    "used AS (SELECT DISTINCT file_path, CAST(o_orderkey AS INTEGER) AS struct_id FROM files LEFT JOIN fmap "
    "ON file_id = fid WHERE o_orderstatus = 'F' OR o_totalprice > 300000)"
)


def _frame_rows(spark, d):
    """Provenance reduced to what the split needs, one row per atom."""
    lines = T.table(spark, d, "lineitem").select("l_orderkey")
    files = T.frame_files(spark, d).select("o_orderkey", "file_id")
    return lines.join(files, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("file_id").cast("int").alias("file_id"), F.col("o_orderkey").cast("int").alias("struct_id")
    )


def _manifests(spark, d):
    frames = P.attach_paths(T.frame_files(spark, d), T.filemap(spark, d))
    frames = frames.withColumn("struct_id", F.col("o_orderkey").cast("int"))
    return [frames.filter("o_orderstatus = 'F'"), frames.filter("o_totalprice > 300000")]


@query("test_universe", f"WITH {UNIVERSE} SELECT * FROM uni")
def test_universe(spark, d):
    return S.frame_universe(_frame_rows(spark, d), T.filemap(spark, d))


@query("used_frames", f"WITH {O.FILES}, {O.FILEMAP}, {USED} SELECT * FROM used")
def used_frames(spark, d):
    return S.used_frames(*_manifests(spark, d))


REST = (
    "rest AS (SELECT u.* FROM uni u WHERE NOT EXISTS (SELECT 1 FROM used x WHERE x.file_path IS NOT DISTINCT FROM "
    "u.file_path AND x.struct_id IS NOT DISTINCT FROM u.struct_id))"
)


@query("unused_frames", f"WITH {UNIVERSE}, {USED}, {REST} SELECT * FROM rest")
def unused_frames(spark, d):
    universe = S.frame_universe(_frame_rows(spark, d), T.filemap(spark, d))
    return S.unused_frames(universe, S.used_frames(*_manifests(spark, d)))


TEST_ID = "CAST(file_id AS VARCHAR) || ':' || CAST(struct_id AS VARCHAR)"


@query(
    "test_set",
    f"WITH {UNIVERSE}, {USED}, {REST}, pick AS (SELECT * FROM rest ORDER BY {O.hash_key(12345, TEST_ID)} LIMIT 2000) "
    "SELECT file_id, struct_id, file_path, CAST(0 AS BIGINT) AS n_atoms_hit FROM pick WHERE file_path IS NOT NULL",
)
def test_set(spark, d):
    return S.test_set(_frame_rows(spark, d), T.filemap(spark, d), _manifests(spark, d))


# ---------------------------------------------------------------- manifests

SPECIES = (
    "seqs AS (SELECT file_id, struct_id, count(*) AS n_atoms, string_agg(symbol, ' ' ORDER BY atom_id) AS "
    "species_sequence, count(*) FILTER (symbol = 'A') AS na, count(*) FILTER (symbol = 'N') AS nn, "
    "count(*) FILTER (symbol = 'R') AS nr FROM atoms GROUP BY 1, 2)"
)


def _part(symbol: str, column: str) -> str:
    return f"CASE {column} WHEN 0 THEN '' WHEN 1 THEN '{symbol}' ELSE '{symbol}' || {column} END"


def _sequences(spark, d):
    atoms = T.line_atoms(spark, d)
    ordered = F.array_sort(F.collect_list(F.struct("atom_id", "symbol")))
    grouped = atoms.groupBy("file_id", "struct_id").agg(ordered.alias("atoms"))
    described = EX.describe(grouped, F.col("atoms.symbol"))
    return described.select("file_id", "struct_id", "n_atoms", "formula", "species_sequence")


@query(
    "export_manifest",
    f"WITH {O.ATOMS}, {SPECIES} SELECT file_id, struct_id, n_atoms, species_sequence, "
    f"{_part('A', 'na')} || {_part('N', 'nn')} || {_part('R', 'nr')} AS formula FROM seqs",
)
def export_manifest(spark, d):
    return _sequences(spark, d)


@query(
    "xdatcar_check",
    f"WITH {O.ATOMS}, {SPECIES} SELECT file_id, count(DISTINCT species_sequence) = 1 AS single FROM seqs GROUP BY 1",
)
def xdatcar_check(spark, d):
    return EX.one_sequence_per_file(_sequences(spark, d))


@query(
    "load_mode",
    f"WITH {HITS} SELECT CASE WHEN max(n) > 1 THEN 'grouped' ELSE 'single' END AS mode FROM "
    "(SELECT file_id, count(DISTINCT struct_id) AS n FROM hits GROUP BY 1)",
)
def load_mode(spark, d):
    chosen = _lift(spark, d, choose="all")[1]
    return EX.load_mode(chosen)


# ---------------------------------------------------------------- statistics

EMB_STATS = (
    f"{O.EMB}, lf AS MATERIALIZED ({O.long_form('emb')}), "
    "st AS (SELECT pc, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n FROM lf GROUP BY pc)"
)


@query(
    "component_stats",
    f"WITH {EMB_STATS} SELECT pc, n, round(lo, 6) AS vmin, round(hi, 6) AS vmax, round(mean, 6) AS mean, "
    "round(sd, 6) AS std FROM st",
)
def component_stats(spark, d):
    return rounded(ST.component_stats(T.embedding_matrix(spark, d)), 6, "vmin", "vmax", "mean", "std")


@query(
    "standardize",
    f"WITH {EMB_STATS} SELECT row_id, pc, round((v - mean) / (CASE WHEN sd = 0 THEN 1 ELSE sd END), 6) AS v "
    "FROM lf JOIN st USING (pc)",
)
def standardize(spark, d):
    return spread(ST.standardize(T.embedding_matrix(spark, d)), "row_id")


@query("whiten", f"WITH {EMB_STATS} SELECT row_id, pc, round((v - mean) / (sd + 1e-12), 6) AS v FROM lf JOIN st USING (pc)")
def whiten(spark, d):
    return spread(ST.whiten(T.embedding_matrix(spark, d)), "row_id")


@query(
    "total_sum_of_squares",
    f"WITH {EMB_STATS} SELECT round(sum(sd * sd * n), 6) AS tss FROM st",
)
def total_sum_of_squares(spark, d):
    s = ST.component_stats(T.embedding_matrix(spark, d))
    return s.agg(F.round(F.sum(F.col("std") * F.col("std") * F.col("n")), 6).alias("tss"))


@query("weight_by_variance", f"WITH {O.EMB}, lf AS ({O.long_form('emb')}) "
       "SELECT row_id, pc, round(v * sqrt(1.0::DOUBLE / (pc + 1) + 1e-12), 6) AS v FROM lf")
def weight_by_variance(spark, d):
    weighted = birch.weight_by_variance(T.embedding_matrix(spark, d), [1.0 / (j + 1) for j in range(64)])
    return spread(weighted, "row_id")


@query(
    "covariance_matrix",
    f"WITH {EMB_STATS}, c AS (SELECT row_id, pc, v - mean AS v, n FROM lf JOIN st USING (pc)) "
    "SELECT a.pc AS i, b.pc AS j, round(sum(a.v * b.v) / (max(a.n) - 1), 8) AS cov FROM c a JOIN c b USING (row_id) GROUP BY 1, 2",
)
def covariance_matrix(spark, d):
    return rounded(reduction.covariance(T.embedding_matrix(spark, d)), 8, "cov")


@query("pca_explained_variance")
def pca_explained_variance(spark, d):
    model = reduction.fit_pca(ST.standardize(T.embedding_matrix(spark, d)), 0.95)
    return rounded(model.as_dataframe(spark), 6, "explained_variance", "explained_variance_ratio")


# All eigenvalues, checked by the traces of the first four powers of the matrix they belong to.
POWER_SUMS = f"""WITH {EMB_STATS}, z AS (SELECT row_id, pc, (v - mean) / (CASE WHEN sd = 0 THEN 1 ELSE sd END) AS v, n FROM lf JOIN st USING (pc)),
c AS MATERIALIZED (SELECT a.pc AS i, b.pc AS j, sum(a.v * b.v) / (max(a.n) - 1) AS v FROM z a JOIN z b USING (row_id) GROUP BY 1, 2),
c2 AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
SELECT 1 AS p, round(sum(v), 5) AS total FROM c WHERE i = j UNION ALL SELECT 2, round(sum(v * v), 5) FROM c
UNION ALL SELECT 3, round(sum(c2.v * c.v), 5) FROM c2 JOIN c USING (i, j) UNION ALL SELECT 4, round(sum(v * v), 5) FROM c2"""


def _all_components(spark, d):
    matrix = ST.standardize(T.embedding_matrix(spark, d))
    return matrix, reduction.fit_pca(matrix, ST.width(matrix))


@query("pca_power_sums", POWER_SUMS)
def pca_power_sums(spark, d):
    values = _all_components(spark, d)[1].as_dataframe(spark)
    powers = values.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("p"), "explained_variance")
    sums = powers.groupBy("p").agg(F.sum(F.pow("explained_variance", "p")).alias("total"))
    return rounded(sums, 5, "total")


@query(
    "pca_score_norms",
    f"WITH {EMB_STATS} SELECT row_id, round(sum(power((v - mean) / (CASE WHEN sd = 0 THEN 1 ELSE sd END), 2)), 6) AS norm2 "
    "FROM lf JOIN st USING (pc) GROUP BY 1",
)
def pca_score_norms(spark, d):
    matrix, model = _all_components(spark, d)
    norms = model.transform(matrix).select("row_id", squared_norm("x").alias("norm2"))
    return rounded(norms, 6, "norm2")


@query("umap_embedding")
def umap_embedding(spark, d):
    out = embedding.umap_embedding(ST.standardize(T.embedding_matrix(spark, d)), 4)
    return spread(out, "row_id")


@query("tsne_embedding")
def tsne_embedding(spark, d):
    out = embedding.tsne_embedding(ST.standardize(T.embedding_matrix(spark, d)), 2)
    return spread(out, "row_id")


@query("pca_scores")
def pca_scores(spark, d):
    matrix = ST.standardize(T.embedding_matrix(spark, d))
    return spread(reduction.fit_pca(matrix, 0.95).transform(matrix), "row_id")


SUMMARY = (
    "count(*) AS n, min(v) AS vmin, max(v) AS vmax, round(avg(v), 4) AS vmean, round(stddev_pop(v), 4) AS vstd, "
    "round(quantile_cont(v, 0.05), 4) AS q05, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.95), 4) AS q95"
)


def _summary(df, value, *by):
    return rounded(A.summary_stats(df, value, by), 4, "vmean", "vstd", "q05", "q50", "q95")


@query("summary_stats_energy", f"SELECT {SUMMARY} FROM (SELECT o_totalprice AS v FROM orders)")
def summary_stats_energy(spark, d):
    return _summary(T.table(spark, d, "orders"), "o_totalprice")


NORM = "sqrt(0.0::DOUBLE + l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)"


@query(
    "force_stats_by_species",
    f"SELECT symbol, {SUMMARY.replace('min(v)', 'round(min(v), 4)').replace('max(v)', 'round(max(v), 4)')} "
    f"FROM (SELECT l_returnflag AS symbol, {NORM} AS v FROM lineitem) GROUP BY 1",
)
def force_stats_by_species(spark, d):
    return rounded(_summary(A.force_norms(T.line_forces(spark, d)), "norm", "symbol"), 4, "vmin", "vmax")


TENTH = (1 << HASH_BITS) // 10


def _sampled_orders(spark, d):
    return T.table(spark, d, "orders").withColumn("sampled", hash_key(5, "o_orderkey") < TENTH)


SAMPLED = f"sampled AS (SELECT *, {O.hash_key(5, 'o_orderkey')} < {TENTH} AS sampled FROM orders)"


@query(
    "range_coverage",
    f"WITH {SAMPLED}, r AS (SELECT o_orderstatus AS symbol, min(o_totalprice) AS fmin, max(o_totalprice) AS fmax, "
    "min(o_totalprice) FILTER (sampled) AS smin, max(o_totalprice) FILTER (sampled) AS smax FROM sampled GROUP BY 1) "
    "SELECT symbol, fmin, fmax, smin, smax, round(CASE WHEN smin IS NOT NULL AND fmax > fmin THEN "
    "greatest(0.0, least(smax, fmax) - greatest(smin, fmin)) / (fmax - fmin) END, 8) AS coverage FROM r",
)
def range_coverage(spark, d):
    data = _sampled_orders(spark, d).withColumnRenamed("o_orderstatus", "symbol")
    return rounded(A.range_coverage(data, "o_totalprice", "sampled", ["symbol"]), 8, "coverage")


@query(
    "size_fraction",
    f"WITH {SAMPLED} SELECT count(*) AS n_full, count(*) FILTER (sampled) AS n_sampled, "
    "round(100.0 * count(*) FILTER (sampled) / count(*), 6)::DOUBLE AS pct FROM sampled",
)
def size_fraction(spark, d):
    return rounded(A.size_fraction(_sampled_orders(spark, d), "sampled"), 6, "pct")


@query(
    "rms_force_per_frame",
    "SELECT l_orderkey AS struct_id, round(sqrt(avg(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) "
    "FILTER (l_returnflag IN ('A', 'N'))), 6) AS rms FROM lineitem GROUP BY 1",
)
def rms_force_per_frame(spark, d):
    return rounded(A.rms_force_per_frame(T.line_forces(spark, d), ["struct_id"], ["A", "N"]), 6, "rms")


def histogram_sql(source: str, by: str, width: float) -> str:
    """Shared density histogram over source(by, v, s)."""
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    edge0 = O.edge("bin", "lo", "hi", "nb")
    edge1 = O.edge("bin + 1", "lo", "hi", "nb")
    return f"""src AS ({source}), span AS (SELECT {keys}min(v) AS lo, max(v) AS hi, count(*) AS total,
  count(*) FILTER (s) AS total_s, greatest(1, CAST(ceil((max(v) - min(v)) / {width}::DOUBLE) AS INTEGER)) AS nb FROM src {group}),
placed AS (SELECT {keys}CAST({O.bin_closed('v', 'lo', 'hi', 'nb')} AS INTEGER) AS bin, s, lo, hi, nb, total, total_s FROM src JOIN span {on})
SELECT {keys}bin, round(0.5 * ({edge1} + {edge0}), 6) AS centre, count(*) AS n_full, count(*) FILTER (s) AS n_sampled,
  round(count(*) / (total * ((hi - lo) / nb)), 10) AS full_density,
  round(CASE WHEN total_s > 0 THEN count(*) FILTER (s) / (total_s * ((hi - lo) / nb)) END, 10) AS sampled_density
FROM placed GROUP BY {keys}bin, lo, hi, nb, total, total_s"""


def _histogram(df):
    return rounded(rounded(df, 6, "centre"), 10, "full_density", "sampled_density")


@query(
    "hist_energy",
    f"WITH {SAMPLED}, " + histogram_sql("SELECT o_totalprice AS v, sampled AS s FROM sampled", "", 997.0),
)
def hist_energy(spark, d):
    return _histogram(A.density_histogram(_sampled_orders(spark, d), "o_totalprice", "sampled", 997.0))


@query(
    "hist_force_by_species",
    f"WITH {SAMPLED}, "
    + histogram_sql(
        f"SELECT l_returnflag AS symbol, {NORM} AS v, sampled AS s FROM lineitem JOIN sampled ON l_orderkey = o_orderkey",
        "symbol",
        0.37,
    ),
)
def hist_force_by_species(spark, d):
    marks = _sampled_orders(spark, d).select("o_orderkey", "sampled")
    atoms = T.line_forces(spark, d).join(marks, F.col("struct_id") == F.col("o_orderkey"))
    norms = atoms.select("symbol", "sampled", A.norm("force").alias("norm"))
    return _histogram(A.density_histogram(norms, "norm", "sampled", 0.37, ["symbol"]))


@query(
    "hist2d",
    "WITH b AS (SELECT min(l_quantity) AS u0, max(l_quantity) AS u1, min(l_extendedprice) AS v0, max(l_extendedprice) AS v1 "
    f"FROM lineitem) SELECT CAST({O.bin_closed('l_quantity', 'u0', 'u1', '37')} AS INTEGER) AS bu, "
    f"CAST({O.bin_closed('l_extendedprice', 'v0', 'v1', '53')} AS INTEGER) AS bv, count(*) AS count FROM lineitem, b GROUP BY 1, 2",
)
def hist2d(spark, d):
    return A.histogram_2d(T.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", (37, 53))


@query(
    "js_divergence",
    f"""WITH {SAMPLED}, b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS na,
  count(*) FILTER (sampled) AS nb, (max(o_totalprice) - min(o_totalprice)) / 100 AS step FROM sampled),
c AS (SELECT {O.bin_closed('o_totalprice', 'lo', 'hi', '100')} AS bin,
  count(*) / (max(na) * max(step)) / (1.0 / max(step) + 1e-12) AS pa,
  count(*) FILTER (sampled) / (max(nb) * max(step)) / (1.0 / max(step) + 1e-12) AS pb FROM sampled, b GROUP BY 1),
m AS (SELECT pa, pb, 0.5 * (pa + pb) AS pm FROM c)
SELECT round(-sum(CASE WHEN pm > 0 THEN pm * log2(pm) ELSE 0 END) + 0.5 * (sum(CASE WHEN pa > 0 THEN pa * log2(pa) ELSE 0 END)
  + sum(CASE WHEN pb > 0 THEN pb * log2(pb) ELSE 0 END)), 9) AS jsd FROM m""",
)
def js_divergence(spark, d):
    full = _sampled_orders(spark, d)
    return rounded(
        A.js_divergence(full, full.filter("sampled"), "o_totalprice", "o_totalprice"), 9, "jsd"
    )


@query(
    "wasserstein_1d",
    f"""WITH {SAMPLED},
xa AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS rank FROM sampled),
xb AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS rank FROM sampled WHERE sampled),
n AS (SELECT (SELECT count(*) FROM xa) AS na, (SELECT count(*) FROM xb) AS m),
pos AS (SELECT rank AS i, v AS qb, (rank / (m - 1)::DOUBLE) * (na - 1) AS p FROM xb, n),
q AS (SELECT i, qb, l.v + (coalesce(h.v, l.v) - l.v) * (p - floor(p)) AS qa FROM pos
  JOIN xa l ON l.rank = CAST(floor(p) AS BIGINT) LEFT JOIN xa h ON h.rank = CAST(floor(p) AS BIGINT) + 1)
SELECT round(avg(abs(qa - qb)), 4) AS distance FROM q""",
)
def wasserstein_1d(spark, d):
    full = _sampled_orders(spark, d)
    return rounded(
        A.wasserstein_1d(full, full.filter("sampled"), "o_totalprice", "o_totalprice"), 4, "distance"
    )


@query(
    "pair_rdf",
    f"""WITH {O.LINES}, p AS (SELECT l_orderkey AS f, row_id, l_returnflag AS s, l_quantity AS x,
  round(l_discount * 100) AS y, round(l_tax * 100) AS z FROM lines),
o AS (SELECT a.i::DOUBLE AS i, b.i::DOUBLE AS j, c.i::DOUBLE AS k FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)),
d AS (SELECT a.row_id AS ra, b.row_id AS rb, sqrt(min((b.x + 52 * i - a.x) * (b.x + 52 * i - a.x)
  + (b.y + 12 * j - a.y) * (b.y + 12 * j - a.y) + (b.z + 10 * k - a.z) * (b.z + 10 * k - a.z))) AS d
  FROM p a JOIN p b ON a.f = b.f AND a.s = 'A' AND b.s = 'R', o GROUP BY 1, 2),
h AS (SELECT CAST(least(floor(d / 0.2::DOUBLE), 39) AS INTEGER) AS bin, count(*) AS c FROM d WHERE d < 8 GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round((r.bin + 0.5::DOUBLE) * 0.2::DOUBLE, 6) AS centre, coalesce(c, 0) AS count,
  round(coalesce(c, 0) / ((SELECT sum(c) FROM h)::DOUBLE + 1e-12), 9) AS weight
FROM range(40) r(bin) LEFT JOIN h ON h.bin = r.bin""",
)
def pair_rdf(spark, d):
    out = neighbors.pair_rdf(T.lattice_atoms(spark, d), ["struct_id"], ("A", "R"), 8.0, 40)
    return rounded(rounded(out, 6, "centre"), 9, "weight")


SOAP = soap.SoapBasis(r_cut=3.0, n_max=2, l_max=2, sigma=0.5)


def soap_sql(basis: soap.SoapBasis) -> str:
    """Power spectrum written out for l <= 2, with the radial numbers as constants."""
    eta, pi = 0.5 / basis.sigma**2, math.pi
    y = [
        [f"{math.sqrt(1 / (4 * pi))!r}::DOUBLE"],
        [f"{math.sqrt(3 / (4 * pi))!r}::DOUBLE * r{c}" for c in "yzx"],
        [f"{math.sqrt(15 / (4 * pi))!r}::DOUBLE * rx * ry", f"{math.sqrt(15 / (4 * pi))!r}::DOUBLE * ry * rz",
         f"{math.sqrt(5 / (16 * pi))!r}::DOUBLE * (3 * rz * rz - d2)", f"{math.sqrt(15 / (4 * pi))!r}::DOUBLE * rx * rz",
         f"{math.sqrt(15 / (16 * pi))!r}::DOUBLE * (rx * rx - ry * ry)"],
    ]
    sums, out = [], []
    for l in range(3):
        alpha, mix = basis.exponents(l), basis.mixing(l)
        for n in range(basis.n_max):
            radial = " + ".join(
                f"{float(mix[n, q] * (pi / (a + eta)) ** 1.5 * (eta / (a + eta)) ** l)!r}::DOUBLE * exp({float(-a * eta / (a + eta))!r}::DOUBLE * d2)"
                for q, a in enumerate(alpha)
            )
            sums += [f"sum(({radial}) * {h}) AS c{l}{n}{m}" for m, h in enumerate(y[l])]
        for n in range(basis.n_max):
            for n2 in range(n, basis.n_max):
                dot = " + ".join(f"c{l}{n}{m} * c{l}{n2}{m}" for m in range(2 * l + 1))
                out.append(f"{math.pi * math.sqrt(8 / (2 * l + 1))!r}::DOUBLE * ({dot})")
    return f"""WITH {O.LINES}, p AS (SELECT l_orderkey AS f, row_id, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z FROM lines),
o AS (SELECT a.i::DOUBLE AS i, b.i::DOUBLE AS j, c.i::DOUBLE AS k FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)),
d AS (SELECT a.f, a.row_id, b.x + 52 * i - a.x AS rx, b.y + 12 * j - a.y AS ry, b.z + 10 * k - a.z AS rz FROM p a JOIN p b ON a.f = b.f, o),
e AS (SELECT *, rx * rx + ry * ry + rz * rz AS d2 FROM d),
c AS (SELECT f, row_id, {", ".join(sums)} FROM e WHERE d2 < {basis.reach**2!r} GROUP BY 1, 2),
s AS (SELECT f, row_id, [{", ".join(out)}] AS x FROM c)
SELECT f AS struct_id, row_id AS atom_id, CAST(u.j - 1 AS INTEGER) AS pc, round(x[u.j], 6) AS v FROM s, unnest(range(1, {len(out) + 1})) AS u(j)"""


@query("soap_descriptor", soap_sql(SOAP))
def soap_descriptor(spark, d):
    return spread(soap.soap_descriptors(T.lattice_atoms(spark, d), ["struct_id"], basis=SOAP), "struct_id", "atom_id")


# ---------------------------------------------------------------- coverage

LINE_MATRIX = f"{O.LINES}, mat AS (SELECT row_id, [l_quantity, l_extendedprice, l_discount, l_tax] AS x FROM lines)"
RANDOM_600 = f"sel AS (SELECT row_id FROM mat ORDER BY {O.hash_key(11, 'row_id')}, row_id LIMIT 600)"
REPORT = "SELECT pc, nb, n_support, n_covered, round(coverage, 9) AS coverage FROM cov"


def _coverage(spark, d, **kw):
    matrix = T.line_matrix(spark, d)
    matrix = materialize(matrix, "matrix")
    report = coverage.coverage_auto(matrix, sampling.random_sample(matrix, 600, 11), **kw)
    return rounded(report, 9, "coverage")


@query(
    "coverage_auto_width",
    f"WITH {LINE_MATRIX}, {RANDOM_600}, {O.coverage('mat', 'sel', 0.73, 20, 10000)} {REPORT}",
)
def coverage_auto_width(spark, d):
    return _coverage(spark, d, mode="width", target_width=0.73, min_bins=20, max_bins=10_000)


@query("coverage_auto_fd", f"WITH {LINE_MATRIX}, {RANDOM_600}, {O.coverage('mat', 'sel', 0, 10, 200, 'fd')} {REPORT}")
def coverage_auto_fd(spark, d):
    return _coverage(spark, d, mode="fd")


@query(
    "coverage_auto_scott",
    f"WITH {LINE_MATRIX}, {RANDOM_600}, {O.coverage('mat', 'sel', 0, 10, 200, 'scott')} {REPORT}",
)
def coverage_auto_scott(spark, d):
    return _coverage(spark, d, mode="scott")


@query(
    "coverage_fixed_bins",
    f"WITH {LINE_MATRIX}, {RANDOM_600}, lf AS ({O.long_form('mat')}), g AS (SELECT pc, min(v) AS lo, max(v) AS hi FROM lf GROUP BY 1), "
    f"o AS (SELECT DISTINCT pc, {O.bin_index('v', 'lo', 'hi', '50000')} AS b FROM lf JOIN g USING (pc) SEMI JOIN sel USING (row_id)) "
    "SELECT pc, 50000 AS nb, count(*) FILTER (b < 50000) AS n_covered, "
    "round(count(*) FILTER (b < 50000) / 50000.0::DOUBLE, 9) AS coverage FROM o GROUP BY pc",
)
def coverage_fixed_bins(spark, d):
    matrix = materialize(T.line_matrix(spark, d), "matrix")
    return rounded(coverage.coverage_fixed(matrix, sampling.random_sample(matrix, 600, 11)), 9, "coverage")


@query(
    "coverage_mean",
    f"WITH {LINE_MATRIX}, {RANDOM_600}, {O.coverage('mat', 'sel', 0.73, 20, 10000)} SELECT round(avg(coverage), 9) AS mean_cov FROM cov",
)
def coverage_mean(spark, d):
    report = _coverage(spark, d, mode="width", target_width=0.73, min_bins=20, max_bins=10_000)
    return rounded(coverage.mean_coverage(report), 9, "mean_cov")


CURVE_KS = [100, 200, 400, 800, 1600, 3200]
CURVE = (
    f"rk AS (SELECT row_id, row_number() OVER (ORDER BY {O.hash_key(11, 'row_id')}, row_id) AS rn FROM mat), "
    "occ AS (SELECT pc, nb, {bins} AS b, min(rn) AS first FROM lf JOIN grid USING (pc) JOIN rk USING (row_id) GROUP BY 1, 2, 3), "
    "per AS (SELECT k, pc, count(*) FILTER (b < nb AND first <= k)::DOUBLE / greatest(count(*) FILTER (b < nb), 1) AS c "
    "FROM occ, (SELECT unnest({ks}) AS k) GROUP BY k, pc), curve AS (SELECT k, round(avg(c), 9) AS mean_cov FROM per GROUP BY k)"
)


def curve_sql(ks) -> str:
    return (
        f"{LINE_MATRIX}, {O.grid_counts('mat', 0.73, 20, 10000)}, "
        + CURVE.format(bins=O.bin_index("v", "lo", "hi", "nb"), ks=list(ks))
    )


@query("coverage_prefix_curve", f"WITH {curve_sql(CURVE_KS)} SELECT CAST(k AS BIGINT) AS k, mean_cov FROM curve")
def coverage_prefix_curve(spark, d):
    matrix = materialize(T.line_matrix(spark, d), "matrix")
    grid = coverage.auto_grid(matrix, "width", 0.73, 20, 10_000)
    values = auto.random_curve(auto.random_order(matrix, 11), grid, CURVE_KS)
    out = spark.createDataFrame(list(zip(CURVE_KS, map(float, values))), "k bigint, mean_cov double")
    return rounded(out, 9, "mean_cov")


RESAMPLE_KS = coverage.schedule(100, 20_000, 1.3)


@query(
    "resample_random_to_coverage",
    f"WITH {curve_sql(RESAMPLE_KS)}, stop AS (SELECT min(k) AS k FROM curve WHERE mean_cov >= 0.8) "
    "SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS round, CAST(k AS BIGINT) AS k, mean_cov, "
    "max(mean_cov) OVER (ORDER BY k) AS best_mean_cov FROM curve WHERE k <= coalesce((SELECT k FROM stop), 20000)",
)
def resample_random_to_coverage(spark, d):
    result = auto.resample_to_coverage(
        T.line_matrix(spark, d), "random", 0.8, k_start=100, k_max=20_000, seed=11, target_width=0.73
    )
    return rounded(result.history_frame(), 9, "mean_cov", "best_mean_cov")


PLATEAU = auto.StopRules(0.99, True, 0.3, 3, 0.08)


@query(
    "plateau_rule",
    f"WITH {curve_sql(RESAMPLE_KS)}, h AS (SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS round, "
    "CAST(k AS BIGINT) AS k, mean_cov, max(mean_cov) OVER (ORDER BY k) AS best_mean_cov FROM curve) "
    "SELECT *, count(*) OVER w >= 3 AND min(best_mean_cov) OVER w >= 0.3 AND max(best_mean_cov) OVER w - min(best_mean_cov) OVER w <= 0.08 "
    "AS plateau FROM h WINDOW w AS (ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
)
def plateau_rule(spark, d):
    result = auto.resample_to_coverage(
        T.line_matrix(spark, d), "random", 2.0, k_start=100, k_max=20_000, seed=11, target_width=0.73
    )
    return auto.plateau_rounds(rounded(result.history_frame(), 9, "mean_cov", "best_mean_cov"), PLATEAU)


# ---------------------------------------------------------------- samplers


@query(
    "random_sample",
    f"WITH {LINE_MATRIX} SELECT row_id FROM mat ORDER BY {O.hash_key(1, 'row_id')}, row_id LIMIT 5000",
)
def random_sample(spark, d):
    return sampling.sample(T.line_matrix(spark, d), "random", 5000, seed=1)


@query(
    "grid_sample",
    f"""WITH {LINE_MATRIX}, b AS (SELECT min(x[1]) AS u0, max(x[1]) AS u1, min(x[2]) AS v0, max(x[2]) AS v1 FROM mat),
c AS (SELECT row_id, {O.bin_index('x[1]', 'u0', 'u1', '20')} AS bx, {O.bin_index('x[2]', 'v0', 'v1', '20')} AS b2,
  {O.hash_key(2, 'row_id')} AS h FROM mat, b),
s AS (SELECT row_id, bx, b2, row_number() OVER (PARTITION BY bx, b2 ORDER BY h, row_id) AS rn FROM c WHERE bx < 20 AND b2 < 20),
strata AS (SELECT row_id FROM s WHERE rn <= 5 ORDER BY bx, b2, rn LIMIT 3000),
fill AS (SELECT row_id, row_number() OVER (ORDER BY {O.hash_key('2:fill', 'row_id')}, row_id) AS rn FROM mat ANTI JOIN strata USING (row_id))
SELECT row_id FROM strata UNION ALL SELECT row_id FROM fill WHERE rn <= 3000 - (SELECT count(*) FROM strata)""",
)
def grid_sample(spark, d):
    return sampling.sample(T.line_matrix(spark, d), "grid", 3000, bins=(20, 20), seed=2)


SCALED = (
    f"{O.LINES}, mat AS MATERIALIZED (SELECT row_id, [l_quantity, l_extendedprice / 1024.0::DOUBLE, "
    "l_discount * 512.0::DOUBLE, l_tax * 512.0::DOUBLE] AS x FROM lines)"
)


def distance2_4(a: str, b: str) -> str:
    return " + ".join(f"({a}[{j}] - {b}[{j}]) * ({a}[{j}] - {b}[{j}])" for j in range(1, 5))


@query("fps", f"WITH RECURSIVE {O.EMB.replace('emb AS', 'emb AS MATERIALIZED')}, {O.farthest_points('emb', 50, 0)} SELECT row_id, pick_order FROM picks")
def fps(spark, d):
    return sampling.sample(T.embedding_matrix(spark, d), "fps", 50)


@query("fps_lines", f"WITH RECURSIVE {SCALED}, {O.farthest_points('mat', 40, 3, distance2_4)} SELECT row_id, pick_order FROM picks")
def fps_lines(spark, d):
    return sampling.sample(T.line_matrix(spark, d, scaled=True), "fps", 40, seed=3)


@query(
    "density_fps",
    f"""WITH RECURSIVE {SCALED}, b AS (SELECT min(x[1]) AS u0, max(x[1]) AS u1, min(x[2]) AS v0, max(x[2]) AS v1 FROM mat),
c AS (SELECT row_id, x, {O.bin_closed('x[1]', 'u0', 'u1', '32')} AS bu, {O.bin_closed('x[2]', 'v0', 'v1', '32')} AS bv FROM mat, b),
h AS (SELECT bu, bv, count(*) AS n FROM c GROUP BY 1, 2),
dm AS MATERIALIZED (SELECT row_id, list_transform(x, lambda v: v * (1.0::DOUBLE / sqrt(n + 1e-12::DOUBLE))) AS x FROM c JOIN h USING (bu, bv)),
{O.farthest_points('dm', 20, 4, distance2_4)} SELECT row_id, pick_order FROM picks""",
)
def density_fps(spark, d):
    return sampling.sample(T.line_matrix(spark, d, scaled=True), "density_fps", 20, bins=32, seed=4)


@query("kpp", f"WITH RECURSIVE {O.EMB.replace('emb AS', 'emb AS MATERIALIZED')}, {O.kmeans_plus_plus('emb', 50, 0)} SELECT row_id, pick_order FROM picks")
def kpp(spark, d):
    return sampling.sample(T.embedding_matrix(spark, d), "kpp", 50)


@query("kpp_lines", f"WITH RECURSIVE {SCALED}, {O.kmeans_plus_plus('mat', 30, 5, distance2_4)} SELECT row_id, pick_order FROM picks")
def kpp_lines(spark, d):
    return sampling.sample(T.line_matrix(spark, d, scaled=True), "kpp", 30, seed=5)


def seeded_sql(k_start: int, batch: int, k_max: int, seed: int, target: float, width: float) -> str:
    """All rounds as one recursion over picks; the stop rule is applied to the curve."""
    ends = list(range(k_start, k_max + 1, batch))
    hashes = ", ".join(O.hash_key(seed + r, "row_id") for r in range(len(ends)))
    d = O.distance2("f.x", "p.x")
    restart = f"it >= {k_start} AND (it - {k_start}) % {batch} = 0"
    rnd = f"CAST((it - {k_start}) / {batch} AS INTEGER) + 2"
    return f"""
hs AS MATERIALIZED (SELECT row_id, x, [{hashes}] AS h FROM emb),
f(it, row_id, x, h, d2, taken, pick) AS (
  SELECT 1, row_id, x, h, 'infinity'::DOUBLE, false, arg_min(row_id, (h[1], row_id)) OVER () FROM hs
  UNION ALL
  SELECT it + 1, row_id, x, h, nd, nt, CASE WHEN {restart}
      THEN arg_min(CASE WHEN nt THEN NULL ELSE row_id END, CASE WHEN nt THEN NULL ELSE (h[least({rnd}, {len(ends)})], row_id) END) OVER ()
      ELSE arg_max(row_id, (CASE WHEN nt THEN -1.0 ELSE nd END, -row_id)) OVER () END
  FROM (SELECT f.it, f.row_id, f.x, f.h, f.taken OR f.row_id = p.row_id AS nt,
      CASE WHEN f.it >= {k_start} AND (f.it - {k_start}) % {batch} = 0 THEN 'infinity'::DOUBLE ELSE least(f.d2, {d}) END AS nd
      FROM f JOIN hs p ON p.row_id = f.pick WHERE f.it < {k_max})
),
picks AS (SELECT DISTINCT it AS rn, pick AS row_id FROM f),
{O.grid_counts('emb', width, 20, 10000)},
occ AS (SELECT pc, nb, {O.bin_index('v', 'lo', 'hi', 'nb')} AS b, min(rn) AS first FROM lf JOIN grid USING (pc) LEFT JOIN picks USING (row_id) GROUP BY 1, 2, 3),
per AS (SELECT k, pc, count(*) FILTER (b < nb AND first <= k)::DOUBLE / greatest(count(*) FILTER (b < nb), 1) AS c
  FROM occ, (SELECT unnest({ends}) AS k) GROUP BY k, pc),
curve AS (SELECT k, round(avg(c), 9) AS mean_cov FROM per GROUP BY k)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS round, CAST(k AS BIGINT) AS k, mean_cov FROM curve
WHERE k <= coalesce((SELECT min(k) FROM curve WHERE mean_cov >= {target}), {k_max})"""


@query(
    "seeded_fps_to_coverage",
    f"WITH RECURSIVE {O.EMB.replace('emb AS', 'emb AS MATERIALIZED')}, {seeded_sql(20, 10, 80, 0, 0.7, 0.031)}",
)
def seeded_fps_to_coverage(spark, d):
    result = auto.seeded_batches_to_coverage(
        T.embedding_matrix(spark, d), "fps", 0.7, k_start=20, batch=10, k_max=80, target_width=0.031
    )
    return rounded(result.history_frame(), 9, "mean_cov")


EMB_TABLE = O.EMB.replace("emb AS", "emb AS MATERIALIZED")


# Lloyd stops by itself after 9 or 10 steps here; more of them change nothing.
LLOYD = 14


@query("kmeans_medoids", f"WITH RECURSIVE {EMB_TABLE}, {O.lloyd('emb', 12, 0, LLOYD, 64)} {O.medoids('emb', f'c{LLOYD}')}")
def kmeans_medoids(spark, d):
    return sampling.sample(T.embedding_matrix(spark, d), "kmedoids", 12, n_init=1, tol=0.0)


# The second size tried reaches the target; both fits are spelled out.
ADAPTIVE = f"""WITH RECURSIVE {EMB_STATS}, w AS MATERIALIZED (SELECT row_id, list((v - mean) / (sd + 1e-12) ORDER BY pc) AS x
  FROM lf JOIN st USING (pc) GROUP BY 1),
{O.lloyd('w', 16, 0, LLOYD, 64, 'a')}, {O.lloyd('w', 24, 0, LLOYD, 64, 'b')},
fit AS (SELECT 1 - sum(m) / (SELECT sum(s * s) * max(n) FROM (SELECT j, stddev_pop(x[j]) AS s, count(*) AS n FROM w,
  unnest(range(1, 65)) AS u(j) GROUP BY j)) AS explained FROM (SELECT min({O.distance2('e.x', 'c.x')}) AS m FROM w e, c{LLOYD}a c GROUP BY e.row_id))
SELECT row_id FROM ({O.medoids('w', f'c{LLOYD}a')}) WHERE (SELECT explained FROM fit) >= 0.12
UNION ALL SELECT row_id FROM ({O.medoids('w', f'c{LLOYD}b')}) WHERE (SELECT explained FROM fit) < 0.12"""


@query("adaptive_kmedoids", ADAPTIVE)
def adaptive_kmedoids(spark, d):
    medoids, _ = kmeans.adaptive_kmeans_medoids(
        T.embedding_matrix(spark, d), target_explained=0.12, k_start=16, k_max=24, n_init=1, tol=0.0
    )
    return medoids


CLUSTERS = f"""{O.EMB}, lf AS ({O.long_form('emb', 'row_id, label')}),
ctr AS MATERIALIZED (SELECT label, list(m ORDER BY pc) AS c FROM (SELECT label, pc, avg(v) AS m FROM lf GROUP BY 1, 2) GROUP BY 1)"""


def _clusters(spark, d):
    matrix = T.embedding_matrix(spark, d)
    return matrix, birch.cluster_means(matrix, 64)


@query(
    "stratified_pick_medoid",
    f"WITH {CLUSTERS} SELECT DISTINCT r AS row_id FROM (SELECT arg_min(row_id, ({O.distance2('x', 'c')}, row_id)) AS r "
    "FROM emb, ctr GROUP BY ctr.label)",
)
def stratified_pick_medoid(spark, d):
    return birch.stratified_pick(*_clusters(spark, d), 1)


@query(
    "stratified_pick_spread",
    f"""WITH {CLUSTERS}, r AS (SELECT row_id, count(*) OVER (PARTITION BY label) AS n,
  row_number() OVER (PARTITION BY label ORDER BY {O.distance2('x', 'c')}, row_id) - 1 AS rank FROM emb JOIN ctr USING (label))
SELECT row_id FROM r WHERE n <= 4 OR rank = n - 1 OR rank IN (0, floor((n - 1) / 3.0::DOUBLE), floor(2.0::DOUBLE * ((n - 1) / 3.0::DOUBLE)))""",
)
def stratified_pick_spread(spark, d):
    return birch.stratified_pick(*_clusters(spark, d), 4)


@query("birch")
def birch_sample(spark, d):
    matrix = ST.standardize(T.embedding_matrix(spark, d).select("row_id", "x"))
    model = reduction.fit_pca(matrix, 8)
    return birch.direct_birch_sample(model.transform(matrix), model.explained_variance, threshold=2.0)[0]


@query("birch_global")
def birch_global(spark, d):
    matrix = ST.standardize(T.embedding_matrix(spark, d).select("row_id", "x"))
    model = reduction.fit_pca(matrix, 8)
    return birch.direct_birch_sample(
        model.transform(matrix), model.explained_variance, n_clusters=10, threshold=1.5, k_per_cluster=3
    )[0]


@query(
    "cluster_medoids",
    f"""WITH {CLUSTERS}, lab AS (SELECT *, CASE WHEN label < 8 THEN label ELSE -1 END AS l2 FROM emb),
md AS (SELECT l2, arg_min(row_id, ({O.distance2('x', 'c')}, row_id)) AS row_id FROM lab JOIN ctr USING (label) WHERE l2 >= 0 GROUP BY 1),
ex AS (SELECT row_id, row_number() OVER (PARTITION BY l2 ORDER BY {O.hash_key(6, 'row_id')}, row_id) AS rn
  FROM lab ANTI JOIN md USING (row_id) WHERE l2 >= 0),
ch AS (SELECT row_id FROM md UNION ALL SELECT row_id FROM ex WHERE rn < 3),
nz AS (SELECT row_id, row_number() OVER (ORDER BY {O.hash_key('6:noise', 'row_id')}, row_id) AS rn FROM lab WHERE l2 = -1)
SELECT row_id FROM ch UNION ALL SELECT row_id FROM nz WHERE rn <= (SELECT count(*) // 4 + 1 FROM ch)""",
)
def cluster_medoids(spark, d):
    labelled = T.embedding_matrix(spark, d).withColumn("label", F.when(F.col("label") < 8, F.col("label")).otherwise(-1))
    return hdbscan.medoids_of_labels(labelled, per_cluster=3, seed=6)


PAIRS = f"{EMB_TABLE}, pr AS MATERIALIZED (SELECT a.row_id AS i, b.row_id AS j, sqrt({O.distance2('a.x', 'b.x')}) AS d FROM emb a, emb b)"
NEAR = "nr AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM pr)"


def _points(spark, d):
    """Distinct points in cells, and the distances between cell pivots."""
    matrix = T.embedding_matrix(spark, d).select(F.col("row_id").alias("pid"), "x", F.lit(1).cast("bigint").alias("mult"))
    points = materialize(matrix, "points")
    placed, stats = cells.place(points, points.count(), 0)
    centres = np.array(stats["centre"].tolist())
    return placed, stats, cells.distances(centres, centres)


@query("nearest_neighbours", f"WITH {PAIRS}, {NEAR} SELECT i AS pid, j AS q, round(d, 9) AS d FROM nr WHERE rn <= 16")
def nearest_neighbours(spark, d):
    near = cells.nearest_lists(*_points(spark, d), 15)
    return rounded(near.select("pid", F.explode("near").alias("e")).select("pid", "e.q", "e.d"), 9, "d")


def _edge_search(k: int, start: str, step: str, weigh: str, union: str) -> str:
    """Edge weights of k neighbours: per row SEARCH_STEPS halvings of one number, then both directions joined."""
    return f"""WITH RECURSIVE {PAIRS}, {NEAR},
ls AS (SELECT i, list(j ORDER BY rn) AS js, list(d ORDER BY rn) AS ds FROM nr WHERE rn BETWEEN 2 AND {k + 1} GROUP BY i),
st AS (SELECT i, js, ds, {start} AS far, 1.0::DOUBLE AS s, 0.0::DOUBLE AS low, 'inf'::DOUBLE AS high, 0 AS step FROM ls
  UNION ALL
  SELECT i, js, ds, far, CASE WHEN isinf(h) THEN s * 2 ELSE (l + h) / 2 END, l, h, step + 1 FROM (
    SELECT *, CASE WHEN up THEN s ELSE low END AS l, CASE WHEN up THEN high ELSE s END AS h FROM (
      SELECT *, {step} AS up FROM st WHERE step < {embedding.SEARCH_STEPS}))),
ws AS (SELECT i, js, {weigh} AS ws FROM st WHERE step = {embedding.SEARCH_STEPS}),
eg AS (SELECT i, unnest(js) AS j, unnest(ws) AS w FROM ws),
su AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.w, 0) AS w, coalesce(b.w, 0) AS w2
  FROM eg a FULL JOIN eg b ON a.i = b.j AND a.j = b.i)
SELECT i, j, round({union}, 7) AS p FROM su"""


_FALL = "list_transform(far, lambda f: exp(-f / s))"
_RISE = "list_transform(far, lambda f: exp(-f * s))"


def _edges(spark, d, k, weigh, combine):
    placed, stats, _ = _points(spark, d)
    return rounded(combine(embedding.graph_of(placed, stats, k, weigh)), 7, "p")


@query(
    "umap_edges",
    _edge_search(
        15,
        "list_transform(ds, lambda v: greatest(v - coalesce(list_min(list_filter(ds, lambda u: u > 0)), 0), 0))",
        f"NOT list_sum({_FALL}) > log2(15)",
        "list_transform(far, lambda f: exp(-f / greatest(s, 0.001 * greatest(list_avg(ds), 1e-12))))",
        "w + w2 - w * w2",
    ),
)
def umap_edges(spark, d):
    return _edges(spark, d, 15, embedding.umap_weights, embedding.umap_edges)


@query(
    "tsne_edges",
    _edge_search(
        90,
        "list_transform(ds, lambda v: v * v - ds[1] * ds[1])",
        f"ln(list_sum({_RISE})) + s * list_sum(list_transform(far, lambda f: f * exp(-f * s))) / list_sum({_RISE}) > ln(30.0)",
        f"list_transform({_RISE}, lambda e: e / list_sum({_RISE}))",
        "w + w2",
    ),
)
def tsne_edges(spark, d):
    return _edges(spark, d, 90, lambda dist: embedding.tsne_weights(dist, 30.0), embedding.tsne_edges)


@query("hdbscan_core_distance", f"WITH {PAIRS}, {NEAR} SELECT i AS pid, round(d, 9) AS core FROM nr WHERE rn = 6")
def hdbscan_core_distance(spark, d):
    return rounded(hdbscan.core_distances(*_points(spark, d), 5), 9, "core")


def _prim(k):
    return f"""{PAIRS}, {NEAR}, co AS MATERIALIZED (SELECT i, d AS core FROM nr WHERE rn = {k + 1}),
mr AS MATERIALIZED (SELECT pr.i, pr.j, greatest(d, a.core, b.core) AS w FROM pr JOIN co a ON a.i = pr.i JOIN co b ON b.i = pr.j),
t(it, row_id, best, pick, w) AS (
  SELECT 1, j, w, arg_min(j, (w, j)) OVER (), min(w) OVER () FROM mr WHERE i = (SELECT min(row_id) FROM emb) AND j <> i
  UNION ALL
  SELECT it + 1, row_id, b, arg_min(row_id, (b, row_id)) OVER (), min(b) OVER ()
  FROM (SELECT t.it, t.row_id, least(t.best, mr.w) AS b FROM t JOIN mr ON mr.i = t.pick AND mr.j = t.row_id WHERE t.row_id <> t.pick))"""


def _tree(spark, d, k):
    """Spanning tree of the vectors and a row count of 1 for each."""
    placed, stats, gaps = _points(spark, d)
    placed, lists = hdbscan.with_lists(placed, stats, gaps, k)
    edges = materialize(hdbscan.tree_edges(placed, stats, gaps, lists), "edges")
    return hierarchy.spanning_tree(edges), placed.select(F.col("pid").alias("node"), F.col("mult").alias("size"))


@query(
    "hdbscan_spanning_tree",
    f"""WITH RECURSIVE {_prim(5)} SELECT round(w, 9) AS w, count(*) AS n FROM (SELECT DISTINCT it, w FROM t) GROUP BY 1""",
)
def hdbscan_spanning_tree(spark, d):
    return rounded(_tree(spark, d, 5)[0], 9, "w").groupBy("w").agg(F.count("*").alias("n"))


# Between two points the longest edge on the tree is the longest one that was added after the first of them.
_ADDED = """ord AS MATERIALIZED (
  SELECT 0 AS pos, min(row_id) AS row_id, NULL::DOUBLE AS w FROM emb UNION ALL SELECT DISTINCT it, pick, w FROM t)"""


@query(
    "hdbscan_seed_weight",
    f"""WITH RECURSIVE {_prim(5)}, {_ADDED},
up AS MATERIALIZED (SELECT a.row_id AS i, b.row_id AS j, max(b.w) OVER (PARTITION BY a.pos ORDER BY b.pos) AS w FROM ord a JOIN ord b ON b.pos > a.pos),
far AS (SELECT i, w, row_number() OVER (PARTITION BY i ORDER BY w) AS rn FROM (SELECT i, w FROM up UNION ALL SELECT j, w FROM up))
SELECT i AS row_id, round(w, 9) AS w FROM far WHERE rn = 4""",
)
def hdbscan_seed_weight(spark, d):
    """Weight at which the component of a row has 5 rows for the first time."""
    found = hierarchy.seeds(*_tree(spark, d, 5), 5)
    rows = found.members.join(found.born.select("seed", "w"), "seed")
    return rounded(rows.select(F.col("node").alias("row_id"), F.coalesce("key.w", "w").alias("w")), 9, "w")


# Components are runs of rows in the order in which the tree took them up; a run is split at its longest edge.
_CUT = "SELECT lo, hi, clo, chi, born, arg_max(pos, (ord.w, -pos)) AS k, 1 / greatest(max(ord.w), 1e-12) AS lam FROM runs JOIN ord ON pos > lo AND pos <= hi GROUP BY ALL"


@query(
    "hdbscan_stability",
    f"""WITH RECURSIVE {_prim(1)}, {_ADDED},
runs(lo, hi, clo, chi, born) AS (
  SELECT 0::BIGINT, max(pos)::BIGINT, 0::BIGINT, max(pos)::BIGINT, 0::DOUBLE FROM ord
  UNION ALL
  SELECT a, b, CASE WHEN two THEN a ELSE clo END, CASE WHEN two THEN b ELSE chi END, CASE WHEN two THEN lam ELSE born END
  FROM (SELECT *, k - lo >= 5 AND hi - k + 1 >= 5 AS two, CASE s WHEN 0 THEN lo ELSE k END AS a, CASE s WHEN 0 THEN k - 1 ELSE hi END AS b
        FROM ({_CUT}), (VALUES (0), (1)) sides(s))
  WHERE b - a + 1 >= 5),
lost AS (SELECT clo, chi, (lam - born) * CASE WHEN (k - lo >= 5) = (hi - k + 1 >= 5) THEN hi - lo + 1 ELSE least(k - lo, hi - k + 1) END AS m FROM ({_CUT}))
SELECT round(sum(m), 6) AS stability FROM lost GROUP BY clo, chi HAVING sum(m) > 1e-6""",
)
def hdbscan_stability(spark, d):
    """Stability of every cluster of at least 5 rows in the hierarchy.

    Core distances are those to the nearest row: larger ones make many edges equally
    long, and which of them split a cluster would depend on their order.
    """
    clusters = hierarchy.condense(*_tree(spark, d, 1), 5).clusters
    found = spark.createDataFrame(clusters[["stability"]]).filter("stability > 1e-6")
    return rounded(found, 6, "stability")


@query(
    "birch_features",
    "SELECT CAST(floor(l_quantity / 5.0::DOUBLE) AS BIGINT) AS b0, CAST(floor(l_extendedprice / 1024.0::DOUBLE / 5.0::DOUBLE) AS BIGINT) AS b1, "
    "count(*)::DOUBLE AS n, round(sum(l_quantity), 6) AS s0, round(sum(l_extendedprice / 1024.0::DOUBLE), 6) AS s1, "
    "round(sum(l_quantity * l_quantity + (l_extendedprice / 1024.0::DOUBLE) * (l_extendedprice / 1024.0::DOUBLE)), 4) AS ss FROM lineitem GROUP BY 1, 2",
)
def birch_features(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1024.0).alias("x"))
    f = birch.cell_features(rows, 5.0, 2)
    out = f.select(F.col("cell")[0].alias("b0"), F.col("cell")[1].alias("b1"), "n", F.col("ls")[0].alias("s0"), F.col("ls")[1].alias("s1"), "ss")
    return rounded(rounded(out, 6, "s0", "s1"), 4, "ss")


@query(
    "birch_bounds",
    "SELECT count(*)::DOUBLE AS n, round(sum(l_quantity), 4) AS s0, round(sum(l_extendedprice / 1024.0::DOUBLE), 4) AS s1, "
    "round(sum(l_quantity * l_quantity + (l_extendedprice / 1024.0::DOUBLE) * (l_extendedprice / 1024.0::DOUBLE)), 2) AS ss, "
    "CAST(0 AS BIGINT) AS beyond_radius FROM lineitem",
)
def birch_bounds(spark, d):
    """What all subclusters add up to, and how many are wider than the threshold."""
    rows = T.table(spark, d, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1024.0).alias("x"))
    subs = birch._subclusters(birch.cell_features(rows, 5.0 / 2**0.5, 2), 5.0, 2)[1]
    square = F.aggregate("ls", F.lit(0.0), lambda acc, v: acc + (v / F.col("n")) * (v / F.col("n")))
    return subs.withColumn("wide", F.col("ss") / F.col("n") - square > 25.0 + 1e-6).agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.col("ls")[0]), 4).alias("s0"),
        F.round(F.sum(F.col("ls")[1]), 4).alias("s1"),
        F.round(F.sum("ss"), 2).alias("ss"),
        F.count_if("wide").alias("beyond_radius"),
    )


WARD_PAIR = "(a.n * b.n / (a.n + b.n)) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(
    "ward_suppliers",
    f"""WITH RECURSIVE pts AS MATERIALIZED (SELECT l_suppkey AS id, avg(l_quantity) AS x, avg(l_extendedprice / 1024.0::DOUBLE) AS y FROM lineitem GROUP BY 1),
g AS (
  SELECT 0 AS step, id AS root, 1.0::DOUBLE AS n, x, y, [id] AS members FROM pts
  UNION ALL
  SELECT step + 1, min(root), sum(n), sum(n * x) / sum(n), sum(n * y) / sum(n), flatten(list(members))
  FROM (
    SELECT g.*, CASE WHEN root = w.hi THEN w.lo ELSE root END AS target
    FROM g, (SELECT unnest(arg_min({{'lo': a.root, 'hi': b.root}}, {WARD_PAIR})) FROM g a JOIN g b ON a.root < b.root HAVING (SELECT count(*) FROM g) > 8) w
  ) GROUP BY step, target
)
SELECT unnest(members) AS supplier, root AS cluster, CAST(n AS BIGINT) AS members FROM g WHERE step = (SELECT max(step) FROM g)""",
)
def ward_suppliers(spark, d):
    """Suppliers in eight Ward clusters of their mean quantity and price."""
    points = T.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("label")).agg(
        F.array(F.avg("l_quantity"), F.avg(F.col("l_extendedprice") / 1024.0)).alias("ls")
    )
    nodes = points.select(F.col("label").cast("bigint").alias("label"), F.lit(1.0).alias("n"), "ls", F.lit(0.0).alias("ss"))
    roots = agglomerate.survivors(nodes, agglomerate.cut_tree(agglomerate.merge_rounds(nodes, 2, None), 8))
    sizes = roots.groupBy("root").agg(F.count("*").alias("members"))
    return join_groups(roots, sizes, ["root"]).select(
        F.col("label").alias("supplier"), F.col("root").alias("cluster"), "members"
    )


@query("hdbscan")
def hdbscan_sample(spark, d):
    return sampling.sample(T.embedding_matrix(spark, d), "hdbscan", 0, min_cluster_size=5)


# ---------------------------------------------------------------- flagship

FLAGSHIP = f"""{O.EMB}, ef AS MATERIALIZED ({O.long_form('emb')}), es AS (SELECT pc, avg(v) AS mean, stddev_pop(v) AS sd FROM ef GROUP BY 1),
w AS MATERIALIZED (SELECT row_id, list((v - mean) / (sd + 1e-12) ORDER BY pc) AS x FROM ef JOIN es USING (pc) GROUP BY 1),
{O.farthest_points('w', 50, 0)},
{O.coverage('w', 'picks', 0.1, 20, 10000)}
SELECT label, count(*) AS n_hits, round((SELECT avg(coverage) FROM cov), 9) AS mean_cov FROM picks JOIN emb USING (row_id) GROUP BY label"""


@query("sample_coverage_lift", f"WITH RECURSIVE {FLAGSHIP}")
def sample_coverage_lift(spark, d):
    """Whiten, pick farthest points, measure coverage, lift to groups."""
    table = T.embedding_matrix(spark, d)
    matrix = materialize(ST.whiten(table), "whitened")
    picks = sampling.sample(matrix, "fps", 50)
    report = coverage.coverage_auto(matrix, picks, "width", 0.10, 20, 10_000)
    mean = coverage.mean_coverage(report).first()["mean_cov"]
    hits = table.join(picks.select("row_id"), "row_id").groupBy("label").agg(F.count("*").alias("n_hits"))
    return hits.withColumn("mean_cov", F.round(F.lit(float(mean)), 9))
