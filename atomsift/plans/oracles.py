"""SQL fragments shared by the reference queries for DuckDB."""

from __future__ import annotations

LINE_KEYS = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)
LINES = f"lines AS (SELECT *, row_number() OVER (ORDER BY {LINE_KEYS}) - 1 AS row_id FROM lineitem)"
FILES = (
    "files AS (SELECT o.*, c_nationkey AS file_id FROM orders o JOIN customer ON o_custkey = c_custkey)"
)
FILEMAP = (
    "fmap AS (SELECT CAST(n_nationkey AS INTEGER) AS fid, n_name AS file_path FROM nation WHERE n_regionkey > 0)"
)
ATOMS = (
    f"{LINES}, {FILES}, atoms AS (SELECT row_id, CAST(file_id AS INTEGER) AS file_id, "
    "CAST(l_orderkey AS INTEGER) AS struct_id, "
    "CAST(row_id - min(row_id) OVER (PARTITION BY l_orderkey) AS INTEGER) AS atom_id, "
    "l_returnflag AS symbol, l_linestatus = 'F' AS is_fixed, "
    "CAST(l_orderkey AS INTEGER) AS source_struct_id FROM lines JOIN files ON l_orderkey = o_orderkey)"
)
EMB = "emb AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def hash_key(seed, row: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({row} AS VARCHAR)), 1, 15) AS BIGINT)"


def hash_uniform(seed, row: str) -> str:
    return f"((({hash_key(seed, row)} >> 8) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def edge(i: str, lo: str, hi: str, nb: str) -> str:
    return f"(CASE WHEN ({i}) >= {nb} THEN {hi} ELSE ({i}) * (({hi} - {lo}) / {nb}) + {lo} END)"


def bin_index(x: str, lo: str, hi: str, nb: str) -> str:
    g = f"CAST(floor(({x} - {lo}) / (({hi} - {lo}) / {nb})) AS BIGINT)"
    return (
        f"(CASE WHEN {hi} > {lo} THEN {g}"
        f" + (CASE WHEN {g} < {nb} AND {x} >= {edge(g + ' + 1', lo, hi, nb)} THEN 1 ELSE 0 END)"
        f" - (CASE WHEN {x} < {edge(g, lo, hi, nb)} THEN 1 ELSE 0 END) ELSE {nb} END)"
    )


def bin_closed(x: str, lo: str, hi: str, nb: str) -> str:
    return f"least({bin_index(x, lo, hi, nb)}, {nb} - 1)"


def long_form(source: str, keys: str = "row_id") -> str:
    """(keys, pc, v) of a table with a list column x."""
    return (
        f"SELECT {keys}, CAST(u.j - 1 AS INTEGER) AS pc, x[u.j] AS v "
        f"FROM {source}, unnest(range(1, len(x) + 1)) AS u(j)"
    )


def distance2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def farthest_points(source: str, k: int, seed: int, dist=distance2) -> str:
    """CTEs ending in picks(pick_order, row_id) over source(row_id, x)."""
    d = dist("f.x", "p.x")
    return f"""
start AS (SELECT row_id FROM {source} ORDER BY {hash_key(seed, 'row_id')}, row_id LIMIT 1),
f(it, row_id, x, d2, pick) AS (
  SELECT 1, row_id, x, 'infinity'::DOUBLE, (SELECT row_id FROM start) FROM {source}
  UNION ALL
  SELECT it + 1, row_id, x, nd, arg_max(row_id, (nd, -row_id)) OVER ()
  FROM (SELECT f.it, f.row_id, f.x,
               CASE WHEN f.row_id = p.row_id OR f.d2 < 0 THEN -1.0 ELSE least(f.d2, {d}) END AS nd
        FROM f JOIN {source} p ON p.row_id = f.pick WHERE f.it < {k})
),
picks AS (SELECT DISTINCT CAST(it - 1 AS INTEGER) AS pick_order, pick AS row_id FROM f)"""


def kmeans_plus_plus(source: str, k: int, seed: int, dist=distance2, tag: str = "") -> str:
    """CTEs ending in picks<tag>(pick_order, row_id)."""
    wait = "(CASE WHEN w > 0 THEN greatest(fuse, 0.0) / w ELSE 'infinity'::DOUBLE END)"
    return f"""
start{tag} AS (SELECT row_id, x FROM {source} ORDER BY {hash_key(seed, 'row_id')}, row_id LIMIT 1),
g{tag}(it, row_id, x, w, fuse, pick, gap) AS (
  SELECT 1, row_id, x, w, fuse, arg_min(row_id, ({wait}, row_id)) OVER (), min({wait}) OVER ()
  FROM (SELECT e.row_id, e.x, CASE WHEN e.row_id = s.row_id THEN -1.0 ELSE {dist('e.x', 's.x')} END AS w,
               -ln({hash_uniform(f'{seed}:clock', 'e.row_id')}) AS fuse FROM {source} e, start{tag} s)
  UNION ALL
  SELECT it + 1, row_id, x, w, fuse, arg_min(row_id, ({wait}, row_id)) OVER (), min({wait}) OVER ()
  FROM (SELECT g.it, g.row_id, g.x, g.fuse - g.w * g.gap AS fuse,
               CASE WHEN g.row_id = p.row_id OR g.w < 0 THEN -1.0 ELSE least(g.w, {dist('g.x', 'p.x')}) END AS w
        FROM g{tag} g JOIN {source} p ON p.row_id = g.pick WHERE g.it < {k - 1})
),
picks{tag} AS (SELECT 0 AS pick_order, row_id FROM start{tag}
          UNION ALL SELECT DISTINCT CAST(it AS INTEGER), pick FROM g{tag})"""


def lloyd(source: str, k: int, seed: int, iterations: int, width: int, tag: str = "") -> str:
    """CTEs of seeds and unrolled Lloyd steps over a materialised source(row_id, x).

    The centres end in c<iterations><tag>(label, x).
    """
    ctes = [
        kmeans_plus_plus(source, k, seed, tag=tag).strip(),
        f"c0{tag} AS MATERIALIZED (SELECT pick_order AS label, x FROM picks{tag} JOIN {source} USING (row_id))",
    ]
    d = distance2("e.x", "c.x")
    for i in range(iterations):
        ctes.append(
            f"a{i}{tag} AS MATERIALIZED (SELECT e.row_id, any_value(e.x) AS x, arg_min(c.label, ({d}, c.label)) AS label "
            f"FROM {source} e, c{i}{tag} c GROUP BY e.row_id)"
        )
        ctes.append(
            f"m{i}{tag} AS (SELECT label, u.j AS j, avg(x[u.j]) AS v FROM a{i}{tag}, unnest(range(1, {width + 1})) AS u(j) GROUP BY 1, 2)"
        )
        ctes.append(
            f"c{i + 1}{tag} AS MATERIALIZED (SELECT label, coalesce(n.x, o.x) AS x FROM c{i}{tag} o LEFT JOIN "
            f"(SELECT label, list(v ORDER BY j) AS x FROM m{i}{tag} GROUP BY 1) n USING (label))"
        )
    return ", ".join(ctes)


def medoids(source: str, centres: str) -> str:
    d = distance2("e.x", "c.x")
    return f"SELECT arg_min(e.row_id, ({d}, e.row_id)) AS row_id FROM {source} e, {centres} c GROUP BY c.label"


def grid_counts(matrix: str, width: float, min_bins: int, max_bins: int, rule: str = "width") -> str:
    """CTEs lf(row_id, pc, v) and grid(pc, lo, hi, nb)."""
    step = {
        "width": f"{width}::DOUBLE",
        "fd": "2.0 * greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-12) * pow(count(*), -1.0/3.0::DOUBLE)",
        "scott": "3.5 * greatest(stddev_pop(v), 1e-12) * pow(count(*), -1.0/3.0::DOUBLE)",
    }[rule]
    return f"""
lf AS MATERIALIZED ({long_form(matrix)}),
grid AS (SELECT pc, min(v) AS lo, max(v) AS hi,
  CAST(least(greatest(ceil(greatest(max(v) - min(v), 1e-12) / greatest({step}, 1e-12)), {min_bins}), {max_bins}) AS INTEGER) AS nb
  FROM lf GROUP BY pc)"""


def coverage(matrix: str, selected: str, width: float, min_bins: int, max_bins: int, rule: str = "width") -> str:
    """CTEs ending in cov(pc, nb, n_support, n_covered, coverage)."""
    return f"""{grid_counts(matrix, width, min_bins, max_bins, rule)},
occ AS (SELECT pc, nb, {bin_index('v', 'lo', 'hi', 'nb')} AS b, bool_or(s.row_id IS NOT NULL) AS hit
  FROM lf JOIN grid USING (pc) LEFT JOIN (SELECT DISTINCT row_id FROM {selected}) s USING (row_id) GROUP BY 1, 2, 3),
cov AS (SELECT pc, nb, count(*) FILTER (b < nb) AS n_support, count(*) FILTER (b < nb AND hit) AS n_covered,
  count(*) FILTER (b < nb AND hit)::DOUBLE / greatest(count(*) FILTER (b < nb), 1) AS coverage FROM occ GROUP BY pc, nb)"""
