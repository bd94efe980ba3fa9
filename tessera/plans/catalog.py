"""SQL that gives the rows of the queries in ``network_queries``, over the same tables."""

from __future__ import annotations

from tessera.hw import HardwareConfig

TABLES = "part lineitem orders embeddings events supplier customer nation region".split()
#: Hardware of the fixed grids.
GRID = HardwareConfig(4, 15, 3, 2)


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def uniform(self, seed: int, *keys: str) -> str:
        """A number in [0, 2**32) from md5."""
        text = f"concat_ws(':', {seed}, {', '.join(f'CAST({k} AS BIGINT)' for k in keys)})"
        return f"CAST(conv(substr(md5({text}), 1, 8), 16, 10) AS BIGINT)" if self.spark else f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"

    def chance(self, p: str, seed: int, *keys: str) -> str:
        return f"{self.uniform(seed, *keys)} < ({p}) * 4294967296"

    def range(self, n: int, name: str) -> str:
        return f"(SELECT {'id' if self.spark else 'range'} AS {name} FROM range({n}))"

    def text(self, sql: str) -> str:
        return sql if self.spark else sql.replace(" DIV ", " // ")


#: Four router children, three levels, slices double; the core size follows from the number of parts.
HW = "hw AS (SELECT 4 AS r, 3 AS l, 2 AS f, CAST((count(*) + 63) DIV 64 AS BIGINT) AS n FROM part)"
GRAPH = f"""{HW},
neurons AS (SELECT CAST(p_partkey AS BIGINT) AS id FROM part),
edges AS (SELECT DISTINCT src, tgt FROM (
  SELECT CAST(l_partkey AS BIGINT) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS tgt
  FROM lineitem) t WHERE tgt IS NOT NULL AND src <> tgt),
place AS (SELECT id AS neuron, id DIV n AS core, id % n AS local FROM neurons CROSS JOIN hw)"""
_D = " + ".join(f"CAST(s.core DIV {4**k} <> t.core DIV {4**k} AS INT)" for k in range(3))
PLACED = f"""{GRAPH},
placed AS (SELECT src, tgt, s.local AS src_local, s.core AS src_core, t.core AS tgt_core, {_D} AS distance
  FROM edges JOIN place s ON s.neuron = src JOIN place t ON t.neuron = tgt),
addressed AS (SELECT p.*, CAST(least(pow(f, distance), n) AS BIGINT) AS slices, ((src_local + 1) * CAST(least(pow(f, distance), n) AS BIGINT) - 1) DIV n AS own FROM placed p CROSS JOIN hw),
hits AS (SELECT tgt, distance, own, count(*) AS hits FROM addressed WHERE distance > 0 GROUP BY tgt, distance, own),
best AS (SELECT tgt, distance, own, hits FROM (SELECT *, row_number() OVER (PARTITION BY tgt, distance ORDER BY hits DESC, own) AS k FROM hits) r WHERE k = 1),
slices AS (SELECT id AS neuron, CAST(d.distance AS INT) AS distance, CAST(coalesce(own, 0) AS BIGINT) AS slice, CAST(coalesce(hits, 0) AS BIGINT) AS hits
  FROM neurons CROSS JOIN (SELECT 1 AS distance UNION ALL SELECT 2 UNION ALL SELECT 3) d LEFT JOIN best ON tgt = id AND best.distance = d.distance),
valid AS (SELECT x.*, x.distance = 0 OR coalesce(own = slice, false) AS valid FROM addressed x LEFT JOIN slices s ON s.neuron = tgt AND s.distance = x.distance)"""
LABELS = "labels_ AS (SELECT CAST(p_partkey AS BIGINT) AS neuron, p_brand AS truth, p_size AS predicted, dense_rank() OVER (ORDER BY p_brand) - 1 AS cluster FROM part)"
PARENTS = [(0, 4), (1, 4), (2, 5), (3, 6), (4, 7), (5, 7), (6, 7), (7, -1)]
TREE = "tree AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {p})" for c, p in PARENTS) + ") v(cluster, parent))"
RESULTS = """results AS (SELECT concat('mapper', CAST(o_orderkey % 3 AS STRING)) AS mapper, concat('net', CAST(o_custkey % 5 AS STRING)) AS input_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Inconsistencies' ELSE 'Hardware Size' END AS metric, CAST(o_orderkey % 1000 AS DOUBLE) AS value, o_orderkey % 17 = 0 AS failed FROM orders)"""


def catalog(d: Dialect) -> dict[str, str]:
    g, q = GRID, {}
    pairs = f"{d.range(g.cores, 'a')} x CROSS JOIN {d.range(g.cores, 'b')} y"
    addresses = f"{d.range(g.n, 'x')} x CROSS JOIN {d.range(g.l + 1, 'dist')} y"
    slots = f"CAST(pow(r, l) AS BIGINT) * n"  # noqa: F541
    # scalar functions
    q["s1_hardware_totals"] = f"WITH {HW} SELECT CAST(pow(r, l) AS BIGINT) AS total_cores, {slots} AS total_neurons, CAST(l AS BIGINT) AS max_distance FROM hw"
    q["s4_slot_addresses"] = f"SELECT CAST(core * {g.n} + local AS BIGINT) AS slot, CAST(slot_ DIV {g.n} AS BIGINT) AS core_back, CAST(slot_ % {g.n} AS BIGINT) AS local_back FROM (SELECT *, core * {g.n} + local AS slot_ FROM {d.range(g.cores, 'core')} c CROSS JOIN {d.range(g.n, 'local')} l) t"
    q["s6_core_distance"] = f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST({g.distance_sql('a', 'b')} AS BIGINT) AS distance FROM {pairs}"
    q["s7_slice_bounds"] = f"SELECT CAST(dist AS BIGINT) AS distance, CAST(k AS BIGINT) AS slice, CAST({g.low_sql('dist', 'k')} AS BIGINT) AS low, CAST({g.high_sql('dist', 'k')} AS BIGINT) AS high FROM {d.range(g.l + 1, 'dist')} y CROSS JOIN {d.range(g.n, 'k')} s WHERE k < {g.slices_sql('dist')}"
    q["s9_slice_index"] = f"SELECT CAST(dist AS BIGINT) AS distance, CAST(x AS BIGINT) AS x, CAST({g.slice_sql('dist', 'x')} AS BIGINT) AS slice FROM {addresses}"
    q["s10_valid_connection"] = f"SELECT CAST(dist AS BIGINT) AS distance, CAST(x AS BIGINT) AS x, CAST(k AS BIGINT) AS k, x >= {g.low_sql('dist', 'k')} AND x < {g.high_sql('dist', 'k')} AS valid FROM {addresses} CROSS JOIN {d.range(8, 'k')} s WHERE k < {g.slices_sql('dist')}"
    q["s11_halving_slices"] = f"SELECT CAST(dist AS BIGINT) AS distance, CAST(x AS BIGINT) AS x, CAST(x * CAST(pow(2, dist) AS BIGINT) DIV {g.n} AS BIGINT) AS slice FROM {addresses}"
    q["s12_log_star"] = "SELECT CAST(n AS BIGINT) AS n, round(ln(2.865064) + l1 + CASE WHEN l1 > 1 THEN l2 ELSE 0 END + CASE WHEN l1 > 1 AND l2 > 1 THEN l3 ELSE 0 END, 9) AS log_star FROM (SELECT n, l1, l2, CASE WHEN l2 > 0 THEN ln(l2) ELSE 0 END AS l3 FROM (SELECT n, l1, CASE WHEN l1 > 0 THEN ln(l1) ELSE 0 END AS l2 FROM (SELECT n + 1 AS n, ln(n + 1) AS l1 FROM " + d.range(1000, "n") + " a) b) c) e"
    q["s13_degree_scale"] = f"SELECT CAST(b AS BIGINT) AS b, CAST(h AS BIGINT) AS h, round(1 + ((b - 1) / CAST(b AS DOUBLE)) * coalesce(sum(pow(b / CAST(2 AS DOUBLE), k)), 0), 8) AS scale FROM (SELECT b + 2 AS b FROM {d.range(4, 'b')} v) x CROSS JOIN {d.range(5, 'h')} y LEFT JOIN (SELECT k + 1 AS k FROM {d.range(5, 'k')} w) z ON k <= h GROUP BY b, h"
    p = "CASE WHEN cs = ct THEN 1.0 WHEN cs < 3 AND ct < 3 THEN CASE WHEN abs(cs - ct) = 1 THEN 0.2 ELSE 0.0 END WHEN cs < 3 THEN 0.1 WHEN ct < 3 THEN 0.8 ELSE 0.0 END"
    q["s15_connection_probability"] = f"SELECT CAST(cs AS BIGINT) AS cs, CAST(ct AS BIGINT) AS ct, CAST({p} AS DOUBLE) AS p FROM {d.range(5, 'cs')} a CROSS JOIN {d.range(5, 'ct')} b"
    q["s16_strings"] = "SELECT DISTINCT CASE WHEN length(p_name) > 12 THEN concat(substr(p_name, 1, 9), '...') ELSE p_name END AS short, replace(replace(p_brand, ' ', '_'), '#', '_') AS safe FROM part"
    # sources
    n = 60
    ij = f"{d.range(n, 'i')} a CROSS JOIN {d.range(n, 'j')} b"
    q["g1_erdos_renyi"] = f"SELECT CAST(i AS BIGINT) AS src, CAST(j AS BIGINT) AS tgt FROM {ij} WHERE i <> j AND {d.chance('0.1', 42, 'i', 'j')}"
    m = HardwareConfig(2, 15, 2, 2)
    drawn = f"{d.uniform(7, 't', 'dist')} % {m.slices_sql('dist')}"
    slot_pairs = f"(SELECT s, t, s DIV {m.n} AS cs, s % {m.n} AS xs, t DIV {m.n} AS ct FROM {d.range(m.slots, 's')} a CROSS JOIN {d.range(m.slots, 't')} b)"
    chosen = f"(SELECT *, {drawn} AS k FROM (SELECT *, {m.distance_sql('cs', 'ct')} AS dist FROM {slot_pairs} p) o)"
    q["g2_feasible_slices"] = f"SELECT CAST(s AS BIGINT) AS src, CAST(t AS BIGINT) AS tgt FROM {chosen} c WHERE s <> t AND (dist = 0 OR (xs >= {m.low_sql('dist', 'k')} AND xs < {m.high_sql('dist', 'k')})) AND {d.chance('0.5', 42, 's', 't')}"
    q["g3_soft_wta"] = f"SELECT CAST(i AS BIGINT) AS src, CAST(j AS BIGINT) AS tgt FROM (SELECT i, j, i DIV 12 AS cs, j DIV 12 AS ct FROM {ij}) e WHERE i <> j AND {d.chance(p, 42, 'i', 'j')}"
    q["g4_wta"] = f"SELECT CAST(src AS BIGINT) AS src, CAST(tgt AS BIGINT) AS tgt FROM (SELECT i AS src, {n - 1} AS tgt FROM {d.range(n - 1, 'i')} a UNION ALL SELECT {n - 1} AS src, i AS tgt FROM {d.range(n - 1, 'i')} b) e WHERE {d.chance('0.5', 42, 'src', 'tgt')}"
    lca = " + ".join(f"CAST(i DIV {15 * 2**k} <> j DIV {15 * 2**k} AS INT)" for k in range(2))
    q["g5_block_hierarchy"] = f"SELECT CAST(i AS BIGINT) AS src, CAST(j AS BIGINT) AS tgt, CAST(h AS BIGINT) AS height FROM (SELECT i, j, {lca} AS h FROM {ij}) e WHERE i <> j AND {d.chance('0.3 * pow(2.0, -h)', 42, 'i', 'j')}"
    q["g7_two_components"] = f"SELECT CAST(i AS BIGINT) AS src, CAST(j AS BIGINT) AS tgt FROM {d.range(16, 'i')} a CROSS JOIN {d.range(16, 'j')} b WHERE i <> j AND i DIV 8 = j DIV 8"
    # constraints
    q["p4_assignment_violations"] = f"WITH {PLACED} SELECT 'core out of range' AS rule, count_if(core < 0 OR core >= 64) AS violations FROM place UNION ALL SELECT 'local out of range', count_if(local < 0 OR local >= n) FROM place CROSS JOIN hw UNION ALL SELECT 'core over capacity', count_if(k > n) FROM (SELECT core, count(*) AS k FROM place GROUP BY core) c CROSS JOIN hw UNION ALL SELECT 'slot shared', count_if(k > 1) FROM (SELECT core, local, count(*) AS k FROM place GROUP BY core, local) s UNION ALL SELECT 'slice out of range', count_if(slice < 0 OR slice >= least(pow(2, distance), n)) FROM slices CROSS JOIN hw"
    q["p8_clustering_check"] = f"WITH {LABELS} SELECT max(cluster) < count(DISTINCT cluster) AS dense, count(DISTINCT cluster) <= 64 AS fits_cores, max(size) AS largest FROM (SELECT cluster, count(*) OVER (PARTITION BY cluster) AS size FROM labels_) c"
    q["p10_result_filter"] = f"WITH {RESULTS} SELECT mapper, input_id, value FROM results WHERE metric = 'Inconsistencies' AND input_id = 'net1' AND mapper IN ('mapper0', 'mapper2')"
    # joins
    q["j1_placed_edges"] = f"WITH {PLACED} SELECT src, tgt, CAST(src_local AS BIGINT) AS src_local, CAST(src_core AS BIGINT) AS src_core, CAST(tgt_core AS BIGINT) AS tgt_core, CAST(distance AS BIGINT) AS distance FROM placed"
    half = "(SELECT core, CAST(local >= n DIV 2 AS INT) AS half, count(*) AS candidates FROM place CROSS JOIN hw WHERE local < 2 * n DIV 2 GROUP BY 1, 2)"
    q["j5_slice_range_join"] = f"WITH {GRAPH} SELECT t.neuron AS tgt, s.candidates FROM place t JOIN {half} s ON s.core = (t.core + 1) % 64 AND s.half = t.neuron % 2"
    q["j6_induced_subgraph"] = f"WITH {GRAPH}, {LABELS} SELECT src, tgt FROM edges JOIN labels_ a ON a.neuron = src JOIN labels_ b ON b.neuron = tgt WHERE a.cluster = b.cluster"
    q["j7_free_slots"] = f"WITH {GRAPH} SELECT CAST(range DIV n AS BIGINT) AS core, CAST(range % n AS BIGINT) AS local FROM range(64 * (SELECT n FROM hw)) CROSS JOIN hw WHERE range NOT IN (SELECT core * n + local FROM place CROSS JOIN hw)"
    q["j10_contingency"] = f"WITH {LABELS} SELECT truth, predicted, count(*) AS k FROM labels_ GROUP BY truth, predicted"
    # metrics
    q["a7_hardware_cost"] = f"WITH {GRAPH} SELECT round(CAST(1.5 * 64 * n * n + 2.0 * n * (r - 1) / 63 + 0.5 * greatest(0, 64 * n - c) AS DOUBLE), 6) AS cost, CAST(1.0 * 64 * n + 2.0 * 64 * l * r + 0.5 * greatest(0, 64 * n - c) AS DOUBLE) AS joint_cost FROM hw CROSS JOIN (SELECT count(*) AS c FROM neurons) k"
    q["a8_total_connections"] = f"WITH {HW} SELECT CAST(64 * n * (n + 3 * (n DIV CAST(least(2, n) AS BIGINT)) + 12 * (n DIV CAST(least(4, n) AS BIGINT)) + 48 * (n DIV CAST(least(8, n) AS BIGINT))) AS BIGINT) AS connections FROM hw"
    q["a10_adjusted_rand"] = f"WITH {LABELS}, c AS (SELECT truth, predicted, count(*) AS k FROM labels_ GROUP BY truth, predicted), x AS (SELECT sum(k * (k - 1) / 2.0) AS s FROM c), a AS (SELECT sum(k * (k - 1) / 2.0) AS s FROM (SELECT sum(k) AS k FROM c GROUP BY truth) t), b AS (SELECT sum(k * (k - 1) / 2.0) AS s FROM (SELECT sum(k) AS k FROM c GROUP BY predicted) t), m AS (SELECT sum(k) * (sum(k) - 1) / 2.0 AS s FROM c) SELECT round(CAST((x.s - a.s * b.s / m.s) / ((a.s + b.s) / 2 - a.s * b.s / m.s) AS DOUBLE), 9) AS ari FROM x CROSS JOIN a CROSS JOIN b CROSS JOIN m"
    q["a13_description_length"] = f"WITH {GRAPH} SELECT round(c * ln(64) + c * ln(n) + c * (ln(least(2, n)) + ln(least(4, n)) + ln(least(8, n))), 4) AS nats FROM hw CROSS JOIN (SELECT count(*) AS c FROM neurons) k"
    q["a14_search_energy"] = f"WITH {PLACED} SELECT round(CAST(max(v) AS DOUBLE) + 0.01 * max(64 * n * n) + 0.1 * max(CAST(n * 3 AS DOUBLE) / 63), 6) AS energy FROM (SELECT count_if(NOT valid) AS v FROM valid) c CROSS JOIN hw"
    q["a15_degrees"] = f"WITH {GRAPH}, o AS (SELECT src AS id, count(*) AS k FROM edges GROUP BY src), i AS (SELECT tgt AS id, count(*) AS k FROM edges GROUP BY tgt) SELECT n.id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree FROM neurons n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id"
    q["a16_core_occupancy"] = f"WITH {GRAPH} SELECT CAST(core AS BIGINT) AS core, count(*) AS neurons FROM place GROUP BY core"
    q["a17_core_links"] = f"WITH {PLACED} SELECT CAST(tgt_core AS BIGINT) AS tgt_core, CAST(src_core AS BIGINT) AS src_core, count(*) AS links FROM placed WHERE tgt_core <> src_core GROUP BY tgt_core, src_core"
    q["a18_link_distance"] = f"WITH {PLACED}, k AS (SELECT tgt_core AS a, src_core AS b, count(*) AS e FROM placed GROUP BY 1, 2), grid AS (SELECT a, b FROM {d.range(64, 'a')} x CROSS JOIN {d.range(64, 'b')} y), v AS (SELECT grid.a, grid.b, CASE WHEN grid.a = grid.b THEN 0 WHEN coalesce(e, 0) <= 1 THEN 21 ELSE 1 END AS w FROM grid LEFT JOIN k ON k.a = grid.a AND k.b = grid.b) SELECT CAST(v.a AS BIGINT) AS a, CAST(v.b AS BIGINT) AS b, CAST(least(v.w, z.w) AS BIGINT) AS distance FROM v JOIN v z ON z.a = v.b AND z.b = v.a"
    q["a19_block_links"] = f"WITH {GRAPH}, {LABELS}, z AS (SELECT cluster, count(*) AS k FROM labels_ GROUP BY cluster), e AS (SELECT a.cluster AS ca, b.cluster AS cb, count(*) AS links FROM edges JOIN labels_ a ON a.neuron = src JOIN labels_ b ON b.neuron = tgt GROUP BY 1, 2) SELECT CAST(x.cluster AS BIGINT) AS a, CAST(y.cluster AS BIGINT) AS b, coalesce(links, 0) AS links, x.k * y.k - CASE WHEN x.cluster = y.cluster THEN x.k ELSE 0 END AS possible FROM z x CROSS JOIN z y LEFT JOIN e ON ca = x.cluster AND cb = y.cluster"
    q["a20_hierarchy"] = f"WITH RECURSIVE {TREE}, walk AS (SELECT cluster, 0 AS depth FROM tree WHERE parent = -1 UNION ALL SELECT t.cluster, w.depth + 1 FROM tree t JOIN walk w ON t.parent = w.cluster) SELECT CAST(w.cluster AS BIGINT) AS cluster, CAST(w.depth AS BIGINT) AS depth, coalesce(k, 0) AS children FROM walk w LEFT JOIN (SELECT parent, count(*) AS k FROM tree GROUP BY parent) c ON c.parent = w.cluster"
    q["a21_graph_moments"] = f"WITH {GRAPH}, u AS (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM edges), deg AS (SELECT id, count(x) AS k FROM neurons LEFT JOIN (SELECT src AS x FROM edges UNION ALL SELECT tgt FROM edges) e ON x = id GROUP BY id), tri AS (SELECT count(*) AS t FROM u p JOIN u q ON q.a = p.b JOIN u r ON r.a = p.a AND r.b = q.b) SELECT round(avg(k), 9) AS mean_degree, round(var_samp(k), 6) AS var_degree, round(CAST(3 * max(t) AS DOUBLE) / count(*), 9) AS mean_triangles FROM deg CROSS JOIN tri"
    q["a23_replicate_means"] = f"WITH {RESULTS} SELECT input_id, metric, mapper, round(avg(value), 9) AS value FROM results WHERE NOT failed GROUP BY input_id, metric, mapper"
    q["a24_density"] = f"WITH {GRAPH} SELECT round(CAST(m AS DOUBLE) / (n * (n - 1)), 12) AS density FROM (SELECT count(*) AS m FROM edges) e CROSS JOIN (SELECT count(*) AS n FROM neurons) v"
    # ranking and sets
    q["w6_spread"] = f"WITH {GRAPH} SELECT neuron, CAST(core AS BIGINT) AS core, CAST(local AS BIGINT) AS local FROM place"
    q["w9_adjacency_order"] = f"WITH {GRAPH} SELECT neuron, row_number() OVER (ORDER BY core, local) - 1 AS place FROM place"
    q["w11_log_gaps"] = "SELECT CAST(k AS BIGINT) AS k, round(ln(lag(v) OVER (ORDER BY v DESC)) - ln(v), 9) AS gap FROM (SELECT p_size AS k, CAST(count(*) AS DOUBLE) + p_size / 1000.0 AS v FROM part GROUP BY p_size) t"
    q["w12_dense_labels"] = f"WITH {LABELS} SELECT neuron, CAST(cluster AS BIGINT) AS cluster FROM labels_"
    q["w13_active_levels"] = f"WITH {LABELS}, up AS (SELECT DISTINCT cluster, cluster DIV 3 AS parent FROM labels_ WHERE cluster % 4 <> 1) SELECT CAST(cluster AS BIGINT) AS cluster, CAST(dense_rank() OVER (ORDER BY parent) - 1 AS BIGINT) AS parent FROM up"
    q["set_undirected"] = f"WITH {GRAPH} SELECT src, tgt FROM edges WHERE src <> tgt UNION SELECT tgt, src FROM edges WHERE src <> tgt"
    q["c3_bethe_hessian"] = f"WITH {GRAPH}, u AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges), k AS (SELECT src AS id, count(*) AS deg FROM u GROUP BY src), r AS (SELECT sqrt(CAST(sum(deg) AS DOUBLE) / (SELECT count(*) FROM neurons)) AS r FROM k) SELECT src AS i, tgt AS j, round(-r, 8) AS x FROM u CROSS JOIN r UNION ALL SELECT n.id, n.id, round(r * r - 1 + coalesce(deg, 0), 8) FROM neurons n LEFT JOIN k ON k.id = n.id CROSS JOIN r"
    q["c5_laplacian"] = f"WITH {GRAPH}, u AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges), k AS (SELECT src AS id, count(*) AS deg FROM u GROUP BY src), m AS (SELECT max(deg) AS most FROM k) SELECT src AS i, tgt AS j, CAST(-1 AS BIGINT) AS laplacian, round(1.0 / most, 12) AS walk FROM u CROSS JOIN m UNION ALL SELECT n.id, n.id, coalesce(deg, 0), round(1 - CAST(coalesce(deg, 0) AS DOUBLE) / most, 12) FROM neurons n LEFT JOIN k ON k.id = n.id CROSS JOIN m"
    q["c9_expanded_hierarchy"] = f"WITH {LABELS}, l1 AS (SELECT DISTINCT cluster, cluster DIV 4 AS up FROM labels_), l2 AS (SELECT DISTINCT up, up DIV 2 AS top FROM l1) SELECT neuron, CAST(labels_.cluster AS BIGINT) AS level0, CAST(l1.up AS BIGINT) AS level1, CAST(top AS BIGINT) AS level2 FROM labels_ JOIN l1 ON l1.cluster = labels_.cluster JOIN l2 ON l2.up = l1.up"
    q["c10_round_robin"] = f"WITH {GRAPH} SELECT id AS neuron, id % 64 AS core FROM neurons"
    q["c11_hyperedges"] = f"WITH {GRAPH}, {LABELS}, pins AS (SELECT tgt AS net, src AS pin FROM edges JOIN labels_ a ON a.neuron = src JOIN labels_ b ON b.neuron = tgt WHERE a.cluster = b.cluster UNION SELECT id, id FROM neurons) SELECT net, count(*) AS pins, CAST(sum(pin) AS BIGINT) AS pin_sum FROM pins GROUP BY net"
    # hardware from clusters
    q["h2_flat_rebuild"] = f"WITH {LABELS}, {TREE}, z AS (SELECT max(k) AS n, count(*) AS c FROM (SELECT cluster, count(*) AS k FROM labels_ GROUP BY cluster) s), r AS (SELECT CAST(ceil(avg(k)) AS BIGINT) AS r FROM (SELECT parent, count(*) AS k FROM tree WHERE parent >= 0 GROUP BY parent) t) SELECT CAST(max(n) AS BIGINT) AS n, max(r) AS r, CAST(min(l) AS BIGINT) AS l FROM z CROSS JOIN r CROSS JOIN {d.range(20, 'l')} x WHERE pow(r, l) >= c"
    q["h3_padding"] = f"WITH RECURSIVE {TREE}, ranked AS (SELECT cluster, parent, row_number() OVER (PARTITION BY parent ORDER BY cluster) - 1 AS k FROM tree), walk AS (SELECT cluster, CAST(0 AS BIGINT) AS core FROM ranked WHERE parent = -1 UNION ALL SELECT r.cluster, CAST(w.core * 3 + r.k AS BIGINT) FROM ranked r JOIN walk w ON r.parent = w.cluster) SELECT CAST(cluster AS BIGINT) AS cluster, core FROM walk WHERE cluster NOT IN (SELECT parent FROM tree)"
    q["h4_leaf_distance"] = f"WITH RECURSIVE {TREE}, up AS (SELECT cluster AS leaf, cluster AS at, 0 AS k FROM tree WHERE cluster NOT IN (SELECT parent FROM tree) UNION ALL SELECT leaf, t.parent, k + 1 FROM up JOIN tree t ON t.cluster = up.at WHERE t.parent >= 0) SELECT CAST(a.leaf AS BIGINT) AS a, CAST(b.leaf AS BIGINT) AS b, CAST(min(a.k) AS BIGINT) AS distance FROM up a JOIN up b ON a.at = b.at GROUP BY a.leaf, b.leaf"
    # estimators
    shell = "n0 * pow(b, h - 1) * (b - 1)"
    ph = "p0 * pow(2.0, -h)"
    q["q1_block_moments"] = f"WITH par AS (SELECT 60.0 AS n0, CAST(2 AS DOUBLE) AS b, CAST(0.3 AS DOUBLE) AS p0), s AS (SELECT par.*, h + 1 AS h FROM par CROSS JOIN {d.range(4, 'h')} x), v AS (SELECT 2 * (max(n0) - 1) * max(p0) + sum(2 * shell * ph) AS mean_degree, 2 * (max(n0) - 1) * max(p0) * (1 - max(p0)) + sum(2 * shell * ph * (1 - ph)) AS var_degree FROM (SELECT *, CAST({shell} AS DOUBLE) AS shell, CAST({ph} AS DOUBLE) AS ph FROM s) y) SELECT round(mean_degree, 8) AS mean_degree, round(var_degree, 8) AS var_degree FROM v"
    q["q3_spectral_threshold"] = f"WITH {GRAPH}, z AS (SELECT CAST((SELECT count(*) FROM edges) AS DOUBLE) / (SELECT count(*) FROM neurons) AS d, CAST((SELECT count(*) FROM neurons) AS DOUBLE) AS n) SELECT round(2 * sqrt(d * (1 - d / n)), 9) AS threshold FROM z"
    q["q5_tie_break"] = f"SELECT CAST(h AS BIGINT) AS h, round(100 * abs(pow(81.0, 1.0 / h) - round(pow(81.0, 1.0 / h))), 6) AS score FROM (SELECT h + 1 AS h FROM {d.range(6, 'h')} a) t"
    q["q6_levels_for_base"] = f"SELECT CAST(k AS BIGINT) AS blocks, CAST(greatest(1, round(ln(k) / ln(3))) AS BIGINT) AS h FROM (SELECT k + 1 AS k FROM {d.range(100, 'k')} a) t"
    # pipeline shapes
    q["x1_experiment_grid"] = "SELECT input_id, mapper, bundle FROM (VALUES ('ER_60n_p0.1'), ('Feasible_R=2_l=2_N=15_p=0.5_seed=42')) i(input_id) CROSS JOIN (VALUES ('Greedy'), ('QAP'), ('SA')) m(mapper) CROSS JOIN (VALUES ('relative'), ('raw')) b(bundle)"
    q["x4_against_baseline"] = f"WITH {RESULTS}, a AS (SELECT input_id, metric, mapper, avg(value) AS v FROM results GROUP BY input_id, metric, mapper), b AS (SELECT input_id, metric, v FROM a WHERE mapper = 'mapper0') SELECT a.input_id, a.metric, a.mapper, round(CASE WHEN a.metric = 'Hardware Size' THEN a.v / b.v ELSE a.v - b.v END, 9) AS relative FROM a JOIN b ON b.input_id = a.input_id AND b.metric = a.metric"
    q["x7_unpivot"] = f"WITH {RESULTS}, w AS (SELECT mapper, input_id, max(CASE WHEN metric = 'Inconsistencies' THEN value END) AS a, max(CASE WHEN metric = 'Hardware Size' THEN value END) AS b FROM results GROUP BY mapper, input_id) SELECT mapper, input_id, 'Inconsistencies' AS metric, a AS value FROM w UNION ALL SELECT mapper, input_id, 'Hardware Size', b FROM w"
    q["x8_pivot"] = f"WITH {RESULTS} SELECT mapper, input_id, coalesce(max(CASE WHEN metric = 'Hardware Size' THEN CAST(CAST(value AS BIGINT) AS STRING) END), '') AS hardware_size, coalesce(max(CASE WHEN metric = 'Inconsistencies' THEN CAST(CAST(value AS BIGINT) AS STRING) END), '') AS inconsistencies FROM results GROUP BY mapper, input_id"
    q["x9_report"] = f"WITH {RESULTS} SELECT input_id, mapper, coalesce(round(avg(CASE WHEN metric = 'Hardware Size' THEN value END), 2), -1.0) AS hardware_size, coalesce(round(avg(CASE WHEN metric = 'Inconsistencies' THEN value END), 2), -1.0) AS inconsistencies FROM results GROUP BY input_id, mapper"
    q["x10_bars"] = f"WITH {RESULTS} SELECT input_id, coalesce(max(CASE WHEN mapper = 'mapper0' THEN value END), 0) AS mapper0, coalesce(max(CASE WHEN mapper = 'mapper1' THEN value END), 0) AS mapper1, coalesce(max(CASE WHEN mapper = 'mapper2' THEN value END), 0) AS mapper2 FROM results GROUP BY input_id"
    q["x11_network_key"] = "SELECT network, count(*) AS k FROM (SELECT concat('brand:', p_brand, ', size:', CAST(p_size AS STRING)) AS network FROM part) t GROUP BY network"
    q["x13_distinct_hardware"] = f"SELECT DISTINCT CAST(i % 3 + 2 AS BIGINT) AS r, CAST(i % 2 + 1 AS BIGINT) AS l, concat('R', CAST(i % 3 + 2 AS STRING), '_L', CAST(i % 2 + 1 AS STRING)) AS hw FROM {d.range(60, 'i')} a"
    # faults, trees with neurons, times, orders
    q["p3_shape_violations"] = f"WITH {GRAPH}, k AS (SELECT count(*) FILTER (id % 7 = 3) + count(*) FILTER (id % 7 = 5) AS off, count(*) FILTER (id % 11 = 1) AS new, count(*) FILTER (id % 5 = 2) AS cut FROM neurons) SELECT 'neuron not placed once' AS rule, off AS violations FROM k UNION ALL SELECT 'placed neuron unknown', new FROM k UNION ALL SELECT 'slices not one a distance', cut FROM k UNION ALL SELECT 'null in placement', new FROM k UNION ALL SELECT 'null in slices', 0"
    q["g2_ground_truth"] = f"SELECT count(*) AS m, CAST(0 AS BIGINT) AS inconsistencies FROM ({q['g2_feasible_slices']}) e"
    q["j8_hierarchy_neurons"] = f"WITH {LABELS}, {TREE} SELECT CAST(t.cluster AS BIGINT) AS cluster, (SELECT count(*) FROM tree u WHERE u.parent = t.cluster) AS children, (SELECT count(*) FROM labels_ WHERE cluster % 4 = t.cluster) AS neurons, CAST((SELECT coalesce(sum(neuron), 0) FROM labels_ WHERE cluster % 4 = t.cluster) AS BIGINT) AS neuron_sum FROM tree t"
    q["a22_mean_times"] = f"WITH {RESULTS} SELECT mapper, round(avg(value), 9) AS seconds FROM results WHERE NOT failed AND metric = 'Hardware Size' GROUP BY mapper"
    q["w7_random_slices"] = f"WITH {GRAPH} SELECT id AS neuron, d AS distance, {d.uniform(42, 'id', 'd')} % CAST(least(pow(2, d), n) AS BIGINT) AS slice FROM neurons CROSS JOIN hw CROSS JOIN (SELECT range + 1 AS d FROM range(3)) r"
    q["w10_report_order"] = f"WITH {RESULTS}, m AS (SELECT input_id, mapper, round(avg(value) FILTER (metric = 'Hardware Size'), 2) AS h, round(avg(value) FILTER (metric = 'Inconsistencies'), 2) AS i FROM results GROUP BY ALL) SELECT row_number() OVER (ORDER BY input_id, mapper) - 1 AS line, mapper, input_id, coalesce(h, -1.0) AS hardware_size, coalesce(i, -1.0) AS inconsistencies FROM m"
    x = "FROM (SELECT neuron, cluster, row_number() OVER (PARTITION BY cluster ORDER BY neuron) - 1 AS x, count(*) OVER (PARTITION BY cluster) AS size FROM labels_)"
    q["h5_legacy_slices"] = f"WITH {GRAPH}, {LABELS}, y AS (SELECT * {x}), h AS (SELECT tgt, CAST(s.cluster <> t.cluster AS INT) + CAST(s.cluster DIV 5 <> t.cluster DIV 5 AS INT) AS d, s.x, s.size FROM edges JOIN y s ON s.neuron = src JOIN y t ON t.neuron = tgt), c AS (SELECT tgt, d, x * CAST(pow(2, d) AS BIGINT) DIV size AS k, count(*) AS hits FROM h WHERE d < 2 GROUP BY ALL), b AS (SELECT tgt, d, k FROM (SELECT *, row_number() OVER (PARTITION BY tgt, d ORDER BY hits DESC, k) AS r FROM c) WHERE r = 1) SELECT id AS neuron, range AS distance, CAST(coalesce(k, 0) AS BIGINT) AS slice FROM neurons CROSS JOIN range(2) LEFT JOIN b ON tgt = id AND d = range"
    q["x3_truth_run"] = "SELECT 'truth' AS mapper, metric, raw, relative FROM (VALUES ('Inconsistencies', 0.0::DOUBLE, 0.0::DOUBLE), ('Hardware Size', 60.0, 1.0), ('Inconsistencies (Fraction)', 0.0, 1.0)) v(metric, raw, relative)"
    rank = f"SELECT neuron, slot DIV 15 AS core, slot % 15 AS local FROM (SELECT range AS slot, row_number() OVER (ORDER BY {d.uniform(42, 'range')}, range) - 1 AS neuron FROM range(60))"
    nets = f"SELECT 'ER_60n_p0.1' AS input_id, * FROM ({q['g1_erdos_renyi']}) UNION ALL SELECT 'Feasible_R=2_l=2_N=15_p=0.5_seed=42', * FROM ({q['g2_feasible_slices']})"
    q["x3_random_run"] = f"WITH r AS ({rank}), e AS ({nets}), apart AS (SELECT input_id, tgt, s.local AS x, {m.distance_sql('s.core', 't.core')} AS dist FROM e JOIN r s ON s.neuron = src JOIN r t ON t.neuron = tgt), v AS (SELECT input_id, dist = 0 OR {m.slice_sql('dist', 'x')} = {d.uniform(42, 'tgt', 'dist')} % {m.slices_sql('dist')} AS valid FROM apart) SELECT input_id, 'Inconsistencies' AS metric, CAST(count_if(NOT valid) AS DOUBLE) AS raw FROM v GROUP BY input_id UNION ALL SELECT input_id, 'Valid Edges', CAST(count_if(valid) AS DOUBLE) FROM v GROUP BY input_id"
    q["x6_mean_over_networks"] = "SELECT mapper, input_id, 'Hardware Size' AS metric, 60.0::DOUBLE AS value FROM (VALUES ('truth'), ('greedy')) a(mapper) CROSS JOIN (VALUES ('ER_60n_p0.1'), ('Feasible_R=2_l=2_N=15_p=0.5_seed=42')) b(input_id)"
    q["x12_adjacency_points"] = f"WITH {PLACED}, o AS (SELECT neuron, row_number() OVER (ORDER BY core, local, neuron) - 1 AS place FROM place) SELECT a.place AS x, b.place AS y, CAST(distance AS BIGINT) AS distance, valid FROM valid JOIN o a ON a.neuron = src JOIN o b ON b.neuron = tgt"
    q["x12_cluster_circle"] = f"WITH {LABELS}, z AS (SELECT cluster, count(*) AS neurons FROM labels_ GROUP BY cluster), w AS (SELECT *, 2 * pi() * (sum(neurons) OVER (ORDER BY cluster) - neurons / 2.0) / sum(neurons) OVER () AS angle FROM z) SELECT CAST(cluster AS BIGINT) AS cluster, neurons, round(cos(angle), 9) AS x, round(sin(angle), 9) AS y FROM w"
    q["x12_routing_tree"] = "SELECT level, router, CASE WHEN level = 3 THEN -1 ELSE router DIV 4 END AS parent, router * pow(4, level) + (pow(4, level) - 1) / 2 AS x FROM (SELECT range AS level FROM range(4)) a JOIN (SELECT range AS router FROM range(64)) b ON router < pow(4, 3 - level)"
    q["x12_hardware_map"] = f"WITH {GRAPH} SELECT range AS core, range % 8 AS x, range DIV 8 AS y, (SELECT count(*) FROM place WHERE core = range) AS neurons, round(CAST((SELECT count(*) FROM place WHERE core = range) AS DOUBLE) / n, 9) AS share FROM range(64) CROSS JOIN hw"
    return {k: d.text(v) for k, v in q.items()}
