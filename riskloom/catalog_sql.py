"""Shared pieces of the SQL counterparts: event features, clusters, neighbours, leaves."""

from __future__ import annotations

from riskloom.functions.scalars import DIMS, MCC_RISK

CENTROID_STEP, CENTROIDS = 151, 64
SAFE_A, SAFE_B, MIN_OBS = 900, 700, 50
TREE_FEATS = [9, 10, 0, 8, 2, 7, 3, 5, 12, 4, 13, 1, 6, 0, 2]
TREE_THRESHOLDS = [5000, 5000, 250, 500, 500, 300, 5000, 100, 3000, 5000, 200, 5000, 100, 100, 1000]


def clamp(x: str) -> str:
    return f"least(greatest({x}, 0::FLOAT), 1::FLOAT)"


def ratio(a: str, b: str) -> str:
    return f"CAST(CAST({a} AS FLOAT) / CAST({b} AS FLOAT) AS FLOAT)"


def code(x: str) -> str:
    scaled = f"least(greatest(CAST(CAST({x} AS FLOAT) * 10000::FLOAT AS FLOAT), -10000::FLOAT), 10000::FLOAT)::DOUBLE"
    return f"CAST(CASE WHEN {scaled} >= 0 THEN floor({scaled} + 0.5) ELSE ceil({scaled} - 0.5) END AS INTEGER)"


def distance(a: str, b: str, dims: int = DIMS) -> str:
    return "CAST(" + " + ".join(f"({a}.q{i}::BIGINT - {b}.q{i}) * ({a}.q{i}::BIGINT - {b}.q{i})" for i in range(dims)) + " AS BIGINT)"


def wide_distance(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, 65), lambda i: ({a}.q[i] - {b}.q[i]) * ({a}.q[i] - {b}.q[i]))) AS BIGINT)"


MCC_CASE = "CASE {0} " + " ".join(f"WHEN {i} THEN {r}::FLOAT" for i, r in enumerate(MCC_RISK.values())) + " ELSE 0.5::FLOAT END"
_KEYED = [MCC_RISK[c] for c in ("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311")]
RISK = "CASE k % 11 " + " ".join(f"WHEN {i} THEN {r}::FLOAT" for i, r in enumerate(_KEYED)) + " ELSE 0.5::FLOAT END"
_AVERAGE = "CASE WHEN pn > 0 AND CAST(pc / pn / 100 AS FLOAT) <> 0 THEN pc / pn / 100 ELSE 1 END"
_FEATURES = [
    clamp(ratio("value", "10000")),
    clamp(ratio("event_id % 12 + 1", "12")),
    clamp(ratio(ratio("value", _AVERAGE), "10")),
    ratio("hour(ts)", "23"),
    ratio("isodow(ts) - 1", "6"),
    f"CASE WHEN last_sec IS NULL THEN -1::FLOAT ELSE {clamp(ratio(f'greatest({ratio("sec - last_sec", "60")}, 0::FLOAT)', '1440'))} END",
    f"CASE WHEN last_sec IS NULL THEN -1::FLOAT ELSE {clamp(ratio('abs(k - last_k) * 10', '1000'))} END",
    clamp(ratio("k * 10", "1000")),
    clamp(ratio("n24", "20")),
    "CAST(event_type IN ('view', 'click') AS INTEGER)::FLOAT",
    "CAST(event_type = 'purchase' AS INTEGER)::FLOAT",
    "CASE WHEN seen THEN 0::FLOAT ELSE 1::FLOAT END",
    RISK,
    clamp(ratio("merchant_avg", "10000")),
]
#: hist: events with the user's past; ev: their codes.
EV = f"""e AS (
    SELECT event_id, user_id, event_type, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CAST(round(value * 100) AS BIGINT) AS cents, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
m AS (SELECT k, sum(cents) / count(*) / 100 AS merchant_avg FROM e GROUP BY k),
hist AS (
    SELECT e.*, merchant_avg,
           sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
           count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn,
           count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS n24,
           lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_sec,
           lag(e.k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_k,
           row_number() OVER (PARTITION BY user_id, e.k ORDER BY ts, event_id) > 1 AS seen
    FROM e JOIN m ON e.k = m.k),
ev AS MATERIALIZED (SELECT event_id AS vec_id, CAST(event_type = 'error' AS INTEGER) AS label, {", ".join(f"{code(x)} AS q{i}" for i, x in enumerate(_FEATURES))} FROM hist)"""
Q_LIST = ", ".join(f"q{i}" for i in range(DIMS))
EMB = f"emb AS (SELECT vec_id, CAST(label % 2 AS INTEGER) AS label, list_transform(embedding, lambda x: CAST({code('x')} AS BIGINT)) AS q FROM embeddings)"

ASSIGNED = f"""{EV},
c AS (SELECT CAST(vec_id // {CENTROID_STEP} AS INTEGER) AS cluster_id, {Q_LIST} FROM ev WHERE vec_id % {CENTROID_STEP} = 0 AND vec_id < {CENTROID_STEP * CENTROIDS}),
assigned AS MATERIALIZED (
    SELECT ev.*, cluster_id, {distance("ev", "c")} AS cdist FROM ev, c
    QUALIFY row_number() OVER (PARTITION BY ev.vec_id ORDER BY {distance("ev", "c")}, cluster_id) = 1)"""
_LB = "CAST(" + " + ".join(f"greatest(lo{i} - x.q{i}, x.q{i} - hi{i}, 0)::BIGINT * greatest(lo{i} - x.q{i}, x.q{i} - hi{i}, 0)::BIGINT" for i in range(DIMS)) + " AS BIGINT)"
PAIRS = f"""{ASSIGNED},
box AS (SELECT cluster_id, {", ".join(f"min(q{i}) AS lo{i}, max(q{i}) AS hi{i}" for i in range(DIMS))} FROM assigned GROUP BY cluster_id),
pairs AS MATERIALIZED (
    SELECT x.vec_id AS query_id, c.cluster_id, {distance("x", "c")} AS cdist, {_LB} AS lb
    FROM ev x, c JOIN box ON c.cluster_id = box.cluster_id WHERE x.vec_id % 20 = 0),
turns AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cdist, cluster_id) - 1 AS INTEGER) AS turn FROM pairs)"""
FIRST = f"""{PAIRS},
near1 AS MATERIALIZED (
    SELECT t.query_id, a.vec_id, a.label, {distance("x", "a")} AS dist
    FROM turns t JOIN assigned a ON a.cluster_id = t.cluster_id JOIN ev x ON x.vec_id = t.query_id WHERE turn = 0 AND a.vec_id <> t.query_id
    QUALIFY row_number() OVER (PARTITION BY t.query_id ORDER BY {distance("x", "a")}, a.vec_id) <= 5),
bound AS MATERIALIZED (SELECT query_id, count(*) AS n_found, CASE WHEN count(*) >= 5 THEN max(dist) END AS worst, sum(label) AS n FROM near1 GROUP BY query_id)"""

#: The bound alone, as an aggregate of the first cluster's distances.
BOUND = f"""{PAIRS},
bound AS MATERIALIZED (
    SELECT t.query_id, CASE WHEN count(*) >= 5 THEN min({distance("x", "a")}, 5)[5] END AS worst
    FROM turns t JOIN assigned a ON a.cluster_id = t.cluster_id JOIN ev x ON x.vec_id = t.query_id WHERE turn = 0 AND a.vec_id <> t.query_id GROUP BY t.query_id)"""


def _near(vectors: str, queries: str, d: str) -> str:
    return f"""cand AS (SELECT x.vec_id AS query_id, y.vec_id, {d} AS dist, y.label FROM {vectors} x JOIN {vectors} y ON x.vec_id <> y.vec_id WHERE {queries}),
nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INTEGER) AS rank FROM cand QUALIFY rank <= 5)"""


NEAR = f"{EV},\n{_near('ev', 'x.vec_id % 20 = 0', distance('x', 'y'))}"
WIDE_NEAR = f"{EMB},\n{_near('emb', 'x.vec_id % 10 = 0', wide_distance('x', 'y'))}"
#: Requests carry one category for all merchants, so their queries have its risk.
NEAR_5411 = f"""{EV.replace("e AS (", "e0 AS (", 1).replace("FROM e GROUP", "FROM e0 GROUP").replace("SELECT e.*", "SELECT e0.*").replace("lag(e.k)", "lag(e0.k)").replace("user_id, e.k", "user_id, e0.k").replace("FROM e JOIN m ON e.k", "FROM e0 JOIN m ON e0.k")},
e AS (SELECT event_id FROM events WHERE event_id % 20 = 0),
rq AS (SELECT vec_id, {", ".join(f"q{i}" if i != 12 else "1500 AS q12" for i in range(DIMS))} FROM ev WHERE vec_id IN (SELECT event_id FROM e) AND vec_id % 11 <> 5),
cand AS (SELECT x.vec_id AS query_id, y.vec_id, {distance("x", "y")} AS dist, y.label FROM rq x JOIN ev y ON x.vec_id <> y.vec_id),
votes AS (SELECT query_id, CAST(sum(label) AS INTEGER) AS n FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= 5) GROUP BY query_id)"""


_BEST = "list({'dist': dist, 'vec_id': vec_id, 'label': label} ORDER BY dist, vec_id)"
_FRAUDS = "coalesce(list_sum(list_transform({0}, lambda b: b.label)), 0)"
_WORST = "CASE WHEN len({0}) >= 5 THEN {0}[5].dist ELSE 9223372036854775807 END"


def cascade(queries: str, early: int) -> str:
    """Common tables up to answers (query_id, n): the staged search of the queries (a condition on x) as a recursion over probes."""
    worst, frauds = _WORST.format, _FRAUDS.format
    return f"""{PAIRS.replace("x.vec_id % 20 = 0", queries)},
each AS MATERIALIZED (
    SELECT t.query_id, t.turn, a.vec_id, CAST(a.label AS BIGINT) AS label, {distance("x", "a")} AS dist
    FROM turns t JOIN assigned a ON a.cluster_id = t.cluster_id JOIN ev x ON x.vec_id = t.query_id WHERE a.vec_id <> t.query_id
    QUALIFY row_number() OVER (PARTITION BY t.query_id, t.turn ORDER BY {distance("x", "a")}, a.vec_id) <= 5),
near AS MATERIALIZED (SELECT query_id, turn, {_BEST} AS near FROM each GROUP BY query_id, turn),
steps AS MATERIALIZED (SELECT t.query_id, t.turn, t.lb, coalesce(near, []) AS near FROM turns t LEFT JOIN near n ON t.query_id = n.query_id AND t.turn = n.turn),
fold AS (
    SELECT query_id, turn, near AS best, {frauds("near")} = 5 AND {worst("near")} <= {early} AS exited, {frauds("near")} = 5 AND {worst("near")} <= {early} AS stopped
    FROM steps WHERE turn = 0
    UNION ALL
    SELECT query_id, turn, CASE WHEN skip THEN best ELSE merged END, exited, CASE WHEN skip THEN stopped ELSE {worst("merged")} <= {early} AND {frauds("merged")} IN (0, 5) END
    FROM (SELECT f.query_id, s.turn, f.best, f.exited, f.stopped, f.stopped OR s.lb >= {worst("f.best")} AS skip, list_sort(list_concat(f.best, s.near))[1:5] AS merged
          FROM fold f JOIN steps s ON s.query_id = f.query_id AND s.turn = f.turn + 1 WHERE s.turn < 33)),
folded AS MATERIALIZED (SELECT * FROM fold QUALIFY turn = max(turn) OVER (PARTITION BY query_id)),
more AS (
    SELECT f.query_id, unnest(s.near) AS b FROM folded f JOIN steps s ON s.query_id = f.query_id
    WHERE s.turn >= 33 AND NOT f.exited AND {frauds("f.best")} < 5 AND s.lb < {worst("f.best")}
    UNION ALL SELECT query_id, unnest(best) FROM folded),
answers AS (
    SELECT query_id, CAST(sum(b.label) AS INTEGER) AS n
    FROM (SELECT * FROM more QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b.dist, b.vec_id) <= 5) GROUP BY query_id)"""


def tree_rows() -> list[tuple[int, int, int, int, int]]:
    n = len(TREE_FEATS)
    child = lambda c: c if c < n else -1 - (c - n)
    return [(i, TREE_FEATS[i], TREE_THRESHOLDS[i], child(2 * i + 1), child(2 * i + 2)) for i in range(n)]


def _case(i: int, feats: list[int] = TREE_FEATS, thresholds: list[int] = TREE_THRESHOLDS) -> str:
    n = len(feats)
    if i >= n:
        return str(i - n)
    return f"CASE WHEN q{feats[i]} <= {thresholds[i]} THEN {_case(2 * i + 1, feats, thresholds)} ELSE {_case(2 * i + 2, feats, thresholds)} END"


#: 511 splits in heap order, by a rule.
LARGE_TREE = ([(5 * i + 3) % DIMS for i in range(511)], [(i * 37 % 97) * 100 for i in range(511)])


def large_leaf() -> str:
    return f"CAST({_case(0, *LARGE_TREE)} AS INTEGER)"


LEAF = f"CAST({_case(0)} AS INTEGER)"
LEAF_TABLES = f"""t AS (SELECT {LEAF} AS leaf_id, label * 5 AS n, vec_id % 256 AS part FROM ev),
tc AS (SELECT leaf_id, n, count(*) AS c FROM t GROUP BY leaf_id, n),
tp AS (SELECT leaf_id, count(DISTINCT part) AS n_parts FROM t GROUP BY leaf_id),
leaves AS (
    SELECT tc.leaf_id, CAST(arg_max(n, c * 10 - n) AS INTEGER) AS count, CAST(floor(max(c) * 1000 / sum(c)) AS INTEGER) AS purity_milli, CAST(min(n_parts) AS INTEGER) AS n_parts
    FROM tc JOIN tp ON tc.leaf_id = tp.leaf_id GROUP BY tc.leaf_id)"""
LEAVES = f"{EV},\n{LEAF_TABLES}"
SCORED = f"""{LEAVES},
{_near("ev", "x.vec_id % 20 = 0", distance("x", "y"))},
v AS (SELECT query_id, CAST(sum(label) AS INTEGER) AS n FROM nn GROUP BY query_id),
placed AS (SELECT vec_id AS query_id, {LEAF} AS leaf_id, label = 0 AS expected_approved FROM ev WHERE vec_id % 20 = 0),
scored AS (SELECT placed.*, v.n, l.count AS tree_n, l.purity_milli FROM placed JOIN v ON placed.query_id = v.query_id JOIN leaves l ON placed.leaf_id = l.leaf_id)"""
JUDGED = f"""{SCORED},
s AS (SELECT leaf_id, count(*) AS n_obs, count(DISTINCT n) AS n_knn, count(DISTINCT tree_n) AS n_tree, min(n) AS knn_n, min(tree_n) AS tree_n, min(purity_milli) AS purity_milli FROM scored GROUP BY leaf_id),
judged AS (
    SELECT i.leaf_id, n_obs, n_knn, knn_n, purity_milli,
           CASE WHEN n_obs IS NULL THEN 'unseen' WHEN n_obs < {MIN_OBS} THEN 'min_obs' WHEN n_knn <> 1 THEN 'mixed'
                WHEN n_tree <> 1 OR tree_n <> knn_n THEN 'tree_mismatch' END AS reason
    FROM (SELECT CAST(range AS INTEGER) AS leaf_id FROM range({len(TREE_FEATS) + 1})) i LEFT JOIN s ON i.leaf_id = s.leaf_id)"""
