"""The catalogue's queries in plain SQL, over the driver's tables: what their results are held against."""

from __future__ import annotations

import struct

AREAS = {
    "one": (0.0, 20.0, 1704067200, 60.0, 80.0, 1705500000),
    "two": (10.0, 0.0, 1704500000, 90.0, 60.0, 1706600000),
    "all": (0.0, 0.0, 0, 500.0, 99.0, 4294967295),
    "center": (30.0, 30.0, 1704400000, 50.0, 50.0, 1706000000),
}
FLAGSHIP = [(AREAS["one"], ["click", "view"]), (AREAS["two"], ["purchase", "view"]), (AREAS["all"], ["error"])]
TWO = [(AREAS["one"], ["click"]), (AREAS["two"], ["view"])]
FOUR = [(AREAS["one"], ["view"]), (AREAS["two"], []), (AREAS["two"], []), (AREAS["all"], ["purchase"])]

POINTS = """pts AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(value AS FLOAT) AS x,
  CAST(json_extract_string(props, '$.k') AS FLOAT) AS y FROM events)"""
LABELS = """labels_ AS (SELECT name, CAST(row_number() OVER (ORDER BY t, event_id) AS BIGINT) AS label_id FROM
  (SELECT event_type AS name, t, event_id, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS r FROM pts WHERE event_type IS NOT NULL) WHERE r = 1)"""
UNITS_ = f"""{POINTS}, {LABELS},
seg AS (SELECT user_id AS trajectory_id, CAST(row_number() OVER w - 1 AS BIGINT) AS unit_index, x AS x0, y AS y0, t AS t0,
  lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(t) OVER w AS t1, lead(event_type) OVER w AS name
  FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
units AS (SELECT trajectory_id, unit_index, x0, y0, t0, x1, y1, t1, label_id FROM seg LEFT JOIN labels_ USING (name) WHERE t1 IS NOT NULL)"""
U = f"WITH {UNITS_}"
D = "trajectory_id, unit_index, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, t0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, t1, label_id"
MBB = ", ".join(f"least({a}0, {a}1) AS {{p}}{a}min" for a in "xyt") + ", " + ", ".join(f"greatest({a}0, {a}1) AS {{p}}{a}max" for a in "xyt")


def f32(v: float) -> float:
    return struct.unpack("<f", struct.pack("<f", v))[0]


def hit(box: tuple) -> str:
    lo, hi = dict(zip("xyt", box[:3], strict=True)), dict(zip("xyt", box[3:], strict=True))
    near, far, mbb = [], [], []
    for a in "xyt":
        low, high = f"CAST({f32(lo[a]) if a != 't' else lo[a]!r} AS DOUBLE)", f"CAST({f32(hi[a]) if a != 't' else hi[a]!r} AS DOUBLE)"
        p, q = f"CAST({a}0 AS DOUBLE)", f"CAST({a}1 AS DOUBLE)"
        inside = f"{p} BETWEEN {low} AND {high}"
        one, two = f"({low} - {p}) / ({q} - {p})", f"({high} - {p}) / ({q} - {p})"
        near.append(f"CASE WHEN {p} = {q} THEN CASE WHEN {inside} THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END ELSE least({one}, {two}) END")
        far.append(f"CASE WHEN {p} = {q} THEN CASE WHEN {inside} THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END ELSE greatest({one}, {two}) END")
        mbb.append(f"least({p}, {q}) <= {high} AND greatest({p}, {q}) >= {low}")
    return f"({' AND '.join(mbb)} AND greatest(CAST(0 AS DOUBLE), {', '.join(near)}) <= least(CAST(1 AS DOUBLE), {', '.join(far)}))"


def mbb_hit(box: tuple) -> str:
    lo, hi = dict(zip("xyt", box[:3], strict=True)), dict(zip("xyt", box[3:], strict=True))
    return " AND ".join(f"least({a}0, {a}1) <= {hi[a]} AND greatest({a}0, {a}1) >= {lo[a]}" for a in "xyt")


def predicate(step: tuple) -> str:
    box, names = step
    text = hit(box)
    if names:
        text += f" AND label_id IN (SELECT label_id FROM labels_ WHERE name IN ({', '.join(repr(n) for n in names)}))"
    return text


def sequence(spec: list, tail: str | None = None) -> str:
    n = len(spec)
    flags = ", ".join(f"coalesce({predicate(s)}, false) AS f{i}" for i, s in enumerate(spec))
    lists = ", ".join(f"list(unit_index) FILTER (WHERE f{i}) AS s{i}" for i in range(n))
    marks, froms = "g0 AS (SELECT trajectory_id, " + ", ".join(f"s{i}" for i in range(n)) + ", list_min(s0) AS m0 FROM grp)", "g0"
    for i in range(1, n):
        marks += f", g{i} AS (SELECT *, list_min(list_filter(s{i}, lambda u: u >= m{i - 1})) AS m{i} FROM {froms})"
        froms = f"g{i}"
    conds = [f"(f{i} AND unit_index >= m{i}" + (f" AND unit_index < m{i + 1})" if i < n - 1 else ")") for i in range(n)]
    step = "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(conds)) + " END"
    head = f"{U}, fl AS (SELECT *, {flags} FROM units), grp AS (SELECT trajectory_id, {lists} FROM fl GROUP BY trajectory_id), {marks}, res AS (SELECT {D}, CAST({step} AS INTEGER) AS step FROM fl JOIN {froms} USING (trajectory_id) WHERE m{n - 1} IS NOT NULL AND ({' OR '.join(conds)}))"
    return f"{head} {tail or 'SELECT * FROM res'}"


CENTER = "CAST(CAST(x0 + x1 AS DOUBLE) / CAST(2 AS DOUBLE) AS FLOAT) AS xc, CAST(CAST(y0 + y1 AS DOUBLE) / CAST(2 AS DOUBLE) AS FLOAT) AS yc, (t0 + t1) // 2 AS tc"


def str_ctes(dims: list[str], leaf: int = 113) -> str:
    out = f"{UNITS_}, z0 AS (SELECT *, {CENTER} FROM units)"
    slabs: list[str] = []
    for k, dim in enumerate(dims):
        part = f"PARTITION BY {', '.join(slabs)}" if slabs else ""
        left = len(dims) - k
        rn = f"row_number() OVER ({part} ORDER BY {dim}, trajectory_id, unit_index) - 1"
        if left == 1:
            order = ", ".join([*slabs, dim, "trajectory_id", "unit_index"])
            return out + f", laid AS (SELECT trajectory_id, unit_index, x0, y0, t0, x1, y1, t1, label_id, CAST((row_number() OVER (ORDER BY {order}) - 1) // {leaf} AS BIGINT) AS leaf_id FROM z{k})"
        size = f"({leaf} * greatest(1, CAST(ceil(round(pow(ceil(n / {leaf}.0), CAST({left - 1} AS DOUBLE) / {left}), 9)) AS BIGINT)))"
        out += f", n{k} AS (SELECT *, {rn} AS rn, count(*) OVER ({part}) AS n FROM z{k}), z{k + 1} AS (SELECT * EXCLUDE (rn, n), CAST(rn // {size} AS BIGINT) AS slab{k} FROM n{k})"
        slabs.append(f"slab{k}")
    return out


ORDERS = {"plain": ["xc", "yc", "tc"], "lf": ["label_id", "xc", "yc", "tc"], "ll": ["xc", "yc", "tc", "label_id"]}
LAID = str_ctes(ORDERS["lf"])
BOXES = f"{LAID}, boxes AS (SELECT leaf_id AS node_id, count(*) AS n_entries, " + ", ".join(f"min(least({a}0, {a}1)) AS {a}min" for a in "xyt") + ", " + ", ".join(f"max(greatest({a}0, {a}1)) AS {a}max" for a in "xyt") + " FROM laid GROUP BY leaf_id)"
POSTS = f"""{LAID}, posts AS (SELECT leaf_id AS node_id, label_id, count(*) AS unit_count, list_sort(list(DISTINCT trajectory_id)) AS ids FROM laid GROUP BY leaf_id, label_id
  UNION ALL SELECT leaf_id, CAST(-1 AS BIGINT), count(*), list_sort(list(DISTINCT trajectory_id)) FROM laid GROUP BY leaf_id)"""
BOX_D = ", ".join(f"CAST({a}{m} AS DOUBLE) AS {a}{m}" if a != "t" else f"t{m}" for m in ("min", "max") for a in "xyt")
VOLUME = "CAST({p}xmax - {p}xmin AS DOUBLE) * CAST({p}ymax - {p}ymin AS DOUBLE) * CAST({p}tmax - {p}tmin AS DOUBLE)"
ACTS = f"""{POINTS}, acts AS (SELECT user_id AS u, event_id AS line, t AS b, t + 7200 * (event_id % 9) AS e, 'trip' || CAST(event_id % 4 AS VARCHAR) AS name FROM pts WHERE event_type = 'click'),
lab AS (SELECT user_id AS trajectory_id, event_id, t, x, y, name FROM (SELECT p.*, a.name, row_number() OVER (PARTITION BY event_id ORDER BY b, line) AS r
  FROM pts p LEFT JOIN acts a ON a.u = p.user_id AND p.t BETWEEN a.b AND a.e WHERE event_type <> 'click') WHERE r = 1)"""
SPANS = "spans AS (SELECT c_mktsegment AS k, c_custkey * 2 AS b, c_custkey * 2 + c_nationkey % 2 AS e FROM customer)"
IDS = "sets AS (SELECT DISTINCT label_id AS k, trajectory_id AS b, trajectory_id AS e FROM units)"


def trimmed(table: str, capacity: int) -> str:
    return f"""tg AS (SELECT *, b - lag(e) OVER (PARTITION BY k ORDER BY b) AS gap FROM {table}),
tr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap DESC NULLS LAST, b) AS r FROM tg),
tp AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND r <= {capacity - 1} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY b) AS part FROM tr)"""


def descent(level: int, nodes: str, under: str) -> str:
    """Costs of a level's nodes for the probes that reach their parents: pN, and the chosen ones: cN."""
    grown = " * ".join(f"CAST(greatest(u_{a}max, {a}max) - least(u_{a}min, {a}min) AS DOUBLE)" for a in "xyt")
    return f"""kid{level} AS ({nodes}), h{level} AS (SELECT leaf_id // {16**level} AS node_id, label_id, count(*) AS c FROM laid GROUP BY ALL), o{level} AS (SELECT node_id, sum(c) AS total FROM h{level} GROUP BY 1),
e{level} AS (SELECT p.trajectory_id, p.label_id, n.node_id, {VOLUME.format(p='n.')} AS size, {grown} - {VOLUME.format(p='n.')} AS enl FROM probe p JOIN kid{level} n ON {under}),
p{level} AS (SELECT e.trajectory_id, CAST({level} AS INTEGER) AS level, e.node_id, size, enl * CASE WHEN max(enl) OVER w <= 1.1102230246251565e-16 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / max(enl) OVER w END AS spatial,
  CASE WHEN h.c IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - CAST(1 + h.c AS DOUBLE) / CAST(1 + o.total AS DOUBLE) END AS textual
  FROM e{level} e JOIN o{level} o USING (node_id) LEFT JOIN h{level} h ON h.node_id = e.node_id AND h.label_id = e.label_id WINDOW w AS (PARTITION BY e.trajectory_id)),
c{level} AS (SELECT trajectory_id, level, node_id FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY 0.5::DOUBLE * spatial + 0.5::DOUBLE * textual, size, node_id) AS r FROM p{level}) WHERE r = 1)"""


#: Two levels are all of a tree of up to 256 leaves; with 16 leaves or fewer the root's children are the leaves.
_UPPER = "SELECT node_id // 16 AS node_id, " + ", ".join(f"{m}({a}{m}) AS {a}{m}" for m in ("min", "max") for a in "xyt") + " FROM boxes WHERE (SELECT max(node_id) FROM boxes) >= 16 GROUP BY 1"
DESCENT = f"""{BOXES}, probe AS (SELECT trajectory_id, label_id, {MBB.format(p='u_')} FROM units WHERE unit_index = 0),
{descent(1, _UPPER, "true")}, {descent(0, "SELECT * FROM boxes", "n.node_id // 16 = coalesce((SELECT c1.node_id FROM c1 WHERE c1.trajectory_id = p.trajectory_id), 0)")}, p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p0)"""


def windows(spec: list) -> str:
    rows = []
    for i, (box, names) in enumerate(spec):
        lo, hi = dict(zip("xyt", box[:3], strict=True)), dict(zip("xyt", box[3:], strict=True))
        meet = " AND ".join(f"{a}min <= {hi[a]} AND {a}max >= {lo[a]}" for a in "xyt")
        listed = ", ".join(repr(n) for n in names)
        rows.append(f"SELECT {i} AS step, node_id, tmin, tmax FROM boxes WHERE {meet} AND node_id IN (SELECT leaf_id FROM laid JOIN labels_ USING (label_id) WHERE name IN ({listed}))")
    return f"cand AS ({' UNION ALL '.join(rows)}), win AS (SELECT step, min(tmin) AS a, max(tmax) AS b FROM cand GROUP BY step)"


def shared(spec: list) -> str:
    rows = " UNION ALL ".join(f"SELECT DISTINCT {i} AS step, trajectory_id FROM laid JOIN labels_ USING (label_id) WHERE name IN ({', '.join(repr(n) for n in names)}) AND leaf_id IN (SELECT node_id FROM cand WHERE step = {i})" for i, (_, names) in enumerate(spec))
    return f"SELECT trajectory_id FROM ({rows}) GROUP BY trajectory_id HAVING count(DISTINCT step) = {len(spec)}"


FMT = "'(' || printf('%.5f', CAST(x{i} AS DOUBLE)) || ', ' || printf('%.5f', CAST(y{i} AS DOUBLE)) || ', ' || t{i} || ')'"
COUNTS = "SELECT count(DISTINCT trajectory_id) AS trajectories, count(*) AS units FROM res"
RECT = "rect AS (SELECT DISTINCT CAST(p_size % 7 AS BIGINT) AS k, p_partkey % 97 AS x0, p_partkey % 89 AS y0, p_partkey % 97 + p_size % 11 AS x1, p_partkey % 89 + p_size % 13 AS y1 FROM part)"

ORACLE_SQL: dict[str, str] = {
    "units_from_events": f"{U} SELECT {D} FROM units",
    "units_from_orders": """WITH p AS (SELECT o_custkey, o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t, CAST(o_totalprice AS FLOAT) AS x, CAST(substr(o_orderpriority, 1, 1) AS FLOAT) AS y, o_orderstatus AS name FROM orders),
l AS (SELECT name, CAST(row_number() OVER (ORDER BY t, o_orderkey) AS BIGINT) AS label_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t, o_orderkey) AS r FROM p) WHERE r = 1),
s AS (SELECT o_custkey AS trajectory_id, CAST(row_number() OVER w - 1 AS BIGINT) AS unit_index, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, t AS t0, CAST(lead(x) OVER w AS DOUBLE) AS x1, CAST(lead(y) OVER w AS DOUBLE) AS y1, lead(t) OVER w AS t1, lead(name) OVER w AS name FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY t, o_orderkey))
SELECT s.* EXCLUDE (name), label_id FROM s JOIN l USING (name) WHERE t1 IS NOT NULL""",
    "label_dictionary": f"WITH {POINTS}, {LABELS} SELECT label_id, name FROM labels_",
    "dictionary_extend": f"WITH {POINTS}, {LABELS} SELECT label_id, name FROM labels_ UNION ALL SELECT (SELECT max(label_id) FROM labels_) + row_number() OVER (ORDER BY k), name FROM (SELECT o_orderpriority AS name, min(o_orderkey) AS k FROM orders GROUP BY 1)",
    "dictionary_json": f"WITH {POINTS}, {LABELS} SELECT '{{' || string_agg('\"' || name || '\":' || label_id, ',' ORDER BY label_id) || '}}' AS json FROM labels_",
    "unit_geometry": f"{U}, m AS (SELECT *, {MBB.format(p='')}, {CENTER} FROM units) SELECT trajectory_id, unit_index, {BOX_D}, CAST(xc AS DOUBLE) AS xc, CAST(yc AS DOUBLE) AS yc, tc, {VOLUME.format(p='')} AS volume, (xmax - xmin = 0 OR ymax - ymin = 0 OR tmax - tmin = 0) AS is_empty FROM m",
    "box_extend_intersect": f"{U}, m AS (SELECT trajectory_id, unit_index, {MBB.format(p='a_')} FROM units), p AS (SELECT *, "
    + ", ".join(f"lead(a_{a}{m}) OVER w AS b_{a}{m}" for m in ("min", "max") for a in "xyt")
    + " FROM m WINDOW w AS (PARTITION BY trajectory_id ORDER BY unit_index)), q AS (SELECT *, "
    + " AND ".join(f"a_{a}min <= b_{a}max AND b_{a}min <= a_{a}max" for a in "xyt")
    + " AS meet, "
    + " AND ".join(f"a_{a}min <= b_{a}min AND b_{a}max <= a_{a}max" for a in "xyt")
    + " AS holds FROM p WHERE b_tmin IS NOT NULL) SELECT trajectory_id, unit_index, meet, holds, "
    + ", ".join(f"CAST({g}(a_{a}{m}, b_{a}{m}) AS {'BIGINT' if a == 't' else 'DOUBLE'}) AS u_{a}{m}" for m, g in (("min", "least"), ("max", "greatest")) for a in "xyt")
    + ", "
    + ", ".join(f"CAST(CASE WHEN meet THEN {g}(a_{a}{m}, b_{a}{m}) ELSE 0 END AS {'BIGINT' if a == 't' else 'DOUBLE'}) AS i_{a}{m}" for m, g in (("min", "greatest"), ("max", "least")) for a in "xyt")
    + " FROM q",
    "simple_box_label": f"{U} SELECT {D} FROM units WHERE {predicate(FLAGSHIP[0])}",
    "simple_box_any": f"{U} SELECT {D} FROM units WHERE {hit(AREAS['center'])}",
    "mbb_vs_exact": f"{U}, h AS (SELECT {hit(AREAS['center'])} AS hit FROM units WHERE {mbb_hit(AREAS['center'])}) SELECT count(*) AS by_box, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS false_positive FROM h",
    "interval_predicates": f"{U} SELECT trajectory_id, unit_index, t0 BETWEEN 1704500000 AND 1705500000 AS has_begin, t1 >= 1704500000 AND t0 <= 1705500000 AS overlaps, CAST(greatest(1704500000 - t0, t0 - 1705500000, 0) AS BIGINT) AS distance FROM units",
    "scalar_helpers": """SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) < 2.220446049250313e-16 THEN CAST(0 AS DOUBLE) ELSE l_quantity / l_discount END AS div0, CASE WHEN l_discount <= 1.1102230246251565e-16 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / l_discount END AS inverse,
greatest(1, CAST(floor(l_discount * 50) AS BIGINT)) AS seconds, coalesce(nullif(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END, ''), nullif(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END, ''), 'N/A') AS label FROM lineitem""",
    "sequenced_2": sequence(TWO),
    "sequenced_3": sequence(FLAGSHIP),
    "sequenced_4": sequence(FOUR),
    "sequenced_3_by_joins": sequence(FLAGSHIP),
    "sequenced_3_any": sequence(FLAGSHIP),
    "index_build": f"""WITH RECURSIVE {LAID}, lv AS (SELECT 0 AS k, count(DISTINCT leaf_id) AS n, count(*) AS e FROM laid UNION ALL SELECT k + 1, CAST(ceil(n / 16.0) AS BIGINT), n FROM lv WHERE n > 1) SELECT CAST(k AS INTEGER) AS level, n AS nodes, e AS entries FROM lv""",
    "sequenced_empty": sequence([FLAGSHIP[0], ((0, 0, 0, 0, 0, 1), ["error"])]),
    "pruned_equals_full": sequence(FLAGSHIP),
    "pruned_hilbert": sequence(FLAGSHIP),
    "pruned_interval_ids": sequence(FLAGSHIP),
    "sequenced_counts": sequence(FLAGSHIP, COUNTS),
    "selectivity_report": " UNION ALL ".join(f"SELECT '{n}' AS query, * FROM ({sequence(s, COUNTS)})" for n, s in (("two", TWO), ("three", FLAGSHIP), ("four", FOUR))),
    "match_text": sequence(FLAGSHIP, f"SELECT trajectory_id, unit_index, unit_index || ': ' || {FMT.format(i=0)} || ' -> ' || {FMT.format(i=1)} || ', label ' || label_id AS line FROM res"),
    "activity_join": f"WITH {ACTS} SELECT trajectory_id, event_id, t, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, name FROM lab",
    "activity_runs": f"WITH {ACTS}, s AS (SELECT trajectory_id, event_id, CAST(lag(x) OVER w AS DOUBLE) AS x0, CAST(lag(y) OVER w AS DOUBLE) AS y0, lag(t) OVER w AS t0, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, t AS t1, name, lag(name) OVER w AS before FROM lab WINDOW w AS (PARTITION BY trajectory_id ORDER BY t, event_id)) SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY t1, event_id) - 1 AS BIGINT) AS unit_index, x0, y0, t0, x1, y1, t1, name FROM s WHERE name IS NOT NULL AND before IS NOT NULL",
    "split_long_units": f"""{U}, h AS (SELECT * REPLACE (t0 // 3600 AS t0, t1 // 3600 AS t1) FROM units), n AS (SELECT *, CASE WHEN t1 - t0 >= 20 THEN CAST(ceil((t1 - t0) / 15.0) AS INTEGER) ELSE 1 END AS n FROM h),
k AS (SELECT *, unnest(range(n)) AS k FROM n) SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY unit_index, k) - 1 AS BIGINT) AS unit_index,
"""
    + ", ".join(
        f"CAST(CASE WHEN k = 0 THEN {a}0 ELSE CAST(CAST({a}0 AS DOUBLE) + (CAST({a}1 AS DOUBLE) - CAST({a}0 AS DOUBLE)) * CAST(k * 15 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE) AS FLOAT) END AS DOUBLE) AS {a}0, CAST(CASE WHEN k = n - 1 THEN {a}1 ELSE CAST(CAST({a}0 AS DOUBLE) + (CAST({a}1 AS DOUBLE) - CAST({a}0 AS DOUBLE)) * CAST((k + 1) * 15 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE) AS FLOAT) END AS DOUBLE) AS {a}1"
        for a in "xy"
    )
    + ", CAST(t0 + k * 15 AS BIGINT) AS t0, CAST(CASE WHEN k = n - 1 THEN t1 ELSE t0 + (k + 1) * 15 END AS BIGINT) AS t1, label_id FROM k",
    "route_accumulate": """WITH s AS (SELECT l_orderkey AS r, l_linenumber AS s, CAST(l_extendedprice AS FLOAT) AS x, CAST(l_quantity AS FLOAT) AS y, CAST(sum(greatest(1, CAST(floor(l_discount * 1000) AS BIGINT))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_extendedprice AS FLOAT), CAST(l_quantity AS FLOAT), l_discount * 1000, l_returnflag ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t, l_discount * 1000 AS d, l_returnflag AS name FROM lineitem)
SELECT * FROM (SELECT r AS trajectory_id, CAST(row_number() OVER w - 2 AS BIGINT) AS unit_index, CAST(lag(x) OVER w AS DOUBLE) AS x0, CAST(lag(y) OVER w AS DOUBLE) AS y0, lag(t) OVER w AS t0, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, t AS t1, name FROM s WINDOW w AS (PARTITION BY r ORDER BY s, x, y, d, name)) WHERE unit_index >= 0""",
    "city_pairs": "SELECT a.n_nationkey AS a_idx, a.n_name AS a_name, b.n_nationkey AS b_idx, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "id_remap": f"{U}, i AS (SELECT DISTINCT trajectory_id AS id FROM units), a AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':1'), id) AS r FROM i), b AS (SELECT id AS new_id, row_number() OVER (ORDER BY id) AS r FROM i) SELECT new_id AS trajectory_id, unit_index, t0 FROM units JOIN a ON a.id = trajectory_id JOIN b USING (r)",
    "slice_offset_limit": f"{U} SELECT {D} FROM units ORDER BY trajectory_id, unit_index LIMIT 250 OFFSET 100",
    **{f"str_{m}": f"WITH {str_ctes(d)} SELECT trajectory_id, unit_index, leaf_id FROM laid" for m, d in ORDERS.items()},
    "leaf_mbb": f"WITH {BOXES} SELECT node_id, n_entries, {BOX_D} FROM boxes",
    "internal_mbb": f"WITH {BOXES} SELECT node_id // 16 AS node_id, count(*) AS n_entries, " + ", ".join(f"CAST({m}({a}{m}) AS {'BIGINT' if a == 't' else 'DOUBLE'}) AS {a}{m}" for m in ("min", "max") for a in "xyt") + " FROM boxes GROUP BY 1",
    "leaf_summary": f"WITH {POSTS} SELECT node_id, label_id, unit_count, array_to_string(ids, ',') AS ids FROM posts",
    "internal_summary": f"WITH {POSTS} SELECT node_id // 16 AS node_id, label_id, CAST(sum(unit_count) AS BIGINT) AS unit_count, array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') AS ids FROM posts GROUP BY 1, 2",
    "label_histogram": f"WITH {LAID} SELECT leaf_id AS node_id, label_id, count(*) AS count FROM laid GROUP BY 1, 2",
    "matching_children": f"WITH {POSTS} SELECT node_id, node_id // 16 AS parent_id, array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') AS ids FROM posts WHERE label_id IN (1, 2) GROUP BY 1, 2",
    "query_time_window": f"WITH {BOXES}, {windows(FLAGSHIP)} SELECT CAST(step AS INTEGER) AS step, a AS tmin, b AS tmax FROM win",
    "trim_windows": f"WITH {BOXES}, {windows(FLAGSHIP)}, f AS (SELECT step, a, min(b) OVER (ORDER BY step DESC) AS b FROM win) SELECT CAST(step AS INTEGER) AS step, max(a) OVER (ORDER BY step) AS tmin, b AS tmax FROM f",
    "shared_ids": f"WITH {BOXES}, {windows(FLAGSHIP)} {shared(FLAGSHIP)}",
    "interval_set_build": f"{U}, {IDS}, {trimmed('sets', 8)} SELECT k AS label_id, min(b) AS \"begin\", max(e) AS \"end\" FROM tp GROUP BY k, part",
    "interval_set_trim": f"WITH {SPANS}, {trimmed('spans', 5)} SELECT k, min(b) AS \"begin\", max(e) AS \"end\" FROM tp GROUP BY k, part",
    "interval_set_union": """WITH s AS (SELECT CAST(p_size % 5 AS BIGINT) AS k, p_partkey * 3 AS b, p_partkey * 3 + p_size AS e FROM part), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
p AS (SELECT *, sum(CASE WHEN r IS NULL OR b > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS part FROM m) SELECT k, min(b) AS "begin", max(e) AS "end" FROM p GROUP BY k, part""",
    "interval_set_intersect": """WITH a AS (SELECT p_partkey * 10 AS b, p_partkey * 10 + p_size % 9 AS e FROM part), c AS (SELECT p_partkey * 10 + 3 AS b, p_partkey * 10 + 3 + p_size % 6 AS e FROM part)
SELECT greatest(a.b, c.b) AS "begin", least(a.e, c.e) AS "end" FROM a JOIN c ON a.b <= c.e AND c.b <= a.e""",
    "k_smallest_gap": f"WITH {SPANS}, g AS (SELECT k, b AS \"begin\", lead(b) OVER (PARTITION BY k ORDER BY b) - e AS gap FROM spans), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, \"begin\") AS r FROM g WHERE gap IS NOT NULL) SELECT * FROM r WHERE r <= 4",
    "spatial_cost": f"WITH {DESCENT} SELECT trajectory_id, level, node_id, size, spatial FROM p",
    "textual_cost": f"WITH {DESCENT} SELECT trajectory_id, level, node_id, textual FROM p",
    "choose_child": f"WITH {DESCENT} SELECT * FROM c1 UNION ALL SELECT * FROM c0",
    "union_area_2d": f"""WITH {RECT}, full_ AS (SELECT * FROM rect WHERE x1 > x0 AND y1 > y0), cells AS (SELECT DISTINCT k, x, unnest(range(y0, y1)) AS y FROM (SELECT k, y0, y1, unnest(range(x0, x1)) AS x FROM full_))
SELECT r.k, CAST(count(c.x) AS DOUBLE) AS area FROM (SELECT DISTINCT k FROM rect) r LEFT JOIN cells c USING (k) GROUP BY r.k""",
    "tree_stats": f"""WITH RECURSIVE {LAID}, lv AS (SELECT 0 AS k, count(DISTINCT leaf_id) AS n FROM laid UNION ALL SELECT k + 1, CAST(ceil(n / 16.0) AS BIGINT) FROM lv WHERE n > 1),
p AS (SELECT DISTINCT k, leaf_id // CAST(pow(16, k) AS BIGINT) AS node, leaf_id // CAST(pow(16, k - 1) AS BIGINT) AS child, label_id FROM laid CROSS JOIN lv WHERE k > 0),
lists AS (SELECT k, node, label_id, count(*) AS n FROM p GROUP BY ALL), idx AS (SELECT k, node, count(*) AS n FROM lists GROUP BY ALL)
SELECT CAST((SELECT count(*) FROM laid) AS DOUBLE) / CAST((SELECT n FROM lv WHERE k = 0) * 113 AS DOUBLE) AS leaf_utilization, coalesce((SELECT avg(n) FROM idx), 0) AS internal_index_size, coalesce((SELECT avg(n) FROM lists), 0) AS internal_list_size,
  (SELECT count(*) FROM laid) AS entry_count, (SELECT n FROM lv WHERE k = 0) AS leaf_nodes, CAST((SELECT coalesce(sum(n), 0) FROM lv WHERE k > 0) AS BIGINT) AS internal_nodes, CAST((SELECT max(k) + 1 FROM lv) AS INTEGER) AS height""",
    "bloom_roundtrip": f"{U} SELECT DISTINCT label_id, trajectory_id AS id, true AS held FROM units",
}
