"""The same questions as `queries`, in DuckDB SQL, answered unit by unit where Spark uses algebra."""

from __future__ import annotations

from statistics import NormalDist

Z95 = NormalDist().inv_cdf(0.975)
IQR = NormalDist().inv_cdf(0.75) - NormalDist().inv_cdf(0.25)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# --- panels --------------------------------------------------------------------------------------

_ORDERS_ROWS = """
o AS (
  SELECT o_custkey AS unit, CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS BIGINT) AS t,
         CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderpriority = '1-URGENT' AS urgent
  FROM orders),
tm AS (SELECT CAST(unnest(generate_series((SELECT min(t) FROM o), (SELECT max(t) FROM o))) AS BIGINT) AS t),
un AS (SELECT unit, min(CASE WHEN urgent THEN t END) AS g FROM o GROUP BY unit),
yy AS (SELECT unit, t, CAST(sum(p) AS DOUBLE) / 7919 AS y FROM o GROUP BY unit, t)"""

_ORDERS = (
    _ORDERS_ROWS
    + """,
panel AS (
  SELECT un.unit, tm.t, un.g, 'x' AS z, coalesce(yy.y, 0.0) AS y
  FROM un CROSS JOIN tm LEFT JOIN yy ON yy.unit = un.unit AND yy.t = tm.t)"""
)

_SEGMENTS = (
    _ORDERS_ROWS
    + """,
panel AS (
  SELECT un.unit, tm.t, un.g, c_mktsegment AS z, coalesce(yy.y, 0.0) AS y
  FROM un JOIN customer ON c_custkey = un.unit CROSS JOIN tm
  LEFT JOIN yy ON yy.unit = un.unit AND yy.t = tm.t)"""
)

_EVENTS = """
d AS (
  SELECT user_id AS unit, CAST(dayofmonth(ts) AS BIGINT) AS t,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) * 1000 / 7919 AS y,
         bool_or(event_type = 'purchase' AND value > 100) AS bought
  FROM events GROUP BY 1, 2),
f AS (SELECT unit, min(CASE WHEN bought THEN t END) AS g FROM d GROUP BY unit),
panel AS (SELECT d.unit, d.t, f.g, 'x' AS z, d.y FROM d JOIN f ON f.unit = d.unit)"""

# --- effects -------------------------------------------------------------------------------------

_MEANS = """,
m AS (SELECT z, g, t, avg(y) AS m, count(*) AS n FROM panel GROUP BY z, g, t)"""


def _cells(base: str = "least(t, g) - 1") -> str:
    """Group-time effects from group means on an unbroken run of quarters."""
    return (
        _MEANS
        + f""",
b AS (SELECT z, g, t, n, {base} AS b FROM m WHERE g IS NOT NULL AND {base} >= (SELECT min(t) FROM m)),
att AS (
  SELECT b.z, b.g, b.t, b.b, b.n, (gt.m - gb.m) - (ct.m - cb.m) AS att,
         gt.m - gb.m AS dg, ct.m - cb.m AS dc, ct.n AS nc
  FROM b
  JOIN m gt ON gt.z = b.z AND gt.g = b.g AND gt.t = b.t
  JOIN m gb ON gb.z = b.z AND gb.g = b.g AND gb.t = b.b
  JOIN m ct ON ct.z = b.z AND ct.g IS NULL AND ct.t = b.t
  JOIN m cb ON cb.z = b.z AND cb.g IS NULL AND cb.t = b.b)"""
    )


# One row per unit and cell: the unit's deviation from its group's mean difference.
_DEVIATIONS = """,
dev AS (
  SELECT a.z, a.g, a.t, p.unit, a.n AS n, p.y - q.y - a.dg AS e, 1 AS side
  FROM att a JOIN panel p ON p.z = a.z AND p.g = a.g AND p.t = a.t
  JOIN panel q ON q.unit = p.unit AND q.t = a.b
  UNION ALL
  SELECT a.z, a.g, a.t, p.unit, a.nc AS n, p.y - q.y - a.dc AS e, -1 AS side
  FROM att a JOIN panel p ON p.z = a.z AND p.g IS NULL AND p.t = a.t
  JOIN panel q ON q.unit = p.unit AND q.t = a.b)"""

_CELL_SE = """,
se AS (
  SELECT a.z, a.g, a.t, a.b, a.att, s.se FROM att a
  JOIN (SELECT z, g, t, sqrt(sum((e / n) * (e / n))) AS se FROM dev GROUP BY z, g, t) s
    ON s.z = a.z AND s.g = a.g AND s.t = a.t)"""


def _measures(att: str = "att", se: str = "se", crit: str | float = Z95) -> str:
    return f"""round({att}, 4) + 0.0 AS "ATT", round({se}, 4) + 0.0 AS std_error,
  round({att} - {crit} * {se}, 4) + 0.0 AS lower, round({att} + {crit} * {se}, 4) + 0.0 AS upper,
  CASE WHEN {att} - {crit} * {se} > 0 OR {att} + {crit} * {se} < 0 THEN '*' ELSE '' END
    AS zero_not_in_cband"""


_VIEW = {
    "cohort": ("cohort", "g", "t >= g"),
    "time": ("time", "t", "t >= g"),
    "event": ("relative_period", "t - g", "TRUE"),
}


def _points(view: str) -> str:
    name, key, used = _VIEW[view]
    value = "avg(att)" if view == "cohort" else "sum(n * att) / sum(n)"
    return f"""WITH {_ORDERS}{_cells()}
SELECT {key} AS {name}, round({value}, 4) + 0.0 AS "ATT" FROM att WHERE {used} GROUP BY {key}"""


def _view_tables(view: str) -> str:
    """wt: the cells of a view with weight; th: its estimates."""
    _, key, used = _VIEW[view]
    weight = (
        "1.0 / count(*) OVER (PARTITION BY z, {k})"
        if view == "cohort"
        else "n / sum(n) OVER (PARTITION BY z, {k})"
    ).format(k=key)
    return f""",
w0 AS (
  SELECT z, g, t, n, att, {key} AS k, CAST({weight} AS DOUBLE) AS w,
         sum(n) OVER (PARTITION BY z, {key}) AS nn
  FROM att WHERE {used}),
th AS (SELECT z, k, sum(w * att) AS theta FROM w0 GROUP BY z, k),
wt AS (SELECT w0.*, theta FROM w0 JOIN th ON th.z = w0.z AND th.k = w0.k)"""


def _view_influence(view: str) -> str:
    """Standard errors from influence values summed per unit, weight estimation included."""
    tilt = "0.0" if view == "cohort" else "(att - theta) / nn"
    return (
        _view_tables(view)
        + f""",
inf AS (
  SELECT wt.z, wt.k, dev.unit,
         sum(w * side * e / dev.n + CASE WHEN side = 1 THEN {tilt} ELSE 0.0 END) AS i
  FROM wt JOIN dev ON dev.z = wt.z AND dev.g = wt.g AND dev.t = wt.t
  GROUP BY wt.z, wt.k, dev.unit),
vse AS (
  SELECT th.z, th.k, th.theta AS att, s.se FROM th
  JOIN (SELECT z, k, sqrt(sum(i * i)) AS se FROM inf GROUP BY z, k) s ON s.z = th.z AND s.k = th.k)"""
    )


def _view_se(view: str) -> str:
    name = _VIEW[view][0]
    return f"""WITH {_ORDERS}{_cells()}{_DEVIATIONS}{_view_influence(view)}
SELECT k AS {name}, {_measures()} FROM vse"""


# --- bootstrap -----------------------------------------------------------------------------------

# Sign of unit and draw: a bit of md5(seed:unit:block); draws here need one block only.
_SIGNS = """,
bs AS (SELECT CAST(unnest(generate_series(0, 49)) AS BIGINT) AS b),
hx AS (SELECT unit, md5('1234:' || CAST(unit AS VARCHAR) || ':0') AS h FROM un),
v AS (
  SELECT unit, bs.b,
    CASE WHEN ((strpos('0123456789abcdef', substr(h, CAST(bs.b // 4 AS BIGINT) + 1, 1)) - 1)
               >> CAST(3 - bs.b % 4 AS BIGINT)) & 1 = 1 THEN -1.0 ELSE 1.0 END AS v
  FROM hx CROSS JOIN bs)"""


def _boot(rows: str, keys: str) -> str:
    """Errors and simultaneous band from a table `dr` of draws: keys, att, b, d."""
    return f"""{rows},
bse AS (
  SELECT {keys}, max(att) AS att, (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) / {IQR} AS se
  FROM dr GROUP BY {keys}),
crit AS (
  SELECT quantile_cont(mx, 0.95) AS c FROM (
    SELECT b, max(abs(d) / se) AS mx FROM dr JOIN bse USING ({keys}) WHERE se > 0 GROUP BY b))"""


_BOOT_CELLS = f"""WITH {_ORDERS}{_cells()}{_DEVIATIONS}{_SIGNS}{_boot(''',
dr AS (
  SELECT dev.g, dev.t, v.b, max(att.att) AS att, sum(side * e * v / dev.n) AS d
  FROM dev JOIN v ON v.unit = dev.unit
  JOIN att ON att.g = dev.g AND att.t = dev.t GROUP BY dev.g, dev.t, v.b)''', 'g, t')}
SELECT bse.g AS cohort, att.b AS base_period, bse.t AS time, {_measures('bse.att', 'se', 'c')}
FROM bse JOIN att ON att.g = bse.g AND att.t = bse.t CROSS JOIN crit"""

_BOOT_EVENT = f"""WITH {_ORDERS}{_cells()}{_DEVIATIONS}{_view_influence('event')}{_SIGNS}{_boot(''',
dr AS (
  SELECT inf.k, v.b, max(theta) AS att, sum(i * v) AS d
  FROM inf JOIN v ON v.unit = inf.unit JOIN th ON th.k = inf.k GROUP BY inf.k, v.b)''', 'k')}
SELECT k AS relative_period, {_measures('bse.att', 'se', 'c')} FROM bse CROSS JOIN crit"""

_PAIRWISE = f"""WITH {_EVENTS},
times AS (SELECT DISTINCT t FROM panel),
gs AS (SELECT DISTINCT g FROM panel WHERE g IS NOT NULL),
gt AS (SELECT g, t, (SELECT max(x.t) FROM times x WHERE x.t < least(times.t, gs.g)) AS b
       FROM gs CROSS JOIN times),
own AS (
  SELECT gt.g, gt.t, gt.b, avg(p.y - q.y) AS m, var_pop(p.y - q.y) / count(*) AS v
  FROM gt JOIN panel p ON p.g = gt.g AND p.t = gt.t JOIN panel q ON q.unit = p.unit AND q.t = gt.b
  GROUP BY gt.g, gt.t, gt.b),
ctl AS (
  SELECT gt.g, gt.t, gt.b, avg(p.y - q.y) AS m, var_pop(p.y - q.y) / count(*) AS v
  FROM gt JOIN panel p ON p.g IS NULL AND p.t = gt.t JOIN panel q ON q.unit = p.unit AND q.t = gt.b
  GROUP BY gt.g, gt.t, gt.b),
r AS (
  SELECT own.g, own.t, own.b, own.m - ctl.m AS att, sqrt(own.v + ctl.v) AS se
  FROM own JOIN ctl ON ctl.g = own.g AND ctl.t = own.t)
SELECT g AS cohort, b AS base_period, t AS time, {_measures()} FROM r"""

# Effects of a panel with gaps, each difference over the units seen at both times; n: units of the cohort.
_GAPS = f"""{_EVENTS},
un AS (SELECT DISTINCT unit, g FROM panel),
times AS (SELECT DISTINCT t FROM panel),
gs AS (SELECT g, count(*) AS n FROM un WHERE g IS NOT NULL GROUP BY g),
gt AS (SELECT g, n, t, (SELECT max(x.t) FROM times x WHERE x.t < least(times.t, gs.g)) AS b
       FROM gs CROSS JOIN times),
own AS (
  SELECT gt.g, gt.t, gt.b, max(gt.n) AS n, avg(p.y - q.y) AS m, count(*) AS c
  FROM gt JOIN panel p ON p.g = gt.g AND p.t = gt.t JOIN panel q ON q.unit = p.unit AND q.t = gt.b
  GROUP BY gt.g, gt.t, gt.b),
ctl AS (
  SELECT gt.g, gt.t, avg(p.y - q.y) AS m, count(*) AS c
  FROM gt JOIN panel p ON p.g IS NULL AND p.t = gt.t JOIN panel q ON q.unit = p.unit AND q.t = gt.b
  GROUP BY gt.g, gt.t),
att AS (
  SELECT 'x' AS z, own.g, own.t, own.b, own.n, own.m - ctl.m AS att, own.m AS dg, ctl.m AS dc,
         own.c AS cg, ctl.c AS cc
  FROM own JOIN ctl ON ctl.g = own.g AND ctl.t = own.t),
dev AS (
  SELECT a.g, a.t, p.unit, (p.y - q.y - a.dg) / a.cg AS e
  FROM att a JOIN panel p ON p.g = a.g AND p.t = a.t JOIN panel q ON q.unit = p.unit AND q.t = a.b
  UNION ALL
  SELECT a.g, a.t, p.unit, -(p.y - q.y - a.dc) / a.cc AS e
  FROM att a JOIN panel p ON p.g IS NULL AND p.t = a.t JOIN panel q ON q.unit = p.unit AND q.t = a.b)"""


def _gap_influence(view: str) -> str:
    """Influence of each unit on each estimate: of the cells it is seen in, and of its cohort's share."""
    tilt = "0.0" if view == "cohort" else "(att - theta) / nn"
    return (
        _view_tables(view)
        + f""",
inf AS (
  SELECT k, unit, sum(i) AS i FROM (
    SELECT wt.k, dev.unit, w * e AS i FROM wt JOIN dev ON dev.g = wt.g AND dev.t = wt.t
    UNION ALL
    SELECT wt.k, un.unit, {tilt} AS i FROM wt JOIN un ON un.g = wt.g)
  GROUP BY k, unit)"""
    )


def _gap_se(view: str) -> str:
    return f"""WITH {_GAPS}{_gap_influence(view)},
vse AS (
  SELECT th.k, th.theta AS att, s.se FROM th
  JOIN (SELECT k, sqrt(sum(i * i)) AS se FROM inf GROUP BY k) s ON s.k = th.k)
SELECT k AS {_VIEW[view][0]}, {_measures()} FROM vse"""


_GAP_BOOT_CELLS = f"""WITH {_GAPS}{_SIGNS}{_boot(''',
dr AS (
  SELECT dev.g, dev.t, v.b, max(att.att) AS att, sum(e * v) AS d
  FROM dev JOIN v ON v.unit = dev.unit
  JOIN att ON att.g = dev.g AND att.t = dev.t GROUP BY dev.g, dev.t, v.b)''', 'g, t')}
SELECT bse.g AS cohort, att.b AS base_period, bse.t AS time, {_measures('bse.att', 'se', 'c')}
FROM bse JOIN att ON att.g = bse.g AND att.t = bse.t CROSS JOIN crit"""

_GAP_BOOT_EVENT = f"""WITH {_GAPS}{_gap_influence('event')}{_SIGNS}{_boot(''',
dr AS (
  SELECT inf.k, v.b, max(theta) AS att, sum(i * v) AS d
  FROM inf JOIN v ON v.unit = inf.unit JOIN th ON th.k = inf.k GROUP BY inf.k, v.b)''', 'k')}
SELECT k AS relative_period, {_measures('bse.att', 'se', 'c')} FROM bse CROSS JOIN crit"""

# --- demeaning -----------------------------------------------------------------------------------

_DEMEANED = """,
dm AS (
  SELECT unit, t, g, y - avg(y) OVER (PARTITION BY t) - avg(y) OVER (PARTITION BY unit)
         + avg(y) OVER () AS y FROM panel)"""


def _simple_diff(panel: str) -> str:
    return f"""WITH {panel}{_DEMEANED},
c AS (
  SELECT coalesce(g, 200000000) AS cohort, t, avg(y) AS mean, stddev_samp(y) AS std, count(*) AS size
  FROM dm GROUP BY 1, 2)
SELECT CAST(a.cohort AS BIGINT) AS cohort, a.t, round(a.mean, 4) + 0.0 AS mean,
  round(a.std, 4) + 0.0 AS std, a.size, CAST(b.cohort AS BIGINT) AS cohort_val,
  round(b.mean, 4) + 0.0 AS mean_val, round(b.std, 4) + 0.0 AS std_val, b.size AS size_val,
  round(a.mean - b.mean, 4) + 0.0 AS "ATT"
FROM c a JOIN c b ON a.t = b.t WHERE a.cohort = 200000000 AND b.cohort <> 200000000"""


# --- panel ---------------------------------------------------------------------------------------

_NUMBERED = """
s AS (
  SELECT o_orderkey - 500 AS seq_idx,
         CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS INTEGER) AS step,
         round(o_totalprice, 2) AS sup_seq FROM orders)"""

_COHORTS = f"""WITH {_NUMBERED},
b AS (SELECT *, CASE WHEN seq_idx > 0 THEN CAST(ceil(seq_idx / 64.0) AS BIGINT) END AS k FROM s)
SELECT seq_idx, step, sup_seq, coalesce(k, 200000000) AS batch_idx,
       CAST(ceil(k / 10.0) AS BIGINT) * 10 AS cohort FROM b"""

_COHORTS_ZERO = f"""WITH {_NUMBERED},
b AS (SELECT *, CASE WHEN seq_idx >= 0 THEN CAST(floor(seq_idx / 64.0) AS BIGINT) + 1 END AS k FROM s)
SELECT seq_idx, step, sup_seq, coalesce(k, 200000000) AS batch_idx,
       CAST(ceil(k / 10.0) AS BIGINT) * 10 AS cohort FROM b"""

# --- token statistics ----------------------------------------------------------------------------

_TOKENS = """
l AS (
  SELECT CAST(vec_id // 10 AS BIGINT) AS seq_idx, CAST(vec_id % 10 AS INTEGER) AS pos, vec_id,
         label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS j
  FROM embeddings),
mx AS (SELECT vec_id, max(x) AS top, max(CASE WHEN j = label THEN x END) AS tx FROM l GROUP BY vec_id),
z AS (
  SELECT l.vec_id, ln(sum(exp(x - top))) + max(top) AS lse FROM l JOIN mx ON mx.vec_id = l.vec_id
  GROUP BY l.vec_id),
tok AS (
  SELECT l.seq_idx, l.pos, max(z.lse) - max(mx.tx) AS sup,
         CAST(count(*) FILTER (WHERE x > tx) AS INTEGER) AS rank,
         -sum(exp(x - lse) * (x - lse)) AS entropy
  FROM l JOIN mx ON mx.vec_id = l.vec_id JOIN z ON z.vec_id = l.vec_id
  GROUP BY l.seq_idx, l.pos)"""

_TOKEN_STATS = f"""WITH {_TOKENS}
SELECT seq_idx, pos, round(sup, 4) + 0.0 AS sup, rank, round(entropy, 4) + 0.0 AS entropy FROM tok"""

_STATS_TEXT = f"""WITH {_TOKENS}
SELECT seq_idx, CAST(count(*) AS INTEGER) AS n, round(sum(sup), 4) + 0.0 AS sup_sum,
       string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos) AS ranks,
       round(sum(entropy), 4) + 0.0 AS entropy_sum
FROM tok GROUP BY seq_idx"""


def _export(steps: str, extra: str = "", more: str = "") -> str:
    return f"""WITH {_TOKENS},
p AS (
  SELECT seq_idx, avg(sup) AS s, avg(entropy) AS e,
         count(*) FILTER (WHERE rank = 0) / nullif(count(*), 0) AS a, avg(rank) AS r
  FROM tok GROUP BY seq_idx)
SELECT seq_idx, CAST(step AS INTEGER) AS step, round(s, 4) + 0.0 AS sup_seq,
       round(e, 4) + 0.0 AS entr_seq, round(a, 4) + 0.0 AS acc_seq, round(r, 4) + 0.0 AS avg_rank{extra}
FROM p CROSS JOIN (VALUES {steps}) s(step){more}"""


# --- corpus --------------------------------------------------------------------------------------

_WORDS = r"""
w0 AS (
  SELECT doc_id, source, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws
  FROM documents),
w AS (
  SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM w0)"""

_VOCAB = (
    _WORDS
    + """,
f AS (SELECT token, count(*) AS count FROM w GROUP BY token),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY count DESC, encode(token) ASC) - 1 AS INTEGER)
    AS token_id, count FROM f)"""
)

_TOKENIZED = f"""WITH {_VOCAB},
t AS (
  SELECT doc_id, string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos) AS ids
  FROM w JOIN vocab ON vocab.token = w.token GROUP BY doc_id)
SELECT d.doc_id, coalesce(ids, '') AS input_ids FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""

_PACKED = f"""WITH {_WORDS},
n AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos) - 1 AS i FROM w)
SELECT CAST(-100 - (i // 64) AS BIGINT) AS seq_idx, string_agg(token, ' ' ORDER BY i) AS words
FROM n GROUP BY i // 64 HAVING count(*) = 64"""

_PAIRS = f"""WITH {_WORDS},
x AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, token,
        lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS label FROM w)
SELECT doc_id, pos, token, label FROM x WHERE label IS NOT NULL"""


def _two_stage(ids: str, batch: int, cohort: int, batches: int, rows: int) -> str:
    return f"""
i AS ({ids}),
fb AS (
  SELECT DISTINCT id // {batch} AS b FROM i WHERE id // {batch} < (SELECT (max(id) + 1) // {batch} FROM i)),
kb AS (
  SELECT b, b // {cohort} AS c,
    row_number() OVER (PARTITION BY b // {cohort} ORDER BY md5('1994:' || CAST(b AS VARCHAR)), b) AS k
  FROM fb),
ks AS (
  SELECT c, b, id,
    row_number() OVER (PARTITION BY b ORDER BY md5('1994:' || CAST(id AS VARCHAR)), id) AS k
  FROM i JOIN kb ON kb.b = i.id // {batch} AND kb.k <= {batches}),
sample AS (
  SELECT CAST(c AS BIGINT) AS cohort, CAST(b AS BIGINT) AS batch_idx, id AS seq_idx
  FROM ks WHERE k <= {rows})"""


_SPLITS = rf"""WITH {_WORDS},
b0 AS (
  SELECT -100 - item_id AS seq_idx, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws
  FROM benchmark),
s AS (SELECT doc_id AS seq_idx, ws, 'train' AS split FROM w0 UNION ALL SELECT seq_idx, ws, 'validation' FROM b0)
SELECT seq_idx, CAST(len(ws) AS INTEGER) AS n_words, md5(array_to_string(ws, ' ')) AS md5, split FROM s"""

# --- profiles ------------------------------------------------------------------------------------

_SEGMENT_SE = f"WITH {_SEGMENTS}{_cells()}{_DEVIATIONS}{_CELL_SE}"
_SEGMENT_EVENT = f"WITH {_SEGMENTS}{_cells()}{_DEVIATIONS}{_view_influence('event')}"


def _listed(sizes: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(sizes))
    names = ", ".join(f"'{s}'" for s in sizes)
    return f"""CASE WHEN z IN ({names}) THEN z END AS model_size,
  CAST(CASE z {cases} END AS INTEGER) AS size_rank"""


def _annotated(
    source: str,
    keys: str,
    flip: str = "",
    sizes: tuple[str, ...] = SEGMENTS,
) -> str:
    """`an`: effects with orientation and two-error band; flip is '', 'plain' or 'legacy'."""
    sign = "-" if flip else ""
    lower, upper = f"att - {Z95} * se", f"att + {Z95} * se"
    err = "-se" if flip == "legacy" else "se"
    if flip == "plain":
        low, high = f"-({upper})", f"-({lower})"
    elif flip == "legacy":
        low, high = f"-({lower})", f"-({upper})"
    else:
        low, high = lower, upper
    return f""",
an AS (
  SELECT {keys}, {_listed(sizes)}, att, {err} AS std_error, {low} AS lower, {high} AS upper,
    CASE WHEN {lower} > 0 OR {upper} < 0 THEN '*' ELSE '' END AS zero_not_in_cband,
    {sign}att AS memorisation, {sign}att - 2 * {err} AS stdlower, {sign}att + 2 * {err} AS stdupper
  FROM {source} WHERE z <> 'HOUSEHOLD')"""


_AN_COLS = """model_size, size_rank, round(att, 4) + 0.0 AS "ATT",
  round(std_error, 4) + 0.0 AS std_error, round(lower, 4) + 0.0 AS lower,
  round(upper, 4) + 0.0 AS upper, zero_not_in_cband, round(memorisation, 4) + 0.0 AS memorisation,
  round(stdlower, 4) + 0.0 AS stdlower, round(stdupper, 4) + 0.0 AS stdupper,
  CASE WHEN stdlower > 0 OR stdupper < 0 THEN '*' ELSE '' END AS zero_not_in_cf"""
_CELL_KEYS = "g AS cohort, b AS base_period, t AS time"


def _annotate(flip: str) -> str:
    return f"""{_SEGMENT_SE}{_annotated('se', _CELL_KEYS, flip, SEGMENTS[:4])}
SELECT cohort, base_period, time, {_AN_COLS} FROM an"""


def _profile(where: str, extra: str = "") -> str:
    return f"""{_SEGMENT_SE}{_annotated('se', _CELL_KEYS)}
SELECT cohort, base_period, time, {_AN_COLS}{extra} FROM an WHERE {where}"""


# Customers as numbered units, every fifth a control; cohorts by batches of 16, four batches each.
_NUMBERED_PANEL = (
    _ORDERS_ROWS
    + """,
nu AS (SELECT unit, unit % 5 = 0 AS control, CAST(ceil(ceil(unit / 16.0) / 4.0) AS BIGINT) * 4 AS c FROM un),
panel AS (
  SELECT CASE WHEN control THEN -nu.unit ELSE nu.unit END AS unit, tm.t, CASE WHEN NOT control THEN c END AS g, z,
         coalesce(yy.y, 0.0) * f AS y
  FROM nu CROSS JOIN tm CROSS JOIN (VALUES ('70M', 1.0), ('12B', 3.0)) s(z, f)
  LEFT JOIN yy ON yy.unit = nu.unit AND yy.t = tm.t)"""
)
# The deviations' second row of a unit is of the same size.
_NUMBERED_DEVIATIONS = _DEVIATIONS.replace("q.unit = p.unit", "q.unit = p.unit AND q.z = p.z")
_SIZES = ("70M", "160M", "410M", "1.4B", "6.9B", "12B")
_PANEL_JOB = f"""WITH {_NUMBERED_PANEL}{_cells()}{_NUMBERED_DEVIATIONS}{_CELL_SE}{_annotated('se', _CELL_KEYS, '', _SIZES)}
SELECT cohort, base_period, time, {_AN_COLS} FROM an WHERE time >= cohort AND zero_not_in_cband = '*'"""

_PERSISTENT = f"""{_SEGMENT_EVENT}{_annotated('vse', 'k AS relative_period')}
SELECT relative_period, {_AN_COLS} FROM an
WHERE relative_period BETWEEN 0 AND 20 AND zero_not_in_cband = '*' AND memorisation > 0"""

_PIVOT = f"""WITH {_SEGMENTS}{_cells()}
SELECT g AS cohort, t AS time, {', '.join(
    f'''round(max(CASE WHEN z = '{s}' THEN att END), 4) + 0.0 AS "{s}"''' for s in SEGMENTS)}
FROM att GROUP BY g, t"""

_PAIR_ROWS = f"""WITH {_SEGMENTS}{_cells()},
xy AS (
  SELECT a.z AS model_size, b.z AS other, a.att AS x, b.att AS y
  FROM att a JOIN att b ON a.g = b.g AND a.t = b.t AND a.z <= b.z)"""

_PEARSON = f"""{_PAIR_ROWS}
SELECT other, model_size, round(corr(x, y), 4) + 0.0 AS value FROM xy GROUP BY other, model_size"""

_SPEARMAN = f"""{_PAIR_ROWS},
r AS (
  SELECT model_size, other,
    rank() OVER (PARTITION BY model_size, other ORDER BY x)
      + (count(*) OVER (PARTITION BY model_size, other, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY model_size, other ORDER BY y)
      + (count(*) OVER (PARTITION BY model_size, other, y) - 1) / 2.0 AS ry
  FROM xy)
SELECT other, model_size, round(corr(rx, ry), 4) + 0.0 AS value FROM r GROUP BY other, model_size"""

_KENDALL = f"""{_PAIR_ROWS},
s AS (
  SELECT p.model_size, p.other, sign(p.x - q.x) AS sx, sign(p.y - q.y) AS sy
  FROM xy p JOIN xy q ON p.model_size = q.model_size AND p.other = q.other)
SELECT other, model_size,
  round(sum(sx * sy) / (sqrt(sum(sx * sx)) * sqrt(sum(sy * sy))), 4) + 0.0 AS value
FROM s GROUP BY other, model_size"""

_LR = """WITH d AS (
  SELECT DISTINCT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS time
  FROM orders),
k AS (SELECT time, (SELECT max(time) FROM d) AS total, ceil(0.01 * (SELECT max(time) FROM d)) AS warm FROM d)
SELECT time, round(CASE WHEN time <= warm THEN 0.0001 + 0.0009 * time / warm
  ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * (time - warm) / (total - warm))) END, 8) + 0.0 AS lr FROM k"""

_STORE = f"""{_SEGMENT_EVENT}
SELECT k AS relative_period, z AS model_size, {_measures()} FROM vse"""

_FREQUENCY = f"WITH {_WORDS} SELECT token, count(*) AS count FROM w GROUP BY token"


def all_oracles() -> dict[str, str]:
    in_run = "cohort <= 20 AND time <= 20 AND zero_not_in_cband = '*'"
    return {
        "att_gt": f"""WITH {_ORDERS}{_cells()}
SELECT g AS cohort, b AS base_period, t AS time, n, round(att, 4) + 0.0 AS "ATT" FROM att""",
        "att_gt_universal": f"""WITH {_ORDERS}{_cells("g - 1")}
SELECT g AS cohort, b AS base_period, t AS time, n, round(att, 4) + 0.0 AS "ATT" FROM att""",
        "att_by_segment": f"""WITH {_SEGMENTS}{_cells()}
SELECT z AS model_size, g AS cohort, b AS base_period, t AS time, n,
  round(att, 4) + 0.0 AS "ATT" FROM att""",
        "att_by_event": _points("event"),
        "att_by_cohort": _points("cohort"),
        "att_by_time": _points("time"),
        "att_gt_se": f"""WITH {_ORDERS}{_cells()}{_DEVIATIONS}{_CELL_SE}
SELECT {_CELL_KEYS}, {_measures()} FROM se""",
        "att_by_cohort_se": _view_se("cohort"),
        "att_by_time_se": _view_se("time"),
        "att_by_event_se": _view_se("event"),
        "att_gt_bootstrap": _BOOT_CELLS,
        "att_by_event_bootstrap": _BOOT_EVENT,
        "att_gt_pairwise": _PAIRWISE,
        "att_by_cohort_pairwise_se": _gap_se("cohort"),
        "att_by_time_pairwise_se": _gap_se("time"),
        "att_by_event_pairwise_se": _gap_se("event"),
        "att_gt_pairwise_bootstrap": _GAP_BOOT_CELLS,
        "att_by_event_pairwise_bootstrap": _GAP_BOOT_EVENT,
        "unbalanced_users": f"""WITH {_EVENTS}
SELECT unit, count(*) AS n_rows, count(DISTINCT t) AS n_times FROM panel GROUP BY unit
HAVING count(*) <> (SELECT count(DISTINCT t) FROM panel)""",
        "demean_two_way": f"""WITH {_ORDERS}{_DEMEANED}
SELECT unit, g, t, round(y, 4) + 0.0 AS y FROM dm""",
        "simple_diff": _simple_diff(_ORDERS),
        "simple_diff_unbalanced": _simple_diff(_EVENTS),
        "assign_cohorts": _COHORTS,
        "assign_cohorts_zero_based": _COHORTS_ZERO,
        "remove_dups": f"""WITH {_ORDERS}
SELECT unit, g, t, y FROM panel WHERE (g <= 20 OR g IS NULL) AND t <= 20""",
        "restrict_units": """SELECT o_custkey AS seq_idx, o_orderkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
        "missing_units": """SELECT c_custkey AS seq_idx FROM customer WHERE c_mktsegment = 'BUILDING'
AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""",
        "missing_steps": """SELECT CAST(x AS INTEGER) AS step FROM generate_series(0, 39) s(x)
WHERE x NOT IN (SELECT dayofmonth(ts) FROM events)""",
        "scan_with_step": "SELECT event_id, value, CAST(dayofmonth(ts) AS INTEGER) AS step FROM events",
        "panel_export": _export("(0)"),
        "panel_store": _export(
            "(0)",
            ", model_size",
            " CROSS JOIN (VALUES ('a'), ('b')) z(model_size) WHERE seq_idx % 2 = 0",
        ),
        "read_corpus": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS md5 FROM documents",
        "append_runs": _export("(0), (1000)"),
        "flatten_stats": _STATS_TEXT,
        "stream_flatten_stats": _STATS_TEXT,
        "token_statistics": _TOKEN_STATS,
        "token_statistics_arrow": _TOKEN_STATS,
        "token_statistics_edges": f"""WITH {_TOKENS}
SELECT t.seq_idx, t.pos, CASE WHEN vec_id % 3 <> 0 THEN round(sup, 4) + 0.0 END AS sup,
       CASE WHEN vec_id % 3 <> 0 THEN rank END AS rank,
       CASE WHEN vec_id % 3 <> 0 THEN round(entropy, 4) + 0.0 END AS entropy
FROM tok t JOIN embeddings e ON t.seq_idx = e.vec_id // 10 AND t.pos = e.vec_id % 10""",
        "sequence_surprisal": f"""WITH {_TOKENS}
SELECT seq_idx, round(avg(sup), 4) + 0.0 AS sup_seq FROM tok GROUP BY seq_idx""",
        "vocabulary": f"WITH {_VOCAB} SELECT token, token_id, count FROM vocab",
        "tokenize": _TOKENIZED,
        "tokenize_custom": f"""WITH {_WORDS}
SELECT doc_id, array_to_string(list_transform(ws, lambda x: CAST(length(x) AS VARCHAR)), ' ')
  AS input_ids FROM w0""",
        "token_frequency": _FREQUENCY,
        "stream_token_frequency": _FREQUENCY,
        "pack_sequences": _PACKED,
        "next_token_pairs": _PAIRS,
        "sample_two_stage": f"""WITH {_two_stage('SELECT o_orderkey AS id FROM orders', 64, 10, 3, 5)}
SELECT cohort, batch_idx, seq_idx FROM sample""",
        "sample_uniform": """SELECT o_orderkey AS seq_idx, o_custkey FROM orders
ORDER BY md5('1234:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500""",
        "sequence_lookup": f"""WITH {_WORDS},{_two_stage('SELECT doc_id AS id FROM documents', 10, 5, 2, 3)}
SELECT cohort, batch_idx, seq_idx, array_to_string(ws, ' ') AS words
FROM sample JOIN w0 ON w0.doc_id = sample.seq_idx""",
        "union_splits": _SPLITS,
        "split_store": _SPLITS,
        "read_json_permissive": """
SELECT CASE WHEN event_type = 'error' THEN NULL ELSE CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END
         AS k, CASE WHEN event_type = 'error' THEN '{' || props END AS bad_line, count(*) AS n
FROM events GROUP BY 1, 2""",
        "annotate_effects": _annotate("plain"),
        "annotate_effects_legacy": _annotate("legacy"),
        "annotate_effects_accuracy": _annotate(""),
        "profile_full": _profile("time >= cohort AND zero_not_in_cband = '*'"),
        "profile_restricted": _profile(f"time >= cohort AND {in_run}"),
        "profile_instantaneous": _profile(f"time = cohort AND {in_run}"),
        "profile_final": _profile(
            "cohort <= 20 AND time = 20 AND memorisation >= 0",
            ", CAST(CASE zero_not_in_cband WHEN '*' THEN 1.0 ELSE 0.3 END AS DOUBLE) AS alpha",
        ),
        "profile_persistent": _PERSISTENT,
        "profile_pivot": _PIVOT,
        "profile_correlation": _PEARSON,
        "profile_correlation_spearman": _SPEARMAN,
        "profile_correlation_kendall": _KENDALL,
        "panel_job": _PANEL_JOB,
        "lr_schedule": _LR,
        "effect_store": _STORE,
        "effect_files": _STORE,
        "token_count_store": _FREQUENCY,
        "score_sequences": f"""WITH {_WORDS}
SELECT doc_id AS seq_idx, round(len(ws) / 100.0, 4) + 0.0 AS sup_seq FROM w0""",
    }
