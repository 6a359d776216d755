"""SQL text shared by the oracle queries: an independent statement of the same cohorts."""

from __future__ import annotations

ORDERS = """
line_agg AS (
  SELECT l_orderkey,
         count(*) AS n_lines_i,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty_i,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc_pts,
         max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 ELSE 0 END) AS hit,
         string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags
  FROM lineitem GROUP BY l_orderkey),
cohort AS (
  SELECT o_orderkey AS row_id,
         CAST(n_lines_i AS DOUBLE) AS n_lines, CAST(qty_i AS DOUBLE) AS qty,
         CAST(disc_pts AS DOUBLE) / CAST(n_lines_i * 100 AS DOUBLE) AS disc,
         o_totalprice AS price, c_acctbal AS acctbal,
         c_mktsegment AS segment, r_name AS region, o_orderpriority AS priority,
         CASE WHEN o_totalprice < 20000 THEN 'entry' WHEN o_totalprice < 100000 THEN 'to_100k'
              WHEN o_totalprice < 200000 THEN 'to_200k' WHEN o_totalprice < 300000 THEN 'to_300k'
              WHEN o_totalprice < 400000 THEN 'to_400k' ELSE 'top' END AS band,
         flags, CASE WHEN hit = 1 THEN 1 ELSE 0 END AS y1,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END AS y2,
         md5(concat_ws('-', o_orderkey, '13')) AS okey,
         n_lines_i, qty_i, disc_pts
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN line_agg ON l_orderkey = o_orderkey)"""

SPLIT = ORDERS + """,
split AS (
  SELECT *, row_number() OVER (ORDER BY okey) <= ceil(0.33 * count(*) OVER ()) AS is_test FROM cohort)"""

SCORED = SPLIT + """,
scores AS (
  SELECT row_id, okey, is_test, segment, region, priority, band, y1, y2,
         least(coalesce(CAST(disc_pts AS DOUBLE), 0.0::DOUBLE) / 80.0::DOUBLE, 1.0::DOUBLE) AS p_a,
         least(coalesce(CAST(qty_i AS DOUBLE), 0.0::DOUBLE) / 400.0::DOUBLE, 1.0::DOUBLE) AS p_b,
         least(coalesce(CAST(n_lines_i AS DOUBLE), 0.0::DOUBLE) * 0.05::DOUBLE
               + coalesce(CAST(disc_pts AS DOUBLE), 0.0::DOUBLE) * 0.005::DOUBLE, 1.0::DOUBLE) AS p_c
  FROM split),
scored AS (
  SELECT *, CASE WHEN p_a > 0.5 THEN 1 ELSE 0 END AS yhat_a, CASE WHEN p_b > 0.5 THEN 1 ELSE 0 END AS yhat_b,
         CASE WHEN p_c > 0.5 THEN 1 ELSE 0 END AS yhat_c
  FROM scores)"""

GROUPS = [
    ("segment", "building", "segment = 'BUILDING'"),
    ("segment", "home", "segment IN ('FURNITURE', 'HOUSEHOLD')"),
    ("region", "asia", "region = 'ASIA'"),
    ("region", "non_asia", "region <> 'ASIA'"),
    ("priority", "urgent", "priority = '1-URGENT'"),
    ("priority", "ranked", "priority IN ('2-HIGH', '3-MEDIUM', '5-LOW')"),
    ("band", "to_100k", "band = 'to_100k'"),
    ("band", "to_200k", "band = 'to_200k'"),
    ("band", "to_300k", "band = 'to_300k'"),
    ("band", "to_400k", "band = 'to_400k'"),
    ("band", "top", "band = 'top'"),
]
EXTRA_GROUPS = [
    ("region", "west", "region IN ('AMERICA', 'EUROPE')"),
    ("segment", "other", "segment IN ('AUTOMOBILE', 'MACHINERY')"),
]


def member(source: str, name: str = "member", whole: bool = True, groups=None) -> str:
    """CTE with one row per row and group."""
    parts = [f"SELECT *, 'all' AS attribute, 'all' AS grp FROM {source}"] if whole else []
    for a, g, cond in groups if groups is not None else GROUPS:
        parts.append(f"SELECT *, '{a}' AS attribute, '{g}' AS grp FROM {source} WHERE {cond}")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


COUNTS = """count(*) AS n,
  count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn"""


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0::DOUBLE ELSE ({num})::DOUBLE / ({den}) END"


PREC1, REC1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
PREC0, REC0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp")
METRIC = {
    "accuracy": "(tp + tn)::DOUBLE / n",
    "f1": ratio("2 * tp", "2 * tp + fp + fn"),
    "precision": PREC1,
    "recall": REC1,
    "precision_macro": f"(({PREC1}) + ({PREC0})) / 2",
    "recall_macro": f"(({REC1}) + ({REC0})) / 2",
    "balanced_accuracy": f"(({REC1}) + ({REC0})) / 2",
}
FOUR = ", ".join(f"round({METRIC[m]}, 6) AS {m}" for m in ("accuracy", "f1", "precision", "recall"))


def unpivot(source: str, name: str = "long", keep: str = "row_id, okey, is_test, segment, region, priority, band") -> str:
    """CTE with one row per row, outcome and scorer."""
    parts = [
        f"SELECT {keep}, '{y}' AS outcome, {y} AS y, '{m}' AS algorithm, {i} AS ordinal, "
        f"p_{m} AS p, yhat_{m} AS yhat FROM {source}"
        for y in ("y1", "y2") for i, m in enumerate("abc")
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def folds(source: str, name: str, k: int, keys: str, label: str = "y") -> str:
    """CTEs adding ``fold``: deal the rows sorted by class round robin, then cut each class in blocks."""
    by = ", ".join(x for x in (keys, label) if x)
    over_keys = f"PARTITION BY {keys}" if keys else ""

    def size(i: int) -> str:
        return f"(floor((s + nc - {i} + {k - 1}) / {k}.0) - floor((s - {i} + {k - 1}) / {k}.0))"

    ends = [" + ".join(size(j) for j in range(i + 1)) for i in range(k - 1)]
    fold = " + ".join(f"CASE WHEN r > {e} THEN 1 ELSE 0 END" for e in ends)
    return f"""
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY okey) AS r,
               count(*) OVER (PARTITION BY {by}) AS nc, min(okey) OVER (PARTITION BY {by}) AS first_key
             FROM {source}),
{name}_c AS (SELECT DISTINCT {by}, nc, first_key FROM {name}_r),
{name}_s AS (SELECT *, coalesce(sum(nc) OVER ({over_keys} ORDER BY first_key
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {name}_c),
{name} AS (SELECT t.* EXCLUDE (r, nc, first_key), CAST({fold} AS INTEGER) AS fold
           FROM {name}_r t JOIN (SELECT {by}, s FROM {name}_s) c USING ({by}))"""


def auc(source: str, name: str, keys: str) -> str:
    """CTE with the rank form of the area under the ROC curve."""
    return f"""{name} AS (
  SELECT {keys}, CASE WHEN npos = 0 OR nneg = 0 THEN 'NaN'::DOUBLE
         ELSE (rank_sum - npos * (npos + 1) / 2.0) / (npos::DOUBLE * nneg) END AS roc_auc
  FROM (SELECT {keys}, sum(y)::DOUBLE AS npos, sum(1 - y)::DOUBLE AS nneg,
               sum(CASE WHEN y = 1 THEN rk ELSE 0 END)::DOUBLE AS rank_sum
        FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY p)
                     + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0::DOUBLE AS rk FROM {source})
        GROUP BY {keys}))"""


def cv_means(folded: str, keys: str, name: str = "cv") -> str:
    """CTEs: six metrics per fold (NaN for a one-class fold) and their means."""
    six = ", ".join(
        f"CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 'NaN'::DOUBLE ELSE {METRIC[m]} END AS {m}"
        for m in ("accuracy", "balanced_accuracy", "f1", "precision_macro", "recall_macro")
    )
    avgs = ", ".join(
        f"avg({m}) AS {m}"
        for m in ("accuracy", "balanced_accuracy", "f1", "precision_macro", "recall_macro", "roc_auc")
    )
    return f"""
{name}_n AS (SELECT {keys}, fold, {COUNTS} FROM {folded} GROUP BY {keys}, fold),
{auc(folded, name + '_a', keys + ', fold')},
{name}_f AS (SELECT {keys}, fold, {six}, roc_auc FROM {name}_n JOIN {name}_a USING ({keys}, fold)),
{name} AS (SELECT {keys}, {avgs} FROM {name}_f GROUP BY {keys})"""


def isotonic(source: str, name: str, keys: str) -> str:
    """CTE ``keys, s, v``: isotonic fit at the distinct scores, by the max-min formula on running sums."""
    k = f"{keys}, " if keys else ""
    on = " AND ".join(f"i.{c.strip()} = {{0}}.{c.strip()}" for c in keys.split(",")) if keys else "true"
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""
{name}_t AS (SELECT {k}p AS s, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS t FROM {source} GROUP BY {k}p),
{name}_u AS (SELECT *, row_number() OVER ({part}ORDER BY s) AS i,
               sum(w) OVER ({part}ORDER BY s) AS cw, sum(t) OVER ({part}ORDER BY s) AS ct FROM {name}_t),
{name}_m AS (SELECT {', '.join('i.' + c.strip() for c in keys.split(',')) + ', ' if keys else ''}i.i AS i, j.i AS j,
               min((b.ct - j.ct + j.t) / (b.cw - j.cw + j.w)) AS lowest
             FROM {name}_u i JOIN {name}_u j ON {on.format('j')} AND j.i <= i.i
             JOIN {name}_u b ON {on.format('b')} AND b.i >= i.i GROUP BY ALL),
{name} AS (SELECT {k}s, v FROM {name}_u JOIN (
             SELECT {k}i, max(lowest) AS v FROM {name}_m GROUP BY {k}i) USING ({k}i))"""


def apply_isotonic(fitted: str, scores: str, name: str, keys: str) -> str:
    """CTE ``keys, p, v``: the fit at the scores of another set, linear in between and flat outside."""
    ks = [c.strip() for c in keys.split(",")] if keys else []
    eq = lambda a, b: " AND ".join([f"{a}.{c} = {b}.{c}" for c in ks] + ["true"])
    sel = "".join(f"q.{c}, " for c in ks)
    return f"""
{name}_q AS (SELECT {sel}q.p,
       max(CASE WHEN f.s <= q.p THEN f.s END) AS s0, min(CASE WHEN f.s >= q.p THEN f.s END) AS s1
     FROM (SELECT DISTINCT {keys + ', ' if keys else ''}p FROM {scores}) q JOIN {fitted} f ON {eq('q', 'f')} GROUP BY {sel}q.p),
{name} AS (SELECT {sel}q.p, CASE WHEN s0 IS NULL THEN b.v WHEN s1 IS NULL OR s0 = s1 THEN a.v
        ELSE a.v + (b.v - a.v) * (q.p - s0) / (s1 - s0) END AS v
      FROM {name}_q q LEFT JOIN {fitted} a ON {eq('q', 'a')} AND a.s = s0
      LEFT JOIN {fitted} b ON {eq('q', 'b')} AND b.s = s1)"""


def sigmoid(source: str, name: str, keys: str, steps: int = 40) -> str:
    """CTEs ``keys, a, b``: Newton's method on Platt's loss with his smoothed targets, one recursion a step."""
    ks = [c.strip() for c in keys.split(",")]
    sel = lambda t: ", ".join(f"{t}.{c}" for c in ks)
    on = " AND ".join(f"i.{c} = t.{c}" for c in ks)
    z = "(i.a * t.s + i.b)"
    # 1 / (1 + e^z) without overflow on either side
    p = f"(CASE WHEN {z} >= 0 THEN exp(-{z}) / (1.0::DOUBLE + exp(-{z})) ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp({z})) END)"
    return f"""
{name}_t AS (SELECT {keys}, p AS s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {source} GROUP BY {keys}, p),
{name}_n AS (SELECT {keys}, (sum(pos) + 1.0::DOUBLE) / (sum(pos) + 2.0::DOUBLE) AS hi, 1.0::DOUBLE / (sum(neg) + 2.0::DOUBLE) AS lo,
               ln((sum(neg) + 1.0::DOUBLE) / (sum(pos) + 1.0::DOUBLE)) AS b0 FROM {name}_t GROUP BY {keys}),
{name}_w AS (SELECT {sel('t')}, t.s, t.pos + t.neg AS n, t.pos * i.hi + t.neg * i.lo AS target FROM {name}_t t JOIN {name}_n i ON {on}),
{name}_i AS (
  SELECT {keys}, CAST(0 AS BIGINT) AS step, 0.0::DOUBLE AS a, b0 AS b FROM {name}_n
  UNION ALL
  SELECT {keys}, step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT {sel('i')}, i.step, i.a, i.b, sum((t.target - t.n * {p}) * t.s) AS ga, sum(t.target - t.n * {p}) AS gb,
               sum(t.n * {p} * (1 - {p}) * t.s * t.s) AS haa, sum(t.n * {p} * (1 - {p}) * t.s) AS hab, sum(t.n * {p} * (1 - {p})) AS hbb
        FROM {name}_i i JOIN {name}_w t ON {on} WHERE i.step < {steps} GROUP BY {sel('i')}, i.step, i.a, i.b)),
{name} AS (SELECT {keys}, a, b FROM {name}_i WHERE step = {steps})"""


def logistic(source: str, name: str, keys: str, steps: int = 40) -> str:
    """CTEs ``keys, w1, w2, w0``: Newton's method on log loss of two features and an intercept, plus half their squared weights.

    ``source`` has ``keys, x1, x2, y``. The 3 x 3 system of a step is solved by cofactors.
    """
    ks = [c.strip() for c in keys.split(",")]
    sel = lambda t: ", ".join(f"{t}.{c}" for c in ks)
    on = " AND ".join(f"i.{c} = t.{c}" for c in ks)
    z = "(i.w1 * t.x1 + i.w2 * t.x2 + i.w0)"
    p = f"(CASE WHEN {z} >= 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-{z})) ELSE exp({z}) / (1.0::DOUBLE + exp({z})) END)"
    w = f"t.n * {p} * (1 - {p})"
    d = f"(t.n * {p} - t.pos)"
    sums = {"g1": f"{d} * t.x1", "g2": f"{d} * t.x2", "g0": d, "s11": f"{w} * t.x1 * t.x1", "s12": f"{w} * t.x1 * t.x2",
            "s22": f"{w} * t.x2 * t.x2", "h10": f"{w} * t.x1", "h20": f"{w} * t.x2", "h00": w}
    return f"""
{name}_t AS (SELECT {keys}, x1, x2, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM {source} GROUP BY {keys}, x1, x2),
{name}_i AS (
  SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS step, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w0 FROM {name}_t
  UNION ALL
  SELECT {keys}, step + 1,
         w1 - (c11 * (g1 + w1) + c12 * (g2 + w2) + c10 * g0) / (h11 * c11 + h12 * c12 + h10 * c10),
         w2 - (c12 * (g1 + w1) + c22 * (g2 + w2) + c20 * g0) / (h11 * c11 + h12 * c12 + h10 * c10),
         w0 - (c10 * (g1 + w1) + c20 * (g2 + w2) + c00 * g0) / (h11 * c11 + h12 * c12 + h10 * c10)
  FROM (SELECT *, h22 * h00 - h20 * h20 AS c11, h10 * h20 - h12 * h00 AS c12, h12 * h20 - h10 * h22 AS c10,
               h11 * h00 - h10 * h10 AS c22, h10 * h12 - h11 * h20 AS c20, h11 * h22 - h12 * h12 AS c00
        FROM (SELECT *, s11 + 1.0::DOUBLE AS h11, s12 AS h12, s22 + 1.0::DOUBLE AS h22
              FROM (SELECT {sel('i')}, i.step, i.w1, i.w2, i.w0, {', '.join(f'sum({e}) AS {c}' for c, e in sums.items())}
                    FROM {name}_i i JOIN {name}_t t ON {on} WHERE i.step < {steps} GROUP BY {sel('i')}, i.step, i.w1, i.w2, i.w0)))),
{name} AS (SELECT {keys}, w1, w2, w0 FROM {name}_i WHERE step = {steps})"""
