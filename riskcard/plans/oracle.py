"""DuckDB SQL oracles for the registered queries.

Each string runs on the driver tables (registered as views) and restates the
query in plain SQL: the fixture, the sentinel rule, the fixed bins and points,
windows for running sums, a recursive CTE enumerating every monotone
segmentation for the binning fit.  Bin labels and weights come from the same
fixed metadata as the Spark side; everything else is computed in SQL.
"""

from __future__ import annotations

import math

from riskcard.functions.exprs import MISSING_LABEL
from riskcard.operators.bins import NumericBins, cat_name
from riskcard.operators.encode import level_columns
from riskcard.sources import fixture as FX
from riskcard.plans import catalog as C

APP = """
SELECT o_orderkey AS app_id, c_custkey AS "MBID", o_orderdate AS opened, 1 + o_orderkey % 9 AS ext_score,
  CASE WHEN o_orderkey % 20 = 3 THEN NULL ELSE o_totalprice END AS total_price,
  CASE WHEN o_orderkey % 25 = 4 THEN NULL ELSE c_acctbal END AS acct_bal,
  n_items, qty, avg_disc,
  CASE WHEN o_orderkey % 100 < 97 THEN NULL ELSE o_totalprice END AS sparse_x,
  CASE WHEN o_orderkey % 30 = 7 THEN '.' WHEN o_orderkey % 45 = 11 THEN 'NULL' ELSE c_mktsegment END AS segment,
  o_orderpriority AS priority,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f,
  CASE WHEN 8e0 * coalesce(n_items, 2) - c_acctbal / 250e0 + o_totalprice / 20000e0
     + CASE o_orderpriority WHEN '1-URGENT' THEN 15e0 WHEN '5-LOW' THEN -10e0 ELSE 0e0 END
     + CASE c_mktsegment WHEN 'MACHINERY' THEN 10e0 WHEN 'BUILDING' THEN -6e0 ELSE 0e0 END
     + (o_orderkey * 7919 % 101) > 95e0 THEN 1 ELSE 0 END AS pi
FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS avg_disc
           FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey
"""

CLEAN = """
SELECT * REPLACE (CASE WHEN segment IN ('.', 'NULL') THEN NULL ELSE segment END AS segment,
                  CASE WHEN priority IN ('.', 'NULL') THEN NULL ELSE priority END AS priority)
FROM app
"""

APP_COLUMNS = ["app_id", "MBID", "opened", "ext_score", "total_price", "acct_bal", "n_items", "qty",
               "avg_disc", "sparse_x", "segment", "priority", "is_f", "pi"]
CLEANED_COLUMNS = ["app_id", "acct_bal", "avg_disc", "is_f", "n_items", "priority", "qty", "segment",
                   "total_price", "pi"]
NUMERIC_CLEANED = ["acct_bal", "avg_disc", "n_items", "qty", "total_price"]
DOUBLE_COLUMNS = {"total_price", "acct_bal", "qty", "avg_disc", "sparse_x"}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quoted(c: str) -> str:
    return '"MBID"' if c == "MBID" else c


def exported(c: str) -> str:
    """The text of a cell as exported: doubles have 1 to 4 decimals."""
    if c not in DOUBLE_COLUMNS:
        return f"CAST({quoted(c)} AS VARCHAR)"
    digits = f"rtrim(CAST(CAST(round_even({c}, 4) AS DECIMAL(38, 4)) AS VARCHAR), '0')"
    return f"CASE WHEN {digits} LIKE '%.' THEN {digits} || '0' ELSE {digits} END"


def num(x: float) -> str:
    """A DOUBLE literal."""
    if math.isinf(x):
        return "'inf'::DOUBLE" if x > 0 else "'-inf'::DOUBLE"
    return repr(float(x)) + "e0" if "e" not in repr(float(x)) else repr(float(x))


def r6(e: str) -> str:
    return f"(round({e}, 6) + 0e0)"


FACTOR = "(80e0 / ln(2e0))"
OFFSET = f"(450e0 - {FACTOR} * ln(1e0))"


def label_case(b) -> str:
    x = b.feature
    if isinstance(b, NumericBins):
        parts = [f"WHEN {x} IS NULL THEN {q(MISSING_LABEL)}"]
        parts += [f"WHEN {x} <= {num(s)} THEN {q(lab)}" for s, lab in zip(b.splits, b.labels)]
        return f"CASE {' '.join(parts)} ELSE {q(b.labels[-1])} END"
    parts = [f"WHEN {x} IN ({', '.join(q(m) for m in g)}) THEN {q(lab)}" for g, lab in zip(b.groups, b.labels)]
    return f"CASE {' '.join(parts)} ELSE {q(MISSING_LABEL)} END"


def value_case(b, values: list[str], nan_value: str) -> str:
    """CASE mapping a raw value to per-bin SQL expressions."""
    x = b.feature
    if isinstance(b, NumericBins):
        parts = [f"WHEN {x} IS NULL THEN {nan_value}"]
        parts += [f"WHEN {x} <= {num(s)} THEN {v}" for s, v in zip(b.splits, values)]
        return f"CASE {' '.join(parts)} ELSE {values[-1]} END"
    parts = [f"WHEN {x} IN ({', '.join(q(m) for m in g)}) THEN {v}" for g, v in zip(b.groups, values)]
    return f"CASE {' '.join(parts)} ELSE {nan_value} END"


def z_expr(features=None) -> str:
    """Bad log-odds: intercept + bin weights, added in feature order."""
    e = num(FX.SCORECARD_INTERCEPT)
    for b in FX.SCORECARD_BINS:
        if features is not None and b.feature not in features:
            continue
        ws, wn = FX.SCORECARD_WEIGHTS[b.feature]
        e = f"({e} + {value_case(b, [num(w) for w in ws], num(wn if wn is not None else 0.0))})"
    return e


def pts(w: float) -> str:
    return f"CAST(round_even(-{FACTOR} * {num(w)}, 0) AS BIGINT)"


def score_sql(features=None) -> str:
    e = f"CAST(round_even({OFFSET} - {FACTOR} * {num(FX.SCORECARD_INTERCEPT)}, 0) AS BIGINT)"
    for b in FX.SCORECARD_BINS:
        if features is not None and b.feature not in features:
            continue
        ws, wn = FX.SCORECARD_WEIGHTS[b.feature]
        e = f"({e} + {value_case(b, [pts(w) for w in ws], pts(wn if wn is not None else 0.0))})"
    return e


BINNED = ("SELECT app_id, " + ", ".join(f"{label_case(b)} AS {cat_name(b.feature)}" for b in FX.SCORECARD_BINS)
          + ", pi FROM clean")
SCORED = f"SELECT app_id, pi, {score_sql()} AS score FROM clean"
SPLIT = ("CASE WHEN ('0x' || substr(md5(app_id::VARCHAR || ':42'), 1, 8))::BIGINT < "
         f"{int(0.7 * 2**32)} THEN 'train' ELSE 'test' END")
GRAIN = ("SELECT score, count(*) AS n, count(*) FILTER (WHERE pi = 0) AS good, "
         "count(*) FILTER (WHERE pi = 1) AS bad FROM scored GROUP BY score")


def with_base(body: str, extra: str = "", recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    ctes = [f"app AS ({APP})", f"clean AS ({CLEAN})", f"binned AS ({BINNED})", f"scored AS ({SCORED})",
            f"grain AS ({GRAIN})"]
    if extra:
        ctes.append(extra)
    return f"{head} {', '.join(ctes)}\n{body}"


def ks_sql(grain: str, key: str, desc: bool, index_group: bool = False, keep_key: bool = True,
           by: str | None = None) -> str:
    """KS table over a grain relation (key, n, good, bad)."""
    part = f"PARTITION BY {by} " if by else ""
    o = f"{key} DESC" if desc else key
    grp = "CAST(k AS DOUBLE) / kk" if index_group else "CAST(cn AS DOUBLE) / nn"
    keycol = f"{key}, " if keep_key else ""
    bycol = f"{by}, " if by else ""
    return f"""SELECT {bycol}{keycol}{grp} AS "group", good, bad, good / gg AS good_distri, bad / bb AS bad_distri,
  bad / n AS badrate, cb / cn AS cumbadrate, (cb / cn) / (bb / nn) AS lift, cg / gg AS cumgood, cb / bb AS cumbad,
  abs(cb / bb - cg / gg) AS ks
FROM (SELECT *, sum(n) OVER w AS cn, sum(good) OVER w AS cg, sum(bad) OVER w AS cb,
        row_number() OVER w AS k,
        CAST(sum(n) OVER a AS DOUBLE) AS nn, CAST(sum(good) OVER a AS DOUBLE) AS gg,
        CAST(sum(bad) OVER a AS DOUBLE) AS bb, count(*) OVER a AS kk
      FROM ({grain}) g
      WINDOW w AS ({part}ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({part}))"""


KS_COLS = ['"group"', "good", "bad", "good_distri", "bad_distri", "badrate", "cumbadrate", "lift",
           "cumgood", "cumbad", "ks"]


def rsel(cols: list[str], doubles: set[str], src: str) -> str:
    return "SELECT " + ", ".join((f"{r6(c)} AS {c}" if c.strip('"') in doubles else c) for c in cols) + f" FROM ({src})"


KS_DOUBLES = {"group", "good_distri", "bad_distri", "badrate", "cumbadrate", "lift", "cumgood", "cumbad", "ks"}
KS_SCORE = ks_sql("SELECT * FROM grain", "score", desc=False)


def _iv_long(features, src="clean"):
    parts = []
    for f in features:
        v = f"CAST({f} + 0e0 AS VARCHAR)" if f in DOUBLE_COLUMNS else f"CAST({f} AS VARCHAR)"
        parts.append(f"SELECT {q(f)} AS feature, coalesce({v}, 'NULL') AS value, pi FROM {src}")
    return " UNION ALL ".join(parts)


def iv_table_sql(features) -> str:
    return f"""SELECT feature, value, "all", good, bad, "all" / n_ AS share, bad / "all" AS bad_rate,
  dist_good, dist_bad, woe, woe * (dist_good - dist_bad) AS iv
FROM (SELECT *, CASE WHEN dist_good > 0 AND dist_bad > 0 THEN ln(dist_good / dist_bad) ELSE 0e0 END AS woe
      FROM (SELECT c.*, n_, b_, ("all" - bad) / (n_ - b_) AS dist_good, bad / b_ AS dist_bad
            FROM (SELECT feature, value, count(*) AS "all", count(*) FILTER (WHERE pi = 0) AS good,
                         count(*) FILTER (WHERE pi = 1) AS bad
                  FROM ({_iv_long(features)}) GROUP BY feature, value) c
            JOIN (SELECT feature, CAST(sum("all") AS DOUBLE) AS n_, CAST(sum(bad) AS DOUBLE) AS b_
                  FROM (SELECT feature, count(*) AS "all", count(*) FILTER (WHERE pi = 1) AS bad
                        FROM ({_iv_long(features)}) GROUP BY feature, value) GROUP BY feature) t USING (feature)))"""


IV_DOUBLES = {"share", "bad_rate", "dist_good", "dist_bad", "woe", "iv"}


def iv_by_feature_sql() -> str:
    return f"SELECT feature, {r6('sum(iv)')} AS iv FROM ({iv_table_sql(C.CLEAN_FEATURES)}) GROUP BY feature"


def numeric_values(features, src: str = "clean") -> str:
    return " UNION ALL ".join(f"SELECT {q(f)} AS feature, CAST({f} AS DOUBLE) AS x, pi FROM {src}" for f in features)


def category_values(features, src: str = "clean") -> str:
    return " UNION ALL ".join(f"SELECT {q(f)} AS feature, CAST({f} AS VARCHAR) AS x, pi FROM {src}" for f in features)


def prebin_ctes(values: str, by_rate: bool, tag: str = "") -> str:
    """CTEs up to pb{tag}(feature, x, n, bad, rate, pb): pre-bins by cumulative share, merged forward
    to 5% of the rows; x and pb NULL for the missing row."""
    order = "rate, x" if by_rate else "x"
    return f"""v{tag} AS (SELECT feature, x, count(*) AS n, count(*) FILTER (WHERE pi = 1) AS bad,
  count(*) FILTER (WHERE pi = 1) / count(*) AS rate FROM ({values}) GROUP BY feature, x),
raw{tag} AS (SELECT *, CAST(20 * (sum(n) OVER (PARTITION BY feature ORDER BY {order}) - n)
                 // sum(n) OVER (PARTITION BY feature) AS INTEGER) AS r FROM v{tag} WHERE x IS NOT NULL),
rp{tag} AS (SELECT feature, r, sum(n) AS n, row_number() OVER (PARTITION BY feature ORDER BY r) AS ord,
                   sum(sum(n)) OVER (PARTITION BY feature) AS total FROM raw{tag} GROUP BY feature, r),
mg{tag}(feature, r, ord, g, held) AS (
  SELECT feature, r, ord, 0, n FROM rp{tag} WHERE ord = 1
  UNION ALL
  SELECT p.feature, p.r, p.ord, m.g + CAST(m.held * 20 >= p.total AS INTEGER),
         CASE WHEN m.held * 20 >= p.total THEN p.n ELSE m.held + p.n END
  FROM mg{tag} m JOIN rp{tag} p ON p.feature = m.feature AND p.ord = m.ord + 1),
fin{tag} AS (SELECT feature, max(g) - CAST(max_by(held, ord) * 20 < any_value(total) AND max(g) > 0 AS INTEGER) AS top
             FROM mg{tag} JOIN rp{tag} USING (feature, r, ord) GROUP BY feature),
pb{tag} AS (SELECT feature, x, n, bad, rate, least(g, top) AS pb
            FROM raw{tag} JOIN mg{tag} USING (feature, r) JOIN fin{tag} USING (feature)
            UNION ALL SELECT feature, x, n, bad, rate, NULL FROM v{tag} WHERE x IS NULL)"""


def fit_ctes(trends: str, tag: str = "") -> str:
    """CTEs up to best{tag}(feature, starts, iv, nb): every strictly monotone segmentation of the
    pre-bins is walked; the missing row counts in totals and IV.  ``trends``: (feature, trend)."""
    iv = """CASE WHEN {n} - {b} > 0 AND {b} > 0 AND nt > bt AND bt > 0 THEN
            (({n} - {b}) / (nt - bt) - {b} / bt) * ln((({n} - {b}) / (nt - bt)) / ({b} / bt)) ELSE 0e0 END"""
    return f"""pc{tag} AS (SELECT feature, pb, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM pb{tag} GROUP BY ALL),
tot{tag} AS (SELECT feature, trend, sum(n) AS nt, sum(bad) AS bt, max(pb) AS mp,
                    coalesce(sum(n) FILTER (WHERE pb IS NULL), 0e0) AS nm, coalesce(sum(bad) FILTER (WHERE pb IS NULL), 0e0) AS bm
             FROM pc{tag} JOIN ({trends}) t USING (feature) GROUP BY feature, trend),
segs{tag} AS (SELECT a.feature, a.pb AS s, b.pb AS e, sum(c.n) AS n, sum(c.bad) AS bad
         FROM pc{tag} a JOIN pc{tag} b ON a.feature = b.feature AND a.pb <= b.pb
         JOIN pc{tag} c ON c.feature = a.feature AND c.pb BETWEEN a.pb AND b.pb GROUP BY ALL),
segiv{tag} AS (SELECT feature, trend, s, e, n, bad, {iv.format(n='n', b='bad')} AS iv FROM segs{tag} JOIN tot{tag} USING (feature)),
walk{tag}(feature, trend, s, e, n, bad, iv, starts, nb) AS (
  SELECT feature, trend, s, e, n, bad, iv, CAST(s AS VARCHAR), 1 FROM segiv{tag} WHERE s = 0
  UNION ALL
  SELECT w.feature, w.trend, g.s, g.e, g.n, g.bad, w.iv + g.iv, w.starts || ',' || CAST(g.s AS VARCHAR), w.nb + 1
  FROM walk{tag} w JOIN segiv{tag} g ON g.feature = w.feature AND g.s = w.e + 1
  WHERE CASE WHEN w.trend = 'ascending' THEN w.bad * g.n < g.bad * w.n ELSE w.bad * g.n > g.bad * w.n END),
best{tag} AS (SELECT feature, starts, iv + {iv.format(n='nm', b='bm')} AS iv, nb FROM walk{tag} JOIN tot{tag} USING (feature, trend)
  WHERE e = mp QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(iv, 10) DESC, nb, starts) = 1)"""


def prebin_sql() -> str:
    body = f"""SELECT feature, pb, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad,
  {r6('max(x)')} AS hi FROM pb GROUP BY feature, pb"""
    return with_base(body, prebin_ctes(numeric_values(C.PREBIN_FEATURES), False), recursive=True)


def prebin_tree_sql() -> str:
    """Every node of the trees, level by level: a node is cut where the Gini impurity falls most, both sides
    keeping 5% of the rows.  The leaves are the nodes that hold no other node."""
    impure = "(({b}) * ({b}) + ({n} - ({b})) * ({n} - ({b}))) / ({n})"
    left = impure.format(n="CAST(cn - sn AS DOUBLE)", b="CAST(cb - sb AS DOUBLE)")
    right = impure.format(n="CAST(en - cn AS DOUBLE)", b="CAST(eb - cb AS DOUBLE)")
    extra = f"""v AS (SELECT feature, x, count(*) AS n, count(*) FILTER (WHERE pi = 1) AS bad
  FROM ({numeric_values(C.PREBIN_FEATURES)}) GROUP BY feature, x),
run AS (SELECT feature, x, CAST(sum(n) OVER w AS BIGINT) AS cn, CAST(sum(bad) OVER w AS BIGINT) AS cb
  FROM v WHERE x IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY x)),
tot AS (SELECT feature, max(cn) AS n, max(cb) AS b, max(x) AS hi, CAST(ceil(0.05e0 * max(cn)) AS BIGINT) AS least
  FROM run GROUP BY feature),
tree(feature, sn, sb, en, eb, hi) AS (
  SELECT feature, CAST(0 AS BIGINT), CAST(0 AS BIGINT), n, b, hi FROM tot
  UNION ALL
  SELECT feature, CASE WHEN side = 0 THEN sn ELSE cn END, CASE WHEN side = 0 THEN sb ELSE cb END,
    CASE WHEN side = 0 THEN cn ELSE en END, CASE WHEN side = 0 THEN cb ELSE eb END, CASE WHEN side = 0 THEN x ELSE hi END
  FROM (SELECT t.*, r.cn, r.cb, r.x, row_number() OVER (PARTITION BY t.feature, t.sn ORDER BY {left} + {right} DESC, r.cn) AS k
        FROM tree t JOIN run r ON r.feature = t.feature JOIN tot ON tot.feature = t.feature
        WHERE r.cn - t.sn >= least AND t.en - r.cn >= least AND t.eb - t.sb > 0 AND t.eb - t.sb < t.en - t.sn) c,
       (VALUES (0), (1)) s(side) WHERE k = 1),
leaf AS (SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree u WHERE u.feature = t.feature AND u.sn >= t.sn
  AND u.en <= t.en AND u.en - u.sn < t.en - t.sn))"""
    return with_base(f"""SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY sn) - 1 AS INTEGER) AS pb,
  en - sn AS n, eb - sb AS bad, {r6('hi')} AS hi FROM leaf
UNION ALL SELECT feature, NULL, n, bad, NULL FROM v WHERE x IS NULL""", extra, recursive=True)


def all_trends(features, trend: str) -> str:
    return " UNION ALL ".join(f"SELECT {q(f)} AS feature, {q(trend)} AS trend" for f in features)


def fit_sql(trend: str) -> str:
    extra = prebin_ctes(numeric_values(C.PREBIN_FEATURES), False) + ", " + fit_ctes(all_trends(C.PREBIN_FEATURES, trend))
    return with_base(f"SELECT feature, starts, {r6('iv')} AS iv FROM best", extra, recursive=True)


SEGMENT = "CAST(len([z FOR z IN string_split(starts, ',') IF z::INTEGER <= pb]) - 1 AS INTEGER)"


def category_fit_sql() -> str:
    branded = """branded AS (SELECT clean.*, brand FROM clean LEFT JOIN (
  SELECT l_orderkey, min(p_brand) AS brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) b
  ON b.l_orderkey = app_id)"""
    extra = ", ".join([branded, prebin_ctes(category_values(C.CATEGORY_FEATURES, "branded"), True),
                       fit_ctes(all_trends(C.CATEGORY_FEATURES, "ascending"))])
    return with_base(f"""SELECT feature, x AS value, n, bad, CASE WHEN pb IS NOT NULL THEN {SEGMENT} END AS bin_id, pb,
  {r6('iv')} AS iv FROM pb JOIN best USING (feature)""", extra, recursive=True)


def screen_sql() -> str:
    """Status of every feature with a direction, over the cleaned table."""
    nums = {"acct_bal": "descending", "avg_disc": "ascending", "n_items": "ascending", "qty": "ascending",
            "total_price": "ascending"}
    cats = ["is_f", "priority", "segment"]
    trends = " UNION ALL ".join(f"SELECT {q(f)} AS feature, {q(t)} AS trend" for f, t in nums.items())
    extra = ", ".join([prebin_ctes(numeric_values(nums), False, "_n"), fit_ctes(trends, "_n"),
                       prebin_ctes(category_values(cats), True, "_c"), fit_ctes(all_trends(cats, "ascending"), "_c")])
    return with_base(f"""SELECT feature, CASE WHEN iv > 0.01e0 AND iv < 1e0 THEN 'selected' ELSE 'rejected: iv outside band' END AS status,
  CAST(nb AS INTEGER) AS n_bins, {r6('iv')} AS iv FROM (SELECT * FROM best_n UNION ALL SELECT * FROM best_c)""",
                     extra, recursive=True)


def missing_fit_sql() -> str:
    """Whole bin tables of the two features whose missing rows follow the target."""
    gaps = """gaps AS (SELECT *, CASE WHEN NOT gap THEN CAST(app_id * 31 % 1000 AS DOUBLE) END AS gap_num,
  CASE WHEN NOT gap THEN 'g' || CAST(app_id * 17 % 6 AS VARCHAR) END AS gap_cat
  FROM (SELECT *, (pi = 1 AND app_id % 10 < 7) OR (pi = 0 AND app_id % 10 < 2) AS gap FROM clean))"""
    extra = ", ".join([gaps, prebin_ctes(numeric_values(["gap_num"], "gaps"), False, "_n"),
                       fit_ctes(all_trends(["gap_num"], "descending"), "_n"),
                       prebin_ctes(category_values(["gap_cat"], "gaps"), True, "_c"),
                       fit_ctes(all_trends(["gap_cat"], "ascending"), "_c"), f"""
placed AS (SELECT feature, x, NULL::VARCHAR AS c, n, bad, rate, CASE WHEN pb IS NOT NULL THEN {SEGMENT} END AS b FROM pb_n JOIN best_n USING (feature)
  UNION ALL SELECT feature, NULL, x, n, bad, rate, CASE WHEN pb IS NOT NULL THEN {SEGMENT} END FROM pb_c JOIN best_c USING (feature)),
edges AS (SELECT feature, b, max(x) AS hi, lag(max(x)) OVER (PARTITION BY feature ORDER BY b) AS lo,
                 max(b) OVER (PARTITION BY feature) AS top, string_agg(chr(39) || c || chr(39), ' ' ORDER BY rate, c) AS names,
                 sum(n) AS n, sum(bad) AS bad FROM placed WHERE b IS NOT NULL GROUP BY feature, b),
lines AS (SELECT feature, b AS position, CASE WHEN names IS NOT NULL THEN '[' || names || ']'
            ELSE '(' || CASE WHEN b = 0 THEN '-inf' ELSE lo::VARCHAR END || ', '
                 || CASE WHEN b = top THEN 'inf' ELSE hi::VARCHAR END || ']' END AS label, n, bad FROM edges
  UNION ALL SELECT DISTINCT feature, 1000, 'Special', 0, 0 FROM edges
  UNION ALL SELECT feature, 1001, 'Missing', sum(n), sum(bad) FROM placed WHERE b IS NULL GROUP BY feature),
sh AS (SELECT *, (n - bad) / CAST(sum(n - bad) OVER (PARTITION BY feature) AS DOUBLE) AS dg,
              bad / CAST(sum(bad) OVER (PARTITION BY feature) AS DOUBLE) AS db,
              CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS total FROM lines),
w AS (SELECT *, CASE WHEN dg > 0 AND db > 0 THEN ln(dg / db) ELSE 0e0 END AS woe FROM sh),
full_table AS (SELECT feature, position, label, n, n / total AS n_pct, n - bad AS non_event, bad AS event,
                      bad / nullif(n, 0) AS event_rate, woe, woe * (dg - db) AS iv FROM w
  UNION ALL SELECT feature, 1002, 'Totals', sum(n), 1e0, sum(n - bad), sum(bad), sum(bad) / sum(n), NULL, sum(woe * (dg - db))
            FROM w GROUP BY feature)"""])
    return with_base(f"""SELECT feature || '_cat' AS feature, CAST(position AS INTEGER) AS position, label, CAST(n AS BIGINT) AS n,
  {r6('n_pct')} AS n_pct, CAST(non_event AS BIGINT) AS non_event, CAST(event AS BIGINT) AS event, {r6('event_rate')} AS event_rate,
  {r6('woe')} AS woe, {r6('iv')} AS iv FROM full_table""", extra, recursive=True)


def bin_table_sql() -> str:
    feats = [cat_name(b.feature) for b in FX.SCORECARD_BINS]
    lv = " UNION ALL ".join(f"SELECT {q(f)} AS feature, {f} AS label, pi FROM binned" for f in feats)
    return f"""SELECT feature, label, n, n / n_ AS n_pct, non_event, event, event / n AS event_rate,
  woe, woe * (dne - de) AS iv
FROM (SELECT *, CASE WHEN dne > 0 AND de > 0 THEN ln(dne / de) ELSE 0e0 END AS woe
      FROM (SELECT a.*, n_, non_event / ne_ AS dne, event / e_ AS de
            FROM (SELECT feature, label, count(*) AS n, count(*) FILTER (WHERE pi = 0) AS non_event,
                         count(*) FILTER (WHERE pi = 1) AS event FROM ({lv}) GROUP BY ALL) a
            JOIN (SELECT feature, CAST(count(*) AS DOUBLE) AS n_,
                         CAST(count(*) FILTER (WHERE pi = 0) AS DOUBLE) AS ne_,
                         CAST(count(*) FILTER (WHERE pi = 1) AS DOUBLE) AS e_ FROM ({lv}) GROUP BY feature)
            USING (feature)))"""


BT_DOUBLES = {"n_pct", "event_rate", "woe", "iv"}
BT_COLS = ["feature", "label", "n", "n_pct", "non_event", "event", "event_rate", "woe", "iv"]


def one_hot_sql() -> str:
    levels = sorted(level_columns(FX.SCORECARD_BINS))
    cols = ", ".join(f"CASE WHEN {src} = {q(lab)} THEN 1 ELSE 0 END AS {name}" for name, src, lab in levels)
    return f"SELECT app_id, {cols}, pi FROM binned"


def onehot_cols() -> list[str]:
    return [n for n, _, _ in sorted(level_columns(FX.SCORECARD_BINS))] + ["pi"]


def corr_sql() -> str:
    cols = onehot_cols()
    pos = " UNION ALL ".join(f"SELECT {q(c)} AS col, {i} AS pos" for i, c in enumerate(cols))
    return f"""SELECT a, b, round_even(CASE WHEN va > 0 AND vb > 0 THEN (nn * sab - sa * sb) / sqrt(va * vb) END, 2) AS corr
FROM (SELECT p.a, p.b, p.sab, x.nn, x.s AS sa, y.s AS sb, x.nn * x.q - x.s * x.s AS va, y.nn * y.q - y.s * y.s AS vb
      FROM (SELECT x.col AS a, y.col AS b, CAST(sum(x.v * y.v) AS DOUBLE) AS sab
            FROM lng x JOIN lng y ON x.app_id = y.app_id
            JOIN ({pos}) px ON px.col = x.col JOIN ({pos}) py ON py.col = y.col
            WHERE px.pos < py.pos GROUP BY ALL) p
      JOIN st x ON x.col = p.a JOIN st y ON y.col = p.b)"""


def corr_ctes() -> str:
    return (f"oh AS ({one_hot_sql()}), lng AS (UNPIVOT oh ON COLUMNS(* EXCLUDE (app_id)) INTO NAME col VALUE v), "
            "st AS (SELECT col, CAST(count(*) AS DOUBLE) AS nn, CAST(sum(v) AS DOUBLE) AS s, "
            "CAST(sum(v * v) AS DOUBLE) AS q FROM lng GROUP BY col), "
            f"pairs AS ({corr_sql()})")


def prune_sql(thr: float) -> str:
    cols = onehot_cols()
    pos = " UNION ALL ".join(f"SELECT {q(c)} AS feature" for c in cols)
    return f"""SELECT f.feature, CASE WHEN d.feature IS NULL THEN 1 ELSE 0 END AS kept
FROM ({pos}) f LEFT JOIN (
  SELECT DISTINCT CASE WHEN coalesce(abs(tj.tc) > abs(ti.tc), false) THEN p.b ELSE p.a END AS feature
  FROM pairs p
  LEFT JOIN (SELECT a AS f, corr AS tc FROM pairs WHERE b = 'pi' UNION ALL SELECT 'pi', 1e0) tj ON tj.f = p.a
  LEFT JOIN (SELECT a AS f, corr AS tc FROM pairs WHERE b = 'pi' UNION ALL SELECT 'pi', 1e0) ti ON ti.f = p.b
  WHERE abs(p.corr) > {num(thr)}) d ON d.feature = f.feature"""


def ks_split_sql(score: str) -> str:
    g = (f"SELECT {SPLIT} AS split, score, count(*) AS n, count(*) FILTER (WHERE pi = 0) AS good, "
         f"count(*) FILTER (WHERE pi = 1) AS bad FROM (SELECT app_id, pi, {score} AS score FROM clean) GROUP BY ALL")
    return f"SELECT split, round_even(max(ks), 4) AS ks FROM ({ks_sql(g, 'score', False, by='split')}) GROUP BY split"


def grid_flag_sql() -> str:
    """All fits of the grid on one 0/1 column.  With n, y rows and bads off (0) and on (1), a fit moves the two
    bad rates towards each other by s / (C n): s is the sign of the coefficient for L1, until the rates meet,
    and the coefficient itself for L2, found by bisection."""
    flat = next(b for b in FX.SCORECARD_BINS if b.feature == C.FLAT_FEATURE)
    on = f"CASE WHEN priority IN ({', '.join(q(v) for v in flat.groups[0])}) THEN 1 ELSE 0 END"
    grid = ", ".join(f"({k}, {q(p)}, {num(c)})" for k, (p, c) in enumerate(
        (p, c) for p in C.M.PENALTIES for c in C.M.C_VALUES))
    p_on, p_off = "((y1 - (lo + hi) / 2 / c) / n1)", "((y0 + (lo + hi) / 2 / c) / n0)"
    # above the root of logit(p_on) - logit(p_off) - w, which falls as w rises
    above = f"""CASE WHEN {p_on} <= 0 OR {p_off} >= 1 THEN true WHEN {p_on} >= 1 OR {p_off} <= 0 THEN false
  ELSE ln({p_on} / (1 - {p_on})) - ln({p_off} / (1 - {p_off})) < (lo + hi) / 2 END"""
    extra = f"""flag AS (SELECT {SPLIT} AS split, CAST(count(*) FILTER (WHERE {on} = 0) AS DOUBLE) AS n0,
  CAST(sum(pi) FILTER (WHERE {on} = 0) AS DOUBLE) AS y0, CAST(count(*) FILTER (WHERE {on} = 1) AS DOUBLE) AS n1,
  CAST(sum(pi) FILTER (WHERE {on} = 1) AS DOUBLE) AS y1 FROM clean GROUP BY ALL),
grid(grid_order, penalty, c) AS (VALUES {grid}),
cell AS (SELECT * EXCLUDE (split), sign(y1 / n1 - y0 / n0) AS s,
  ln(y1 / (n1 - y1)) - ln(y0 / (n0 - y0)) AS w FROM grid, flag WHERE split = 'train'),
half AS (
  SELECT grid_order, c, n0, y0, n1, y1, least(0e0, w) AS lo, greatest(0e0, w) AS hi, 0 AS i FROM cell WHERE penalty = 'l2'
  UNION ALL
  SELECT grid_order, c, n0, y0, n1, y1, CASE WHEN {above} THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN {above} THEN (lo + hi) / 2 ELSE hi END, i + 1 FROM half WHERE i < 60),
fit AS (
  SELECT grid_order, {p_off} AS rate_off, {p_on} AS rate_on FROM half WHERE i = 60
  UNION ALL
  SELECT grid_order, CASE WHEN met THEN (y0 + y1) / (n0 + n1) ELSE off_ END, CASE WHEN met THEN (y0 + y1) / (n0 + n1) ELSE on_ END
  FROM (SELECT *, (y0 + s / c) / n0 AS off_, (y1 - s / c) / n1 AS on_, s * ((y1 - s / c) / n1 - (y0 + s / c) / n0) <= 0 AS met
        FROM cell WHERE penalty = 'l1')),
ks AS (SELECT split, round_even(abs(y1 / (y0 + y1) - (n1 - y1) / (n0 + n1 - y0 - y1)), 4) AS ks FROM flag),
rated AS (SELECT g.*, rate_off, rate_on, CASE WHEN rate_off = rate_on THEN 0e0 ELSE a.ks END AS ks_train,
  CASE WHEN rate_off = rate_on THEN 0e0 ELSE b.ks END AS ks_validation
FROM grid g JOIN fit USING (grid_order), ks a, ks b WHERE a.split = 'train' AND b.split = 'test')"""
    return with_base("""SELECT grid_order, penalty, c, round(rate_off, 6) AS rate_off, round(rate_on, 6) AS rate_on, ks_train,
  ks_validation, round(ks_validation - abs(ks_train - ks_validation), 4) AS quality FROM rated""", extra, recursive=True)


def ppt_sql(origin: bool) -> str:
    o = 1 if origin else 0
    mo = f"exp((CAST(score AS DOUBLE) - {OFFSET}) / {FACTOR})"
    return f"""SELECT score AS cutoff_score, {r6(f'(nn - n_le) / (nn + {o})')} AS approval_rate,
  {r6(mo)} AS marginal_odds_ratio, {r6(f'{mo} / (1e0 + {mo})')} AS marginal_good_rate,
  {r6('ga')} AS good_rate_accepted, {r6('CASE WHEN ga = 1 THEN NULL ELSE ga / (1e0 - ga) END')} AS odds_accepted,
  {r6('gr')} AS good_rate_rejected, {r6('CASE WHEN gr = 1 THEN NULL ELSE gr / (1e0 - gr) END')} AS odds_rejected
FROM (SELECT *, (gg - g_le + good) / ((nn - n_le + n) + {o} * CAST(score = mn AS INTEGER)) AS ga,
             coalesce(g_le / (n_le + {o}), 0e0) AS gr
      FROM (SELECT score, n, good, CAST(sum(n) OVER w AS DOUBLE) AS n_le, CAST(sum(good) OVER w AS DOUBLE) AS g_le,
                   CAST(sum(n) OVER () AS DOUBLE) AS nn, CAST(sum(good) OVER () AS DOUBLE) AS gg,
                   min(score) OVER () AS mn
            FROM grain WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def deciles_sql() -> str:
    g = """SELECT grp, count(*) AS n, count(*) FILTER (WHERE pi = 0) AS good, count(*) FILTER (WHERE pi = 1) AS bad
FROM (SELECT pi, (row_number() OVER (ORDER BY score, app_id) * 10 + count(*) OVER () - 1)
                 // count(*) OVER () AS grp FROM scored) GROUP BY grp"""
    return ks_sql(g, "grp", desc=False, index_group=True, keep_key=False)


def report_sql() -> str:
    """Rows of each report table."""
    lines = sum(len(b.labels) + (FX.SCORECARD_WEIGHTS[b.feature][1] is not None) for b in FX.SCORECARD_BINS) + 1
    return with_base(f"""SELECT 'scorecard' AS table_name, {lines}::BIGINT AS rows
UNION ALL SELECT 'ppt', count(*) FROM grain
UNION ALL SELECT 'missing_rate', {len(APP_COLUMNS)}
UNION ALL SELECT 'iv', {len(C.CLEAN_FEATURES)}
UNION ALL SELECT 'bins', {sum(len(b.labels) + 3 for b in FX.SCORECARD_BINS)}""")


def _all() -> dict[str, str]:
    sc_r = score_sql(list(FX.REDUCED_FEATURES))
    ks_score = rsel(["score"] + KS_COLS, KS_DOUBLES, KS_SCORE)
    origin_row = ("SELECT NULL::BIGINT AS score, 0e0 AS \"group\", 0::BIGINT AS good, 0::BIGINT AS bad, "
                  "0e0 AS good_distri, 0e0 AS bad_distri, 0e0 AS badrate, NULL::DOUBLE AS cumbadrate, "
                  "NULL::DOUBLE AS lift, 0e0 AS cumgood, 0e0 AS cumbad, 0e0 AS ks")
    scanned = "o_custkey, o_orderstatus, round(o_totalprice, 6) + 0e0 AS o_totalprice, o_orderpriority"
    bad_line = f"o_orderkey % {C.BAD_LINE} = 0"
    opt_raw = f"""SELECT {r6('g')} AS "group", {r6('round_even(lo + (hi - lo) * (pos - floor(pos)), 4)')} AS cutoff
FROM (SELECT g, pos,
        (SELECT z FROM zc WHERE zc.cn - zc.n <= floor(pos) AND floor(pos) < zc.cn) AS lo,
        (SELECT z FROM zc WHERE zc.cn - zc.n <= ceil(pos) AND ceil(pos) < zc.cn) AS hi
      FROM (SELECT cn / nn AS g, cn / nn * (nn - 1) AS pos FROM zc ORDER BY abs(cb / bb - cg / gg) DESC, cn LIMIT 1))"""
    opt_raw_ctes = f"""zc AS (SELECT z, n, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(bad) OVER w AS DOUBLE) AS cb,
  CAST(sum(good) OVER w AS DOUBLE) AS cg, CAST(sum(n) OVER () AS DOUBLE) AS nn, CAST(sum(bad) OVER () AS DOUBLE) AS bb,
  CAST(sum(good) OVER () AS DOUBLE) AS gg
FROM (SELECT z, count(*) AS n, count(*) FILTER (WHERE pi = 0) AS good, count(*) FILTER (WHERE pi = 1) AS bad
      FROM (SELECT {z_expr()} AS z, pi FROM clean) GROUP BY z)
WINDOW w AS (ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    cleaned_sel = ", ".join(CLEANED_COLUMNS)
    kind = lambda c: (f"(SELECT CASE WHEN coalesce(bool_and({c} IS NULL OR {c} IN (0, 1)), true) THEN 'categorical' "  # noqa: E731
                      "ELSE 'numeric' END FROM clean)")
    roles_data = " UNION ALL ".join(
        [f"SELECT {q(f)} AS feature, {kind(f)} AS kind" for f in NUMERIC_CLEANED + ["is_f"]]
        + [f"SELECT {q(f)}, 'categorical'" for f in ("priority", "segment")])
    dict_vals = ", ".join(f"({q(a)}, {q(b) if b is not None else 'NULL'}, {q(c)})" for a, b, c in FX.DICTIONARY_ROWS)
    role_case = """CASE WHEN (coalesce(contains(type, 'Num'), false) OR coalesce(type = 'Character (#,###.##)', false)) AND sign = '>' THEN 'num_desc'
  WHEN (coalesce(contains(type, 'Num'), false) OR coalesce(type = 'Character (#,###.##)', false)) AND sign = '<' THEN 'num_asc'
  WHEN coalesce(contains(type, 'Char') AND type <> 'Character (#,###.##)', false) AND sign = 'Y' THEN 'cat_y'
  WHEN coalesce(contains(type, 'Char') AND type <> 'Character (#,###.##)', false) AND sign = 'N' THEN 'cat_n' END"""
    dict_roles = f"""SELECT feature, role FROM (
  SELECT variable AS feature, {role_case} AS role FROM (VALUES {dict_vals}) t(variable, type, sign)
  UNION ALL SELECT 'avg_disc', 'num_asc') r
WHERE role IS NOT NULL AND EXISTS (SELECT 1 FROM ({roles_data}) d WHERE d.feature = r.feature
  AND d.kind = CASE WHEN r.role LIKE 'num%' THEN 'numeric' ELSE 'categorical' END)"""
    binary = lambda c: f"CASE WHEN coalesce(bool_and({c} IS NULL OR {c} IN (0, 1)), true) THEN 'categorical' ELSE 'numeric' END"
    roles = []
    for c in APP_COLUMNS:
        if c in ("app_id", "pi"):
            continue
        if c == "opened":
            roles.append(f"SELECT 'opened' AS feature, 'dropped' AS role")
        elif c in ("segment", "priority"):
            roles.append(f"SELECT {q(c)} AS feature, 'categorical' AS role")
        else:
            ident = '"MBID"' if c == "MBID" else c
            roles.append(f"SELECT {q(c)} AS feature, {binary(ident)} AS role FROM clean")
    sparse_feats = ["total_price", "acct_bal", "n_items", "qty", "avg_disc", "sparse_x", "segment", "priority", "is_f"]
    sparse = " UNION ALL ".join(
        f"SELECT {q(f)} AS feature, {r6(f'count(*) FILTER (WHERE {f} IS NULL) / count(*)')} AS null_fraction, "
        f"CAST(count(*) FILTER (WHERE {f} IS NULL) / count(*) > 0.95e0 AS INTEGER) AS dropped FROM clean"
        for f in sparse_feats)
    missing = " UNION ALL ".join(
        f"SELECT {q(f)} AS feature, {r6(f'round_even(count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) * 100')} AS missing_rate FROM app"
        for f, c in [(f, '"MBID"' if f == "MBID" else f) for f in APP_COLUMNS])
    card = " UNION ALL ".join(f"SELECT {q(f)} AS feature, count(DISTINCT {f}) AS n_distinct FROM clean"
                              for f in C.CLEAN_FEATURES)
    iv_vt = rsel(["feature", "value", '"all"', "good", "bad", "share", "bad_rate", "dist_good", "dist_bad", "woe", "iv"],
                 IV_DOUBLES, iv_table_sql(C.CLEAN_FEATURES))
    flat = next(b for b in FX.SCORECARD_BINS if b.feature == C.FLAT_FEATURE)
    flat_fit = f"""SELECT count(*) AS n, round(avg(CAST(pi AS DOUBLE)), 4) AS rate
FROM (SELECT pi, {label_case(flat)} AS lab FROM clean) GROUP BY lab"""
    part_grain = f"""SELECT app_id % {C.GRID_PARTS} AS part, score, count(*) AS n, count(*) FILTER (WHERE pi = 0) AS good,
  count(*) FILTER (WHERE pi = 1) AS bad FROM scored GROUP BY ALL"""
    best_part = f"""SELECT CAST(part AS INTEGER) AS grid_order, {r6('round_even(max(ks), 2)')} AS quality
FROM ({ks_sql(part_grain, 'score', False, by='part')}) GROUP BY part
ORDER BY round_even(max(ks), 2) DESC NULLS LAST, part LIMIT 1"""
    bt = rsel(BT_COLS, BT_DOUBLES, bin_table_sql())
    totals = f"""SELECT feature, label, n, n_pct, non_event, event, event_rate, woe, iv FROM ({bt})
UNION ALL
SELECT feature, 'Totals', CAST(sum(n) AS BIGINT), 1e0, CAST(sum(non_event) AS BIGINT), CAST(sum(event) AS BIGINT),
  {r6('sum(event) / sum(n)')}, NULL::DOUBLE, {r6('sum(iv)')} FROM ({bin_table_sql()}) GROUP BY feature"""
    num_cats = ", ".join(cat_name(b.feature) for b in C.NUM_BINS)
    kst_score = f"({KS_SCORE})"
    opt = f"""SELECT {r6('g')} AS "group", CAST(round_even(lo + (hi - lo) * (pos - floor(pos)), 0) AS DOUBLE) AS cutoff
FROM (SELECT g, pos,
        (SELECT score FROM c WHERE c.cn - c.n <= floor(pos) AND floor(pos) < c.cn) AS lo,
        (SELECT score FROM c WHERE c.cn - c.n <= ceil(pos) AND ceil(pos) < c.cn) AS hi
      FROM (SELECT g, g * (nn - 1) AS pos FROM
              (SELECT "group" AS g FROM {kst_score} ORDER BY ks DESC, "group" LIMIT 1),
              (SELECT CAST(sum(n) AS DOUBLE) AS nn FROM grain)))"""
    opt_ctes = "c AS (SELECT score, n, sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM grain)"
    roc = f"""SELECT {r6('-CAST(score AS DOUBLE)')} AS threshold, {r6('cg / gg')} AS fpr, {r6('cb / bb')} AS tpr
FROM (SELECT score, sum(good) OVER w AS cg, sum(bad) OVER w AS cb, CAST(sum(good) OVER () AS DOUBLE) AS gg,
             CAST(sum(bad) OVER () AS DOUBLE) AS bb FROM grain
      WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    auc_inner = """SELECT sum(CAST(bad AS DOUBLE) * (gg - cg) + 0.5e0 * bad * good) / (gg * bb) AS auc
FROM (SELECT score, good, bad, sum(good) OVER w AS cg, CAST(sum(good) OVER () AS DOUBLE) AS gg,
             CAST(sum(bad) OVER () AS DOUBLE) AS bb FROM grain
      WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY gg, bb"""
    auc = f"SELECT {r6('auc')} AS auc, {r6('100e0 * (2e0 * auc - 1e0)')} AS gini FROM ({auc_inner})"
    metrics = f"""SELECT {r6('round_even(100e0 * (SELECT max(ks) FROM ' + kst_score + '), 2)')} AS ks100,
  {r6('round_even(auc, 2)')} AS auc2, {r6('round_even(100e0 * (2e0 * auc - 1e0), 2)')} AS gini FROM ({auc_inner})"""
    hist = """SELECT CAST(least(coalesce(floor((score - lo) / ((hi - lo) / 80e0)), 0), 79) AS INTEGER) AS bin,
  count(*) FILTER (WHERE pi = 0) AS n_good, count(*) FILTER (WHERE pi = 1) AS n_bad
FROM scored, (SELECT min(score) AS lo, max(score) AS hi FROM scored) GROUP BY ALL"""
    string_sql = """SELECT p_partkey, lower(p_name) AS name_lower, ends_with(lower(p_name), 'widget') AS ends_widget,
  TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_no,
  TRY_CAST(CASE WHEN p_size % 3 = 0 THEN '.' ELSE CAST(p_size AS VARCHAR) END AS INTEGER) AS size_num FROM part"""
    z_grain = f"""SELECT z, count(*) AS n, count(*) FILTER (WHERE pi = 0) AS good,
      count(*) FILTER (WHERE pi = 1) AS bad FROM (SELECT {z_expr()} AS z, pi FROM clean) GROUP BY z"""
    ks_p1 = ks_sql(z_grain, "z", desc=True, keep_key=False)
    eval_proba = f"""SELECT {r6('round_even(100e0 * (SELECT max(ks) FROM (' + ks_p1 + ')), 2)')} AS ks100,
  {r6('round_even(auc, 2)')} AS auc2, {r6('round_even(100e0 * (2e0 * auc - 1e0), 2)')} AS gini FROM (
  SELECT sum(CAST(bad AS DOUBLE) * (gg - cg) + 0.5e0 * bad * good) / (gg * bb) AS auc
  FROM (SELECT z, good, bad, sum(good) OVER w AS cg, CAST(sum(good) OVER () AS DOUBLE) AS gg,
               CAST(sum(bad) OVER () AS DOUBLE) AS bb FROM ({z_grain})
        WINDOW w AS (ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY gg, bb)"""
    logit = f"(-{z_expr()})"
    quality = f"""SELECT name, ks_train, ks_test, {r6('ks_test - abs(ks_train - ks_test)')} AS quality FROM (
  SELECT 'full' AS name, max(ks) FILTER (WHERE split = 'train') AS ks_train, max(ks) FILTER (WHERE split = 'test') AS ks_test
  FROM ({ks_split_sql(score_sql())})
  UNION ALL
  SELECT 'reduced', max(ks) FILTER (WHERE split = 'train'), max(ks) FILTER (WHERE split = 'test')
  FROM ({ks_split_sql(sc_r)}))"""
    points_vals = []
    for b in FX.SCORECARD_BINS:
        ws, wn = FX.SCORECARD_WEIGHTS[b.feature]
        for lab, w in zip(b.labels, ws):
            points_vals.append(f"({q(cat_name(b.feature))}, {q(lab)}, {num(w)})")
        if wn is not None:
            points_vals.append(f"({q(cat_name(b.feature))}, {q(MISSING_LABEL)}, {num(wn)})")
    cats = [cat_name(b.feature) for b in FX.SCORECARD_BINS]
    lbl = " UNION ALL ".join(f"SELECT {q(c)} AS feature, {c} AS label FROM binned" for c in cats)
    sc_points = f"""SELECT p.feature, p.label, CAST(round_even(-{FACTOR} * p.w, 0) AS BIGINT) AS score, coalesce(c.n, 0) AS n
FROM (VALUES {', '.join(points_vals)}) p(feature, label, w)
LEFT JOIN (SELECT feature, label, count(*) AS n FROM ({lbl}) GROUP BY ALL) c USING (feature, label)
UNION ALL
SELECT 'Intercept', NULL, CAST(round_even({OFFSET} - {FACTOR} * {num(FX.SCORECARD_INTERCEPT)}, 0) AS BIGINT), count(*) FROM app"""
    return {
        "scan_csv": f"SELECT CASE WHEN {bad_line} THEN NULL ELSE o_orderkey END AS o_orderkey, {scanned}, {bad_line} AS bad FROM orders",
        "scan_csv_lines": " UNION ALL ".join(
            f"SELECT {q(c)} AS feature, count(*) AS lines, count(*) FILTER (WHERE {bad_line}) AS bad, count(*) FILTER (WHERE "
            + (f"{bad_line} OR " if c == "o_orderkey" else "") + f"{c} IS NULL) AS nulls FROM orders" for c in C.ORDER_COLUMNS),
        "scan_parquet": f"SELECT o_orderkey, {scanned} FROM orders",
        "report_run_name": "SELECT o_orderkey, 'demo_' || strftime(o_orderdate, '%d-%m-%Y_%H-%M-%S') AS run_name FROM orders",
        "table_shape": with_base(f"""SELECT (SELECT count(*) FROM app) AS n_rows, {len(APP_COLUMNS)} AS n_cols,
  (SELECT min(app_id) FROM (SELECT app_id FROM app ORDER BY app_id LIMIT 5)) AS first_id"""),
        "column_widths": with_base(" UNION ALL ".join(
            f"SELECT {q(c)} AS feature, CAST(max(length({exported(c)})) AS BIGINT) AS max_len FROM app"
            for c in APP_COLUMNS)),
        "null_sentinels": with_base("SELECT app_id, segment FROM clean"),
        "clean_columns": with_base(
            "SELECT " + ", ".join(r6(c) + f" AS {c}" if c in DOUBLE_COLUMNS else c for c in CLEANED_COLUMNS)
            + " FROM clean"),
        "sparse_columns": with_base(sparse),
        "exclude_columns": with_base(
            "SELECT " + ", ".join((r6(c) + f" AS {c}") if c in DOUBLE_COLUMNS else c
                                  for c in APP_COLUMNS if c not in FX.EXCLUDED) + " FROM app"),
        "column_roles": with_base(" UNION ALL ".join(roles)),
        "dict_roles": with_base(dict_roles),
        "new_predictors": with_base(f"""SELECT feature FROM ({roles_data}) WHERE kind = 'numeric'
  AND feature NOT IN (SELECT variable FROM (VALUES {dict_vals}) t(variable, type, sign))"""),
        "join_target": with_base(
            "SELECT c.app_id, " + ", ".join(f"{r6('c.' + f)} AS {f}" if f in DOUBLE_COLUMNS else f"c.{f}"
                                          for f in NUMERIC_CLEANED)
            + ", a.pi FROM clean c JOIN (SELECT app_id, pi FROM app) a USING (app_id)"),
        "missing_rate": with_base(missing),
        "iv_value_table": with_base(f"SELECT *, row_number() OVER (ORDER BY feature, value) AS position FROM ({iv_vt})"),
        "iv_by_feature": with_base(iv_by_feature_sql()),
        "iv_select": with_base(f"SELECT * FROM ({iv_by_feature_sql()}) WHERE iv > 0.01e0 AND iv < 1e0"),
        "feature_cardinality": with_base(card),
        "prebin_tree": prebin_tree_sql(),
        "prebin_counts": prebin_sql(),
        "bin_fit_asc": fit_sql("ascending"),
        "bin_fit_desc": fit_sql("descending"),
        "bin_fit_categorical": category_fit_sql(),
        "bin_fit_missing": missing_fit_sql(),
        "bin_fit_all": screen_sql(),
        "report_tables": report_sql(),
        "stream_score": with_base("SELECT app_id, score FROM scored"),
        "stream_binned": with_base("SELECT * FROM binned"),
        "fit_logistic": with_base(flat_fit),
        "grid_search_flag": grid_flag_sql(),
        "grid_best": with_base(best_part),
        "bin_table": with_base(bt),
        "bin_totals_rollup": with_base(totals),
        "bin_members_array": with_base("""SELECT bin_id, CAST(count(DISTINCT priority) AS INTEGER) AS size,
  string_agg(DISTINCT priority, ',' ORDER BY priority) AS members, bool_or(priority = '1-URGENT') AS has_urgent
FROM (SELECT CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS bin_id, priority
      FROM clean WHERE priority IS NOT NULL) GROUP BY bin_id"""),
        "bin_apply_numeric": with_base(f"SELECT app_id, {num_cats} FROM binned"),
        "bin_range_join": with_base(f"SELECT app_id, {num_cats} FROM binned"),
        "bin_apply_categorical": with_base(
            "SELECT app_id, " + ", ".join(cat_name(b.feature) for b in C.CAT_BINS) + " FROM binned"),
        "presence_flag": with_base("SELECT app_id, CASE WHEN segment IS NULL THEN 'NaN' ELSE 'not NaN' END AS segment_cat FROM clean"),
        "presence_features": with_base(
            f"SELECT feature FROM ({roles_data}) WHERE kind = 'categorical' AND feature IN ("
            + ", ".join(q(x) for x in C.PRESENCE_LIST) + ")"),
        "binned_table": with_base("SELECT * FROM binned"),
        "one_hot": with_base(one_hot_sql()),
        "corr_pairs": with_base(f"SELECT a, b, {r6('corr')} AS corr FROM pairs", corr_ctes()),
        "corr_prune": with_base(prune_sql(C.CORR_THRESHOLD), corr_ctes()),
        "corr_after_prune": with_base(
            f"""SELECT a, b, {r6('corr')} AS corr FROM pairs
WHERE a IN (SELECT feature FROM ({prune_sql(C.CORR_THRESHOLD)}) WHERE kept = 1)
  AND b IN (SELECT feature FROM ({prune_sql(C.CORR_THRESHOLD)}) WHERE kept = 1)""", corr_ctes()),
        "train_test_split": with_base(
            f"SELECT {SPLIT} AS split, count(*) AS n, CAST(sum(pi) AS BIGINT) AS bad FROM app GROUP BY ALL"),
        "predict_proba": with_base(f"SELECT app_id, {r6(f'1e0 / (1e0 + exp(-{z_expr()}))')} AS p1 FROM clean"),
        "grid_quality": with_base(quality),
        "ks_by_split": with_base(ks_split_sql(score_sql())),
        "score_scaling": with_base(f"""SELECT app_id, {r6('logit')} AS logit, {r6('exp(logit)')} AS odds,
  {r6('exp(logit) / (1e0 + exp(logit))')} AS probs, {r6(f'{OFFSET} + {FACTOR} * logit')} AS score
FROM (SELECT app_id, {logit} AS logit FROM clean)"""),
        "scorecard_points": with_base(sc_points),
        "score_rows_wide": with_base("SELECT app_id, score FROM scored"),
        "score_rows_long": with_base("SELECT app_id, score FROM scored"),
        "scored_rows": with_base(
            "SELECT " + ", ".join((r6(c) + f" AS {c}") if c in DOUBLE_COLUMNS else (f'"{c}"' if c == "MBID" else c)
                                  for c in APP_COLUMNS)
            + f", {score_sql()} AS score FROM app"),
        "ranked_rows": with_base("SELECT app_id, row_number() OVER (ORDER BY score, app_id) AS rn FROM scored"),
        "ks_table": with_base(rsel(KS_COLS, KS_DOUBLES, ks_p1)),
        "ks_table_score": with_base(ks_score),
        "ks_table_deciles": with_base(rsel(KS_COLS, KS_DOUBLES, deciles_sql())),
        "ks_table_origin": with_base(f"{ks_score} UNION ALL {origin_row}"),
        "lift_table": with_base(rsel(['"group"', "badrate", "cumbadrate", "lift"], KS_DOUBLES, deciles_sql())),
        "ks_stat": with_base(f"SELECT {r6('round_even(max(ks), 4)')} AS ks FROM {kst_score}"),
        "ks_cutoff": with_base(f"SELECT * FROM ({ks_score}) ORDER BY ks DESC, \"group\" LIMIT 1"),
        "ks_curve": with_base(f"SELECT \"group\", ks, cumgood, cumbad FROM ({ks_score})"),
        "optimal_cutoff": with_base(opt, opt_ctes),
        "score_percentiles": with_base("SELECT " + ", ".join(
            f"{r6(f'quantile_cont(score, {qq})')} AS p{int(round(qq * 100))}" for qq in (0.1, 0.25, 0.5, 0.75, 0.9))
            + " FROM scored"),
        "optimal_cutoff_raw": with_base(opt_raw, opt_raw_ctes),
        "percentiles_raw": with_base("SELECT " + ", ".join(
            f"{r6(f'quantile_cont(z, {qq})')} AS p{int(round(qq * 100))}" for qq in (0.1, 0.25, 0.5, 0.75, 0.9))
            + f" FROM (SELECT {z_expr()} AS z FROM clean)"),
        "score_histogram": with_base(hist),
        "roc_curve": with_base(roc),
        "auc_gini": with_base(auc),
        "model_metrics": with_base(metrics),
        "model_eval_proba": with_base(eval_proba),
        "backfill_score": with_base(
            f"SELECT coalesce(score, (SELECT min(score) FROM grain)) AS score, * EXCLUDE (score) FROM ({ks_score} UNION ALL {origin_row})"),
        "ppt_table": with_base(f"SELECT *, row_number() OVER (ORDER BY cutoff_score DESC) AS position FROM ({ppt_sql(False)})"),
        "ppt_table_origin": with_base(f"SELECT *, row_number() OVER (ORDER BY cutoff_score DESC) AS position FROM ({ppt_sql(True)})"),
        "string_scalars": string_sql,
    }


def oracle_sql() -> dict[str, str]:
    return _all()
