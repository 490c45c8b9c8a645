"""Split, regularised logistic regression and the grid search.

* The split hashes the id with a seed (the first 32 bits of an MD5), so it is
  the same whatever the partitioning, on a rerun, or in SQL, for ids of any type.
* After pruning, rows that agree in every kept level are identical: the design
  is compressed on one small code per feature (pruned levels fold into one
  code) and the row count becomes ``weightCol``.  ``regParam`` still uses the row count.
* sklearn's objective ``pen(w) + C * sum(loss)`` equals Spark's
  ``mean(loss) + regParam * pen`` with ``regParam = 1 / (C * n)``
  (``elasticNetParam`` 1 for L1, 0 for L2), no standardisation, and an
  unpenalised intercept.
* The 36 fits run together: one Spark job per iteration sums the gradients and
  curvatures of all models that are not yet done, and the driver takes a
  (proximal) Newton step for each.  Their 72 KS values come from two passes over
  the compressed frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskcard.operators.encode import level_codes
from riskcard.plans.prefix import written
from riskcard.session import ship_code

# The reference grid.
PENALTIES = ["l1", "l2"]
C_VALUES = [0.001, 0.0025, 0.005, 0.0075, 0.01, 0.025, 0.05, 0.075, 0.1, 0.2, 0.3, 0.4, 0.5,
            0.6, 0.7, 0.8, 0.9, 1.0]
SUMS = 8_000_000            # numbers that the models of one job may sum (64 MB a task)
SLOTS = 32                  # partial sums that reach the driver
KS_INTERVALS = 4096
OTHER_CODE = -2             # a pruned level in the compressed design
ROUNDING = 1e-14            # of a sum, what adding its terms up may leave


def split_expr(id_col: str, train_fraction: float = 0.7, seed: int = 42):
    """'train' / 'test' from the id alone (K2)."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.when(h < int(train_fraction * 2**32), F.lit("train")).otherwise(F.lit("test"))


def train_test_split(df: DataFrame, id_col: str, train_fraction: float = 0.7, seed: int = 42) -> DataFrame:
    if not 0.0 < train_fraction < 1.0:
        raise ValueError("train_fraction must be in (0, 1)")
    return df.withColumn("split", split_expr(id_col, train_fraction, seed))


def compress_codes(coded: DataFrame, bins, features: list[str], target: str,
                   extra: list[str] | None = None) -> DataFrame:
    """Rows that agree in every kept one-hot column ``features`` collapsed to one weighted row,
    with those columns (section 4.4).  Groups by one folded code per feature."""
    kept: dict = {}
    for name, src, code in level_codes(bins):
        if name in set(features):
            kept.setdefault(src, []).append((name, code))
    folded = coded.select(*(extra or []), target, *[
        F.when(F.col(src).isin([c for _, c in lv]), F.col(src)).otherwise(F.lit(OTHER_CODE)).alias(src)
        for src, lv in kept.items()])
    g = folded.groupBy(*(extra or []), target, *kept).agg(F.count(F.lit(1)).cast("double").alias("w"))
    columns = {name: (F.col(src) == code).cast("int") for src, lv in kept.items() for name, code in lv}
    return g.select(*(extra or []), *[columns[f].alias(f) for f in features], target, "w")


def assemble(train: DataFrame, features: list[str], target: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol="_x").transform(train).select("_x", target, "w")


def fit_logistic(train: DataFrame, features: list[str], target: str, penalty: str, c: float,
                 n_rows: int, max_iter: int = 100, tol: float = 1e-6, assembled: bool = False):
    """One regularised fit on a compressed frame; returns (intercept, coefficients)."""
    from pyspark.ml.classification import LogisticRegression
    data = train if assembled else assemble(train, features, target)
    lr = LogisticRegression(featuresCol="_x", labelCol=target, weightCol="w",
                            regParam=1.0 / (c * n_rows), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                            standardization=False, fitIntercept=True, maxIter=max_iter, tol=tol,
                            family="binomial")
    m = lr.fit(data)
    return float(m.intercept), [float(v) for v in m.coefficients.toArray()]


def coef_frame(spark: SparkSession, features: list[str], intercept: float, coefs: list[float]) -> DataFrame:
    rows = [("Intercept", intercept)] + list(zip(features, coefs))
    return spark.createDataFrame(rows, "feature string, coef double")


def linear_column(features: list[str], intercept: float, coefs: list[float]):
    """Bad log-odds of a design row, by projection."""
    z = F.lit(float(intercept))
    for f, w in zip(features, coefs):
        z = z + F.col(f) * F.lit(float(w))
    return z


def ks_of_models(compressed: DataFrame, features: list[str], target: str, models: list,
                 intervals: int = KS_INTERVALS) -> dict:
    """{(model, split): ks} of many models over the compressed frame, exact, in two passes.

    A pandas UDF turns each Arrow batch of design rows into all models' P(bad) with one matrix
    product.  Pass 1 counts goods and bads per (model, split, interval of p): a bounded table.  Its
    running sums are exact at interval edges and bound KS inside.  Pass 2 ranks the distinct p of
    only those intervals that can still hold the maximum.
    """
    ship_code(compressed.sparkSession)
    coef = np.array([w for _, w in models], dtype=float).T          # features x models
    inter = np.array([b0 for b0, _ in models], dtype=float)

    @pandas_udf("array<double>")
    def probs(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        z = np.vstack(x.to_numpy()) @ coef + inter
        return pd.Series(list(1.0 / (1.0 + np.exp(-z))))

    xs = F.array(*[F.col(f).cast("double") for f in features])
    by = ["model", "split"]
    long = (compressed.select("split", "w", F.col(target).alias("_y"), probs(xs).alias("_p"))
            .select("split", "w", "_y", F.posexplode("_p").alias("model", "p"))
            .withColumn("k", F.least(F.floor(F.col("p") * intervals), F.lit(intervals - 1)).cast("int")))
    counts = [F.sum(F.when(F.col("_y") == 0, F.col("w")).otherwise(0.0)).alias("good"),
              F.sum(F.when(F.col("_y") == 1, F.col("w")).otherwise(0.0)).alias("bad")]
    # descending p; at most ``intervals`` rows per window
    down = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    edge = written(
        long.groupBy(*by, "k").agg(*counts)
        .withColumn("G", F.sum("good").over(whole)).withColumn("B", F.sum("bad").over(whole))
        .withColumn("g1", F.sum("good").over(down)).withColumn("b1", F.sum("bad").over(down))
        .withColumn("g0", F.col("g1") - F.col("good")).withColumn("b0", F.col("b1") - F.col("bad"))
        .withColumn("at_edge", F.abs(F.col("b1") / F.col("B") - F.col("g1") / F.col("G")))
        .withColumn("inside", F.greatest(F.col("b1") / F.col("B") - F.col("g0") / F.col("G"),
                                         F.col("g1") / F.col("G") - F.col("b0") / F.col("B")))
        .withColumn("best", F.max("at_edge").over(whole)), "ks-edges")
    # a bounded table (intervals x models x splits) that shrinks to a few intervals per model
    narrow = edge.where("inside > best").select(*by, "k", "G", "B", "g0", "b0")
    rest = (long.join(F.broadcast(narrow), [*by, "k"]).groupBy(*by, "k", "p", "G", "B", "g0", "b0").agg(*counts))
    inner = (Window.partitionBy(*by, "k").orderBy(F.desc("p"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fine = rest.select(*by, F.abs((F.col("b0") + F.sum("bad").over(inner)) / F.col("B")
                                  - (F.col("g0") + F.sum("good").over(inner)) / F.col("G")).alias("ks"))
    every = fine.unionByName(edge.select(*by, F.col("at_edge").alias("ks")))
    rows = every.groupBy(*by).agg(F.bround(F.max("ks"), 4).alias("ks")).collect()      # 2 rows per model
    return {(f"m{r['model']}", r["split"]): r["ks"] for r in rows}


ROWS_PER_FIT_PARTITION = 50_000
CHUNK_ROWS = 8_192


def _model_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """For every model (row of ``beta``, intercept first): log loss, its gradient and its curvature."""
    n, p = x.shape
    out = np.zeros((len(beta), 1 + p + p * p))
    for i in range(0, n, CHUNK_ROWS):
        xs, ys, ws = (v[i: i + CHUNK_ROWS] for v in (x, y, w))
        z = xs @ beta.T
        prob = 1.0 / (1.0 + np.exp(-z))
        out[:, 0] += ws @ (np.logaddexp(0.0, z) - ys[:, None] * z)
        out[:, 1: 1 + p] += ((prob - ys[:, None]) * ws[:, None]).T @ xs
        curve = prob * (1.0 - prob) * ws[:, None]
        for k in range(len(beta)):
            out[k, 1 + p:] += (xs.T @ (xs * curve[:, k: k + 1])).ravel()
    return out


def _summed_over(design: DataFrame, beta: np.ndarray) -> np.ndarray:
    """``_model_sums`` over all rows of a (y, w, x0, x1, ..) frame: one sum per task, then per slot."""
    ship_code(design.sparkSession)
    shape = (len(beta), 1 + beta.shape[1] + beta.shape[1] ** 2)

    def part(batches):
        total = np.zeros(shape)
        for b in batches:
            y, w, *cols = (np.asarray(c, dtype=float) for c in b.columns)
            total += _model_sums(np.column_stack([np.ones(len(y)), *cols]), y, w, beta)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches):
        total = np.zeros(shape)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += np.frombuffer(blob).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = design.mapInArrow(part, "sums binary")
    if design.rdd.getNumPartitions() > SLOTS:
        parts = parts.repartition(SLOTS).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(r.sums).reshape(shape) for r in parts.collect()), np.zeros(shape))


def _violation(beta: np.ndarray, grad: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Per model, by how much the optimality conditions are missed (penalty slope 1, free intercept)."""
    g, b = grad[:, 1:], beta[:, 1:]
    lasso = np.where(b != 0, np.abs(g + np.sign(b)), np.maximum(np.abs(g) - 1.0, 0.0))
    miss = np.where(l1[:, None], lasso, np.abs(g + b))
    return np.maximum(np.abs(grad[:, 0]), miss.max(axis=1, initial=0.0))


def _objective(beta: np.ndarray, loss: np.ndarray, c: np.ndarray, l1: np.ndarray) -> np.ndarray:
    b = beta[:, 1:]
    return c * loss + np.where(l1, np.abs(b).sum(axis=1), 0.5 * (b * b).sum(axis=1))


def _lasso_steps(beta: np.ndarray, grad: np.ndarray, curve: np.ndarray, sweeps: int = 2_000) -> np.ndarray:
    """Minimum of the quadratic model plus the L1 penalty, all models at a time.

    A sweep of coordinate descent finds the coefficients that are not zero and their signs; a Newton step
    over these, up to the first change of sign, then solves what single coordinates approach slowly (one-hot
    columns of a feature add up to the intercept).  Both only lower the objective.  A model is done when its
    optimality conditions hold as far as sums of the size of its curvature can tell."""
    new, slope = beta.copy(), grad.copy()             # slope: gradient of the quadratic model at ``new``
    diag = np.maximum(np.einsum("kjj->kj", curve), 1e-12)
    live = np.arange(len(beta))
    for _ in range(sweeps):
        for j in range(beta.shape[1]):
            h = diag[live, j]
            at = new[live, j] - slope[live, j] / h
            to = at if j == 0 else np.sign(at) * np.maximum(np.abs(at) - 1.0 / h, 0.0)
            step = to - new[live, j]
            new[live, j] = to
            slope[live] += curve[live, :, j] * step[:, None]
        for k in live:
            _same_sign_step(new[k], slope[k], curve[k])
        size = diag[live].max(axis=1) * np.maximum(np.abs(new[live]).max(axis=1), 1.0)
        live = live[_violation(new[live], slope[live], np.ones(len(live), bool)) > 1e-10 + ROUNDING * size]
        if not len(live):
            break
    return new


def _same_sign_step(b: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> None:
    """Move the intercept and the coefficients that are not zero (in place) to the minimum of the quadratic
    model plus the L1 penalty at their signs, or until the first of them is zero."""
    on = np.r_[0, 1 + np.flatnonzero(b[1:])]
    sign = np.r_[0.0, np.sign(b[on[1:]])]
    within = curve[np.ix_(on, on)]
    ridge = 1e-12 * (1.0 + np.abs(np.diag(within)).max())      # the columns may depend on each other
    down = slope[on] + sign
    move = -np.linalg.solve(within + ridge * np.eye(len(on)), down)
    bend = move @ within @ move
    far = -(down @ move) / bend if bend > 0 else np.inf
    cross = np.full(len(on), np.inf)
    back = move * sign < 0
    cross[back] = -b[on[back]] / move[back]
    first = int(np.argmin(cross))
    far = min(far, cross[first])
    if not 0 < far < np.inf:
        return
    to = b[on] + far * move
    if far == cross[first]:
        to[first] = 0.0
    slope += curve[:, on] @ (to - b[on])
    b[on] = to


def fit_models(train: DataFrame, features: list[str], target: str, models: list, max_iter: int = 100,
               tol: float = 1e-7):
    """[(intercept, coefficients)] of the (penalty, C) ``models``: minima of pen(w) + C * sum(loss) over a
    compressed frame, to ``tol`` in the optimality conditions (or ``max_iter`` iterations).

    Every iteration is one pass over the rows for all unfinished models.  A step that raises a model's
    objective is halved.  Models of very wide designs go in groups from small to large C, each started
    from the nearest C of its penalty."""
    # columns as small integers: the frame that all passes read
    design = train.select(F.col(target).cast("double").alias("y"), F.col("w").cast("double").alias("w"),
                          *[F.col(f).cast("byte").alias(f"x{k}") for k, f in enumerate(features)])
    rows = design.count()
    design = design.repartition(max(1, -(-rows // ROWS_PER_FIT_PARTITION))).cache()
    try:
        p = len(features) + 1
        good, bad = (design.agg(F.sum(F.col("w") * (1 - F.col("y"))), F.sum(F.col("w") * F.col("y"))).first()
                     if rows else (0, 0))
        start = np.zeros(p)
        start[0] = np.log(((bad or 0) + 0.5) / ((good or 0) + 0.5))
        fitted: dict[int, np.ndarray] = {}
        order = sorted(range(len(models)), key=lambda k: models[k][1])
        size = max(1, SUMS // (1 + p + p * p))
        for i in range(0, len(order), size):
            group = order[i: i + size]
            begin = []
            for k in group:
                same = [j for j in fitted if models[j][0] == models[k][0]]
                begin.append(fitted[max(same, key=lambda j: models[j][1])] if same else start)
            fitted.update(zip(group, _fit_group(design, np.array(begin), [models[k] for k in group], max_iter, tol)))
    finally:
        design.unpersist()
    return [(float(fitted[k][0]), [float(v) for v in fitted[k][1:]]) for k in range(len(models))]


def _fit_group(design: DataFrame, beta: np.ndarray, models: list, max_iter: int, tol: float) -> np.ndarray:
    c, l1 = np.array([m[1] for m in models], dtype=float), np.array([m[0] == "l1" for m in models])
    m, p = beta.shape
    best, value = beta.copy(), np.full(m, np.inf)
    step, trial = np.zeros((m, p)), beta.copy()
    live = np.arange(m)
    for _ in range(max_iter):
        sums = _summed_over(design, trial[live])
        loss, grad = sums[:, 0], sums[:, 1: 1 + p] * c[live, None]
        curve = sums[:, 1 + p:].reshape(-1, p, p) * c[live, None, None]
        now = _objective(trial[live], loss, c[live], l1[live])
        miss = _violation(trial[live], grad, l1[live])
        ok = (now <= value[live] + 1e-12 * np.abs(now)) | (miss < tol)
        back = live[~ok]
        step[back] /= 2
        trial[back] = best[back] + step[back]
        on = live[ok]
        best[on], value[on] = trial[on], now[ok]
        go = ok & (miss >= tol)
        todo = live[go]
        kind = l1[todo]
        new = best[todo].copy()
        if kind.any():
            new[kind] = _lasso_steps(best[todo[kind]], grad[go][kind], curve[go][kind])
        for at in np.flatnonzero(~kind):
            k = todo[at]
            ridge = np.eye(p)
            ridge[0, 0] = 1e-12
            slope = grad[go][at] + np.r_[0.0, best[k][1:]]
            new[at] = best[k] - np.linalg.solve(curve[go][at] + ridge, slope)
        step[todo] = new - best[todo]
        trial[todo] = new
        # done: within tolerance, or no step is left that lowers the objective
        live = np.array([k for k in live if k in set(back) | set(todo) and np.abs(step[k]).max() > 1e-13], dtype=int)
        if not len(live):
            break
    return best


def grid_search(spark: SparkSession, compressed: DataFrame, features: list[str], target: str,
                penalties=PENALTIES, c_values=C_VALUES, max_iter: int = 100):
    """36 fits; (grid table, fitted models).  Quality = KS_test - |KS_train - KS_test| (K4, K6-K8)."""
    grid = [(p, c) for p in penalties for c in c_values]
    models = fit_models(compressed.filter(F.col("split") == "train"), features, target, grid, max_iter)
    ks = ks_of_models(compressed, features, target, models)
    rows = []
    for k, (p, c) in enumerate(grid):
        ktr, kte = ks.get((f"m{k}", "train")), ks.get((f"m{k}", "test"))
        q = None if ktr is None or kte is None else kte - abs(ktr - kte)
        rows.append((k, p, float(c), ktr, kte, q))
    table = spark.createDataFrame(
        rows, "grid_order int, penalty string, c double, ks_train double, ks_validation double, quality double")
    return table, models


def grid_best(table: DataFrame) -> DataFrame:
    """Highest quality; ties go to the first in grid order."""
    return table.orderBy(F.desc_nulls_last("quality"), F.asc("grid_order")).limit(1)
