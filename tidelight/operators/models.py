"""Models over purged folds: distributed logistic regression, its scores and feature importances, and regressions from sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelight.sources.shared import drop_table, materialize, release_shuffles


#: Rows are numbered within so many ranges of a hash, each sorted by itself.
RANGE_BITS = 12


def numbered(df: DataFrame, group: str, by: str, ties: list[str]) -> DataFrame:
    """``df`` with ``_i``, the place of each row of a group in the order of a hash; no group is sorted in one task.

    The ranges are counted first; rows alike in the hash and in ``ties`` can stand for one another.
    """
    df = df.withColumn("_part", F.shiftright(F.col(by), 64 - RANGE_BITS))
    w = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over counts of the ranges alone
    before = df.groupBy(group, "_part").count().select(group, "_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(by, *ties))
    return df.withColumn("_i", place).join(F.broadcast(before), [group, "_part"]).withColumn("_i", F.col("_i") + F.col("_before")).drop("_part", "_before")


@dataclass
class Splits:
    """Rows written once for all fits: ``fit`` (features, label, weight, a bit of ``train`` for each fold) and ``held`` (of each fold's test rows the same, and the permuted features)."""

    features: list[str]
    folds: int
    fit: DataFrame
    held: DataFrame


def prepared(rows: DataFrame, features: list[str], label: str, weight: str, key: list[str], folds: int, roles: DataFrame | None = None, permute: bool = True, seed: int = 17) -> Splits:
    """Rows and roles as :class:`Splits`. ``roles``: ``key, test_fold, role`` from a purged splitter; without them rows have ``test`` (folds) and ``train`` (bits).

    All features of a test row are permuted together within the fold: values meet rows again by the rank of two different hashes of the key.
    """
    if folds > 62:
        raise ValueError("at most 62 folds")
    if roles is not None:
        in_fold = lambda role: F.col("role") == role
        sets = roles.groupBy(*key).agg(F.collect_set(F.when(in_fold("test"), F.col("test_fold").cast("int"))).alias("test"), F.coalesce(F.bit_or(F.when(in_fold("train"), F.expr("shiftleft(1L, cast(test_fold as int))"))), F.lit(0)).alias("train"))
        rows = rows.join(sets, key)
    names = [f"f{k}" for k in range(len(features))]
    columns = [F.col(c).cast("double").alias(n) for c, n in zip([*features, label, weight], [*names, "y", "w"], strict=True)]
    base = materialize(rows.select(*columns, "test", F.col("train").cast("long").alias("train"), F.xxhash64(*key, F.lit(seed)).alias("_a"), F.xxhash64(*key, F.lit(seed + 1)).alias("_b")), "splits")
    release_shuffles(base.sparkSession)
    held = base.select(*names, "y", "w", "_a", "_b", F.explode("test").alias("fold")).filter(F.col("fold") < folds)
    if permute:
        to = materialize(numbered(held.drop("_b"), "fold", "_a", [*names, "y", "w"]).drop("_a"), "split_rows")
        release_shuffles(base.sparkSession)
        of = materialize(numbered(held.select("fold", "_b", *names), "fold", "_b", names).select("fold", "_i", *[F.col(n).alias(f"p{n}") for n in names]), "split_values")
        release_shuffles(base.sparkSession)
        held = materialize(to.join(of, ["fold", "_i"]).drop("_i"), "split_held")
        drop_table(to)
        drop_table(of)
        release_shuffles(base.sparkSession)
    return Splits(list(features), folds, base.drop("test", "_a", "_b"), held)


def _matrix(batch, names: list[str]) -> np.ndarray:
    if any(batch.column(n).null_count for n in names):
        raise ValueError("a feature, label or weight is null")
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def _sums(table: DataFrame, f) -> dict[int, np.ndarray]:
    """Sums over all rows of what ``f`` (batch to arrays by number) gives; only they reach the driver."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in f(batch).items():
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()), "v": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    parts = table.mapInArrow(run, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for k in {r["k"] for r in parts}:
        out[k] = np.array([r["v"] for r in sorted((r for r in parts if r["k"] == k), key=lambda r: r["i"])])
    return out


def _loss_terms(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z) - y * z


def fitted(data: Splits, models: list[tuple[list[str], float]], most: int = 20) -> dict[tuple[int, int], np.ndarray]:
    """Coefficients, the intercept last, of each (model, fold): logistic regressions with an L2 penalty on standardised features, all by Newton steps over one scan each."""
    names = [f"f{k}" for k in range(len(data.features))]
    p, folds = len(names), data.folds

    def parts(batch):
        m, bits = _matrix(batch, [*names, "y", "w"]), batch.column("train").to_numpy(zero_copy_only=False)
        for fold in range(folds):
            take = m[(bits >> fold) & 1 == 1]
            yield fold, take[:, :p], take[:, p], take[:, p + 1]

    first = _sums(data.fit, lambda b: {k: np.r_[w.sum(), (w * w).sum(), w @ y, w @ x] for k, x, y, w in parts(b)})
    if any(first.get(k, np.zeros(1))[0] <= 0 for k in range(data.folds)):
        raise ValueError("a fold has no rows to train on")
    mean = {k: v[3:] / v[0] for k, v in first.items()}
    spread = _sums(data.fit, lambda b: {k: w @ (x - mean[k]) ** 2 for k, x, y, w in parts(b)})
    sd = {k: np.sqrt(spread[k] / max(first[k][0] - first[k][1] / first[k][0], 1e-300)) for k in first}

    which = {(m, k): [data.features.index(c) for c in models[m][0]] for m in range(len(models)) for k in range(data.folds)}
    numbers = {at: n for n, at in enumerate(which)}
    beta, done = {}, {}
    for (m, k), cols in which.items():
        total, share = first[k][0], first[k][2] / first[k][0]
        one_class = share <= 0 or share >= 1
        beta[m, k] = np.r_[np.zeros(len(cols)), (np.inf if share >= 1 else -np.inf) if one_class else np.log(share / (1 - share))]
        if one_class:
            done[m, k] = beta[m, k]
    best: dict = {}
    for _ in range(most):
        open_ = {at: beta[at] for at in which if at not in done}
        if not open_:
            break

        def terms(batch, open_=open_):
            out = {}
            for fold, x, y, w in parts(batch):
                z_all = np.where(sd[fold] > 0, (x - mean[fold]) / np.where(sd[fold] > 0, sd[fold], 1.0), 0.0)
                for (m, k), b in open_.items():
                    if k == fold:
                        v = np.column_stack([z_all[:, which[m, k]], np.ones(len(x))])
                        z = v @ b
                        q = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                        out[numbers[m, k]] = np.r_[w @ _loss_terms(z, y), v.T @ (w * (q - y)), (v.T @ (v * (w * q * (1 - q))[:, None])).ravel()]
            return out

        sums = _sums(data.fit, terms)
        for at, b in open_.items():
            total, n, penalty = first[at[1]][0], len(b), models[at[0]][1]
            ridge = np.r_[np.full(n - 1, penalty), 0.0]
            s = sums[numbers[at]] / total
            value = s[0] + (ridge * b * b).sum() / 2
            if at in best and not value <= best[at][0]:  # the step went too far, or there is nothing left to gain
                step = (b - best[at][1]) / 2
                if np.abs(step).max() < 1e-9:
                    done[at] = best[at][1]
                beta[at] = best[at][1] + step
                continue
            best[at] = (value, b)
            step = np.linalg.lstsq(s[1 + n :].reshape(n, n) + np.diag(ridge), s[1 : 1 + n] + ridge * b, rcond=None)[0]
            beta[at] = b - step
            if np.abs(step).max() < 1e-9:
                done[at] = b
    out = {}
    for (m, k), cols in which.items():
        b = done.get((m, k), best.get((m, k), (0, beta[m, k]))[1])
        scale = np.where(sd[k][cols] > 0, b[:-1] / np.where(sd[k][cols] > 0, sd[k][cols], 1.0), 0.0)
        out[m, k] = np.r_[scale, b[-1] - scale @ mean[k][cols]]
    return out


def losses(data: Splits, models: list[tuple[list[str], float]], groups: dict[str, list[str]] | None = None) -> DataFrame:
    """``model, fold, feature, loss``: weighted log loss of each held-out fold under each (features, penalty), and with each group of features permuted there; one scan for all."""
    coefficients = fitted(data, models)
    features, folds = data.features, data.folds  # tables can't go to the tasks
    p, variants = len(features), {"none": [], **(groups or {})}
    names = [f"f{k}" for k in range(p)]

    def run(batches):
        total: dict = {}
        for batch in batches:
            m, fold = _matrix(batch, [*names, "y", "w", *([f"pf{k}" for k in range(p)] if groups else [])]), batch.column("fold").to_numpy(zero_copy_only=False)
            for k in range(folds):
                rows = m[fold == k]
                y, w = rows[:, p], rows[:, p + 1]
                for feature, moved in variants.items():
                    x = rows[:, :p].copy()
                    for c in (features.index(c) for c in moved):
                        x[:, c] = rows[:, p + 2 + c]
                    for at, (columns, _) in enumerate(models):
                        b = coefficients[at, k]
                        z = x[:, [features.index(c) for c in columns]] @ b[:-1] + b[-1]
                        q = np.clip(1 / (1 + np.exp(-np.clip(z, -700, 700))), 1e-9, 1 - 1e-9)
                        loss = -(y * np.log(q) + (1 - y) * np.log(1 - q))
                        had = total.get((at, k, feature), (0.0, 0.0))
                        total[at, k, feature] = (had[0] + float(w @ loss), had[1] + float(w.sum()))
        rows = [(*key, *v) for key, v in total.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("model", "fold", "feature", "a", "b"), r, strict=True)) for r in rows], pa.schema([("model", pa.int32()), ("fold", pa.int32()), ("feature", pa.string()), ("a", pa.float64()), ("b", pa.float64())]))

    return data.held.mapInArrow(run, "model int, fold int, feature string, a double, b double").groupBy("model", "fold", "feature").agg(F.try_divide(F.sum("a"), F.sum("b")).alias("loss"))


def cross_validate(data: Splits, features: list[str], permuted: list[str] | dict[str, list[str]] | None = None, penalty: float = 1e-4) -> DataFrame:
    """``fold, feature, loss`` of one model, and with each of ``permuted`` (features, or named groups of them) shuffled within the fold."""
    groups = permuted if isinstance(permuted, dict) else {f: [f] for f in permuted or []}
    return losses(data, [(features, penalty)], groups).select("fold", "feature", "loss")


def search(data: Splits, models: list[tuple[list[str], float]]) -> DataFrame:
    """``model, loss``: the mean held-out loss of each (features, penalty), numbered as given."""
    return losses(data, models).groupBy("model").agg(F.avg("loss").alias("loss"))


def correlation_clusters(rows: DataFrame, features: list[str], most: int | None = None) -> dict[str, list[str]]:
    """Features grouped by average linkage of the correlation distance, at the number of groups of the best mean silhouette.

    Correlations are one aggregation; only their matrix reaches the driver.
    """
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    row = rows.agg(*[F.corr(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    dist = np.zeros((k, k))
    for i, j in pairs:
        dist[i, j] = dist[j, i] = np.sqrt(max(0.0, (1 - (row[f"c{i}_{j}"] or 0.0)) / 2))
    groups, best, score = [[i] for i in range(k)], [[i] for i in range(k)], -2.0
    while len(groups) > 1:
        if len(groups) <= (most or k - 1):
            quality = np.mean([_silhouette(i, groups, dist) for i in range(k)])
            if quality > score:
                best, score = [list(g) for g in groups], quality
        a, b = min(((x, y) for x in range(len(groups)) for y in range(x + 1, len(groups))), key=lambda p: dist[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return {f"group{n}": [features[i] for i in sorted(g)] for n, g in enumerate(sorted(best, key=min))}


def _silhouette(i: int, groups: list[list[int]], dist: np.ndarray) -> float:
    own = next(g for g in groups if i in g)
    if len(own) == 1:
        return 0.0
    within = dist[i, [j for j in own if j != i]].mean()
    nearest = min(dist[i, g].mean() for g in groups if g is not own)
    return float((nearest - within) / max(nearest, within)) if max(nearest, within) > 0 else 0.0


def least_squares(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients of a regression with intercept, from one pass of cross products; only those reach the driver."""
    cols = [F.lit(1.0), *map(F.col, xs), F.col(y)]
    pairs = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    row = df.dropna(subset=[y, *xs]).agg(*pairs).first()
    n = len(cols)
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    return dict(zip(["intercept", *xs], map(float, beta), strict=True))
