"""Logistic models of all folds and candidates fitted together, by one scan of the rows per Newton step.

A scan encodes each row by the preprocessing of every fold, and adds to the gradient, the Hessian and the loss of
every model that trains on it: all candidates of all folds but the row's own. The sums, a few numbers squared
per model whatever the rows, are merged by an aggregate; the driver takes all Newton steps at once. The number of scans is the
number of steps, not of folds or candidates. Scores come from one more scan, each row by its own fold's models.

The objective is that of Spark's logistic regression: mean loss plus regParam / 2 times the squared coefficients of the
features scaled to unit deviation over the training rows, the intercept free. Where the optimum is not unique the
steps are of least norm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.operators.preprocess import TabularPreprocessorModel

# settings of a logistic candidate that the common fit understands
SETTINGS = {"regParam", "maxIter", "tol", "elasticNetParam"}
HALVINGS = 30


def is_linear(candidate) -> bool:
    """Whether a candidate can be fitted with others: ridge or plain logistic regression without oversampling."""
    settings = getattr(candidate, "settings", {})
    plain = getattr(candidate, "model", None) == "logistic" and not candidate.resample and candidate.encoding is None
    return plain and set(settings) <= SETTINGS and not settings.get("elasticNetParam")


def can_share(prepared: Sequence[TabularPreprocessorModel]) -> bool:
    """Wide categories are joined, fold by fold, and stay with separate fits."""
    return not any(f.get("wide") for p in prepared for f in p.stats["categorical"])


def encoded_for_all(rows: DataFrame, prepared: Sequence[TabularPreprocessorModel], *keep: str) -> tuple[DataFrame, list[int]]:
    """`keep` and `x`, the row's features under every fold's preprocessing in turn, and the widths."""
    parts = [[e for _, _, e in p.encoded()] for p in prepared]
    return rows.select(*keep, F.array(*[e for part in parts for e in part]).alias("x")), [len(p) for p in parts]


def _matrix(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _sums(df: DataFrame, widths: list[int], of) -> dict[int, np.ndarray]:
    """One scan: per fold the sum over its training rows of `of(fold, x, y)`, a flat array; x ends with a column of ones."""
    begins = np.r_[0, np.cumsum(widths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            x = _matrix(batch.column(2))
            for j, w in enumerate(widths):
                mine = fold != j
                own = np.c_[x[mine, begins[j] : begins[j] + w], np.ones(int(mine.sum()))]
                total[j] = total.get(j, 0) + of(j, own, y[mine])
        for j, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), j)), pa.array(np.arange(len(t))), pa.array(t)], names=["fold", "at", "v"])

    parts = df.select(F.col("label").cast("double"), F.col("fold").cast("long"), "x").mapInArrow(run, "fold long, at long, v double")
    merged = parts.groupBy("fold", "at").agg(F.sum("v").alias("v")).orderBy("fold", "at").toArrow()
    fold, v = merged["fold"].to_numpy(), merged["v"].to_numpy()
    return {j: v[fold == j] for j in np.unique(fold).tolist()}


def _moments(j: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.r_[x.sum(axis=0), (x * x).sum(axis=0), y.sum()]


def _newton_sums(beta: dict[int, np.ndarray]):
    def of(j: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = []
        for b in beta[j]:  # a candidate each
            margin = x @ b
            p = 1 / (1 + np.exp(-margin))
            loss = np.logaddexp(0, margin).sum() - margin @ y
            out += [[loss], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
        return np.concatenate(out)

    return of


def fit_linear_folds(
    rows: DataFrame, prepared: Sequence[TabularPreprocessorModel], regs: Sequence[float], steps: Sequence[int] | None = None, tol: float = 1e-10
) -> dict[int, np.ndarray]:
    """Per fold j a matrix (candidate, features and intercept), fitted on the rows of all other folds.

    `rows` have a 0/1 `label`, a `fold` from 0 and the raw features; `steps` bounds the steps of each candidate.
    """
    df, widths = encoded_for_all(rows, prepared, "label", "fold")
    moments = _sums(df, widths, _moments)
    steps = list(steps or [100] * len(regs))
    n, penalty, beta = {}, {}, {}
    for j, m in moments.items():
        d = widths[j] + 1
        n[j] = m[d - 1]
        variance = np.maximum(m[d : 2 * d] - m[:d] ** 2 / n[j], 0) / max(n[j] - 1, 1)
        variance[-1] = 0  # the intercept is free
        penalty[j] = np.array(regs)[:, None] * variance
        share = min(max(m[-1] / n[j], 1e-9), 1 - 1e-9)
        beta[j] = np.zeros((len(regs), d))
        beta[j][:, -1] = np.log(share / (1 - share))
    best = {j: (np.full(len(regs), np.inf), b.copy(), np.zeros_like(b)) for j, b in beta.items()}  # loss, point, step
    halved = {j: np.zeros(len(regs), dtype=int) for j in beta}
    done = {j: np.zeros(len(regs), dtype=bool) for j in beta}
    taken = 0
    while beta and not all(d.all() for d in done.values()):
        sums = _sums(df, widths, _newton_sums(beta))
        for j, s in sums.items():
            d = widths[j] + 1
            for c, part in enumerate(s.reshape(len(regs), 1 + d + d * d)):
                if done[j][c]:
                    continue
                b, l2 = beta[j][c], penalty[j][c]
                loss = part[0] / n[j] + (l2 * b * b).sum() / 2
                if loss > best[j][0][c] + 1e-12:  # too far: half way back
                    halved[j][c] += 1
                    best[j][2][c] /= 2
                    done[j][c] = halved[j][c] > HALVINGS
                else:
                    gain = best[j][0][c] - loss
                    gradient = part[1 : 1 + d] / n[j] + l2 * b
                    hessian = part[1 + d :].reshape(d, d) / n[j] + np.diag(l2)
                    step = -np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]
                    done[j][c] = abs(gradient @ step) < tol or taken >= steps[c] or 0 <= gain < 1e-15
                    best[j][0][c], best[j][1][c], best[j][2][c], halved[j][c] = loss, b, step, 0
                    if done[j][c]:
                        continue
                beta[j][c] = best[j][1][c] + best[j][2][c]
        taken += 1
    return {j: b[1] for j, b in best.items()}


def score_linear_folds(rows: DataFrame, prepared: Sequence[TabularPreprocessorModel], fitted: dict[int, np.ndarray], names: Sequence[str], *keep: str) -> DataFrame:
    """(model, fold, *keep, prediction, probability): every row by every candidate of its own fold; one scan, no join."""
    scores = []
    for c, name in enumerate(names):
        margin = F.lit(None).cast("double")
        for j, b in fitted.items():
            terms = [e * F.lit(float(w)) for (_, _, e), w in zip(prepared[j].encoded(), b[c])]
            margin = F.when(F.col("fold") == j, sum(terms, F.lit(float(b[c][-1])))).otherwise(margin)
        scores.append(F.struct(F.lit(name).alias("model"), margin.alias("margin")))
    long = rows.select("fold", *keep, F.explode(F.array(*scores)).alias("s"))
    return long.select(
        F.col("s.model").alias("model"), (F.col("fold") + 1).alias("fold"), *keep,
        (F.col("s.margin") > 0).cast("int").alias("prediction"), (1 / (1 + F.exp(-F.col("s.margin")))).alias("probability"),
    )
