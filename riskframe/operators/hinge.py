"""Linear support vector machines on a mapped feature space, several at once by one scan of the rows per evaluation.

Rows are packed in blocks of their raw features, which are held. A scan maps a block to its many columns inside the task, adds up loss
and gradient of every machine that trains on the block's rows, and returns one row of sums per task: the mapped rows, many
times as wide as the raw ones, are never stored, held or shuffled. Machines that leave out different folds share their scans,
so the number of scans is that of one machine's evaluations, not of all machines'.

Objective, start, steps and stopping rule are those of Spark's LinearSVC with its defaults: mean hinge loss of features
scaled to unit deviation over the training rows and centred, plus regParam / 2 times the squared scaled coefficients, the
intercept free, minimised by its quasi-Newton method (orthant-wise, memory of 10, backtracking to the strong Wolfe conditions). Sums of
tasks are added in a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.session import stage_table

MEMORY = 10
TRIALS = 20
SEEN = 20  # values behind the rule that stops on small changes
CHUNK = 500  # rows that are mapped at a time
BLOCK_BYTES = 4 << 20
BLOCK = "n int, label binary, fold binary, x binary"

Mapping = Callable[[np.ndarray], np.ndarray]


def packed(rows: DataFrame) -> RDD:
    """Blocks of (label, fold, x), held: numbers of rows, 0/1 labels and folds as bytes, features as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, fold = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if not np.isin(label, (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1, and not null or NaN")
            if not np.isfinite(x).all():
                raise ValueError("features must not be NaN or infinite")
            step = max(1, BLOCK_BYTES // max(1, 8 * x.shape[1]))
            for at in range(0, len(x), step):
                part = slice(at, at + step)
                own = (label[part].astype(np.uint8), fold[part].astype(np.uint8), x[part])
                columns = [pa.array([len(own[0])], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in own)]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "label", "fold", "x"])

    blocks = rows.select(F.col("label").cast("double"), F.col("fold").cast("int"), "x").mapInArrow(run, BLOCK)
    return blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _mapped(blocks: Iterator[tuple], mapping: Mapping) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(label, fold, mapped features) of the rows of blocks, chunk by chunk."""
    for n, label, fold, x in blocks:
        label, fold = (np.frombuffer(v, np.uint8) for v in (label, fold))
        x = np.frombuffer(x).reshape(n, -1)
        for at in range(0, n, CHUNK):
            part = slice(at, at + CHUNK)
            yield label[part].astype(float), fold[part], mapping(x[part])


def _scan(blocks: RDD, mapping: Mapping, of) -> list[np.ndarray]:
    """`of(chunks)` of every task, an array or nothing, in the order of the tasks."""
    return [s for s in blocks.mapPartitions(lambda part: [of(_mapped(part, mapping))]).collect() if s is not None]


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, means and summed squared deviations (columns of a row a fold) of two sets of rows together."""
    width = (a.shape[1] - 1) // 2
    n, m = a[:, :1], b[:, :1]
    far = b[:, 1 : 1 + width] - a[:, 1 : 1 + width]
    share = m / np.maximum(n + m, 1)
    return np.concatenate([n + m, a[:, 1 : 1 + width] + far * share, a[:, 1 + width :] + b[:, 1 + width :] + far * far * n * share], axis=1)


def _moments(folds: int):
    def of(chunks):
        total = None
        for _, fold, z in chunks:
            own = np.zeros((folds, 1 + 2 * z.shape[1]))
            for j in range(folds):
                mine = z[fold == j]
                if len(mine):
                    mean = mine.mean(axis=0)
                    own[j] = np.r_[len(mine), mean, ((mine - mean) ** 2).sum(axis=0)]
            total = own if total is None else _merged(total, own)
        return total

    return of


class _Machine:
    """What a scan needs of a machine: the fold it leaves out (-1: none), and the scaling of its training rows."""

    def __init__(self, moments: np.ndarray, left_out: int):
        total = np.zeros((1, moments.shape[1]))
        for j, own in enumerate(moments):
            if j != left_out:
                total = _merged(total, own[None])
        self.left_out, self.n = left_out, total[0, 0]
        width = (moments.shape[1] - 1) // 2
        deviation = np.sqrt(total[0, 1 + width :] / max(self.n - 1, 1))
        self.scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)
        self.centre = total[0, 1 : 1 + width] * self.scale

    def plain(self, w: np.ndarray) -> np.ndarray:
        """Coefficients and intercept on unscaled features, of those on scaled and centred ones."""
        return np.r_[w[:-1] * self.scale, w[-1] - w[:-1] @ self.centre]


def _hinge(machines: list[_Machine], points: np.ndarray):
    """Per machine the summed loss, the gradient by unscaled and uncentred features, and that of the intercept."""
    weights = np.stack([m.plain(w) for m, w in zip(machines, points)], axis=1)
    left_out = np.array([m.left_out for m in machines])

    def of(chunks):
        total = None
        for label, fold, z in chunks:
            sign = (2 * label - 1)[:, None]
            slack = 1 - sign * (z @ weights[:-1] + weights[-1])
            inside = (slack > 0) & (fold[:, None] != left_out)
            pull = np.where(inside, -sign, 0.0)
            own = np.concatenate([np.where(inside, slack, 0.0).sum(axis=0)[None], z.T @ pull, pull.sum(axis=0)[None]])
            total = own if total is None else total + own
        return total

    return of


def fit_machines(blocks: RDD, mapping: Mapping, folds: int, reg: float, steps: int, tol: float = 1e-6) -> list[np.ndarray]:
    """Coefficients and intercept (last) of one machine per left-out fold, and of one on all rows."""
    moments = None
    for own in _scan(blocks, mapping, _moments(folds)):
        moments = own if moments is None else _merged(moments, own)
    if moments is None:
        raise ValueError("no rows to train on")
    machines = [_Machine(moments, j) for j in (*range(folds), -1)]
    width = (moments.shape[1] - 1) // 2
    fitted = [np.zeros(width + 1) for _ in machines]
    running = {i: minimised(fitted[i], steps, tol) for i, m in enumerate(machines) if m.n}
    asked = {i: next(g) for i, g in running.items()}
    while asked:
        at = list(asked)
        mine = [machines[i] for i in at]
        sums = sum(_scan(blocks, mapping, _hinge(mine, np.stack([asked[i] for i in at]))))
        for c, (i, m) in enumerate(zip(at, mine)):
            loss, pull, free = sums[0, c] / m.n, sums[1:-1, c], sums[-1, c]
            w = asked.pop(i)[:-1]
            gradient = np.r_[(pull * m.scale - free * m.centre) / m.n + reg * w, free / m.n]
            try:
                asked[i] = running[i].send((loss + 0.5 * reg * (w @ w), gradient))
            except StopIteration as e:
                fitted[i] = m.plain(e.value)
    return fitted


def held_out_margins(spark: SparkSession, blocks: RDD, mapping: Mapping, fitted: list[np.ndarray]) -> DataFrame:
    """(label, margin) of every row by the machine that left its fold out."""
    weights = np.stack(fitted[:-1], axis=1)

    def run(part):
        for label, fold, z in _mapped(part, mapping):
            margins = z @ weights[:-1] + weights[-1]
            own = np.take_along_axis(margins, fold[:, None].astype(np.intp), axis=1)[:, 0]
            yield label.tobytes(), own.tobytes()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(np.frombuffer(b"".join(c.to_pylist()))) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "margin"])

    chunks = spark.createDataFrame(blocks.mapPartitions(run), "label binary, margin binary")
    return stage_table(chunks.mapInArrow(unpacked, "label double, margin double"), "svm-margins")


# ---- the minimiser ---------------------------------------------------------------------------------

Asks = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


class _Failed(Exception):
    """A direction or a step that cannot be used."""


def _direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction by the steps and gradient changes so far, newest first; never uphill in a coordinate."""
    d, scale, used = gradient.copy(), 1.0, []
    with np.errstate(divide="ignore", invalid="ignore"):
        if history:
            step, change = history[0]
            scale = (step @ change) / (change @ change)
            if not step @ change >= 0:
                raise _Failed
        for step, change in history:
            rho = step @ change
            a = (step @ d) / rho
            if np.isnan(a):
                raise _Failed
            used.append((a, rho))
            d -= a * change
        d *= scale
        for (step, change), (a, rho) in zip(reversed(history), reversed(used)):
            d += (a - (change @ d) / rho) * step
    d = -d
    return np.where(d * gradient < 0, d, 0.0)


def minimised(x: np.ndarray, steps: int, tol: float) -> Asks:
    """Asks for value and gradient at points, and returns where it ends.

    A step stays in the orthant of its start, a coordinate at 0 in that of its descent.
    """
    value, gradient = yield x
    first, history, seen, failed, taken = abs(value), [], [np.inf], False, 0
    while True:
        if taken >= steps or (len(seen) > 1 and abs(value - max(seen)) <= tol * first):
            return x
        if np.linalg.norm(gradient) <= max(tol * value, 1e-8):
            return x
        try:
            d = _direction(gradient, history)
            slope, orthant = d @ gradient, np.where(x != 0, np.sign(x), np.sign(-gradient))
            alpha, shrink = (1.0, 0.5) if taken else (0.5 / np.linalg.norm(gradient), 0.1)
            # Spark's search takes the value at the start for that of its first trial, which so never falls enough
            turns = 0
            if value > value + alpha * slope * 1e-4:
                turns, alpha = 1, alpha * shrink
            while True:
                to = x + d * alpha
                to = np.where(np.sign(to) == orthant, to, 0.0)
                new, new_gradient = yield to
                if (new if turns else value) > value + alpha * slope * 1e-4:
                    factor = shrink
                elif new_gradient @ d < 0.9 * slope:
                    factor = 2.1
                elif new_gradient @ d > -0.9 * slope:
                    factor = shrink
                else:
                    break
                if not 1e-10 <= alpha * factor <= 1e10:
                    raise _Failed
                if turns + 1 >= TRIALS:
                    break  # a search that is too long takes its last trial
                turns, alpha = turns + 1, alpha * factor
        except _Failed:
            if failed:
                return x
            failed, history = True, []
            continue
        failed = False
        history = [(to - x, new_gradient - gradient), *history][:MEMORY]
        x, value, gradient, taken = to, new, new_gradient, taken + 1
        seen = [*seen, value][-SEEN:]
