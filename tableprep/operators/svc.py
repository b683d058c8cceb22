"""One-vs-rest linear support vector machines over wide sparse vectors, all classes from the same passes.

A one-hot block of a near-unique column has about as many slots as the table has rows, but a row has only one of them. Given
the weights of the other, *shared* slots, the weight v of such a *rare* slot depends on that slot's rows alone: it minimises
``l / 2 v^2 + mean hinge``, and as the hinges are lines with one kink each, sorting the kinks gives it exactly. So the rare
slots are solved inside each evaluation, and what is left is a convex function of the few shared weights and the intercept.
That one is minimised by BFGS on the driver; an evaluation is one pass over the rows, which lie in blocks with a rare slot's
rows together, and returns a value, a gradient and (for few shared slots) a curvature matrix a class. The objective is
``LinearSVC``'s: mean hinge loss and ``regParam / 2`` times the squared weights, the intercept free.

Vectors that are narrow, dense, or have rows with several rare slots are fitted by MLlib's ``OneVsRest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.operators import slots as SL
from tableprep.persist import Saved
from tableprep.session import cut_lineage, ship_package

MOST_SHARED = 512      # shared slots, whose weights the driver's minimiser holds
SHARED_ROWS = 1024     # a slot is shared from so many rows on, and from a 256th of all rows on
CURVED = 64            # up to so many shared slots the first pass gives curvature too
BLOCK_VALUES = 1_000_000
MEMORY = 10            # iterations over which the value has to fall by the tolerance


def _split(shared: np.ndarray):
    """Rows as label, rare slot with its value, and shared values; ``many`` says that a row has several rare slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = 0
        for batch in batches:
            row, slot, value = SL.vector_parts(batch.column(1))
            stored = value != 0
            row, slot, value = row[stored], slot[stored], value[stored]
            n, at = batch.num_rows, np.minimum(np.searchsorted(shared, slot), max(len(shared) - 1, 0))
            known = shared[at] == slot if len(shared) else np.zeros(len(slot), bool)
            x = np.zeros((n, len(shared)))
            x[row[known], at[known]] = value[known]
            own, own_value = -1 - (np.arange(n, dtype=np.int64) + spread) % 4096, np.zeros(n)  # rows without one are spread
            own[row[~known]], own_value[row[~known]] = slot[~known], value[~known]
            spread += n
            parts = x.tobytes()
            size = 8 * len(shared)
            yield pa.RecordBatch.from_pydict({
                "y": batch.column(0).cast(pa.int32()), "slot": own, "value": own_value,
                "many": np.bincount(row[~known], minlength=n) > 1,
                "shared": pa.array([parts[i * size:(i + 1) * size] for i in range(n)], pa.binary())})

    return run


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A partition's rows by rare slot, in blocks of about ``most`` rows that keep a slot's rows together."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [], pa.schema([
        ("y", pa.int32()), ("slot", pa.int64()), ("value", pa.float64()), ("shared", pa.binary())]))
    slot = table["slot"].to_numpy()
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, np.int64)
    at = 0
    while at < len(slot):
        after = first[first >= at + most]
        stop = int(after[0]) if len(after) else len(slot)
        part = table.take(pa.array(order[at:stop]))
        yield pa.RecordBatch.from_pydict({
            "y": [part["y"].to_numpy().tobytes()], "slot": [slot[at:stop].tobytes()],
            "value": [part["value"].to_numpy().tobytes()], "shared": [b"".join(part["shared"].to_pylist())]},
            pa.schema([(c, pa.binary()) for c in ("y", "slot", "value", "shared")]))
        at = stop


BLOCK = "y binary, slot binary, value binary, shared binary"


class Block:
    """Rows with the rows of a rare slot next to each other; a slot below 0 means none."""

    def __init__(self, y: bytes, slot: bytes, value: bytes, shared: bytes):
        self.y, self.slot, self.value = np.frombuffer(y, np.int32), np.frombuffer(slot, np.int64), np.frombuffer(value)
        self.x = np.frombuffer(shared).reshape(len(self.y), -1) if shared else np.zeros((len(self.y), 0))
        new = np.r_[True, (self.slot[1:] != self.slot[:-1])] | (self.slot < 0)
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.first, len(self.y)])
        self.group = np.cumsum(new) - 1

    def rare(self, m: np.ndarray, s: np.ndarray, n: int, reg: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one class, from the margins ``m`` without the rare slots and the signs ``s``: the rare weight of each group, the
        duals of the rows (0 to 1), and which rows lie on the kink that holds their weight."""
        x, v, dual, kink = self.value, np.zeros(len(self.first)), np.zeros(len(m)), np.zeros(len(m), bool)
        u = 1.0 - s * m
        alone = self.first[self.size == 1]
        none = self.slot[alone] < 0
        free, one = alone[none], alone[~none]
        dual[free] = u[free] > 0
        need = u[one] * n * reg / (x[one] * x[one])
        dual[one] = np.clip(need, 0.0, 1.0)
        kink[one] = (need > 0) & (need < 1)
        v[self.group[one]] = dual[one] * s[one] * x[one] / (n * reg)
        rows = np.flatnonzero(self.size[self.group] > 1)
        if len(rows):
            t = (s[rows] - m[rows]) / x[rows]
            order = np.lexsort((t, self.group[rows]))
            rows, t = rows[order], t[order]
            g, force = self.group[rows], np.abs(x[rows]) / n
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            at = np.cumsum(np.r_[False, g[1:] != g[:-1]])
            rising = s[rows] * x[rows] > 0
            pull = np.add.reduceat(force * rising, start)
            run = np.cumsum(force)
            run -= (run - force)[start][at]
            passed = reg * t - pull[at] + run < 0      # a prefix of each group: the slope is still negative behind the kink
            k = np.add.reduceat(passed.astype(np.int64), start)
            size = np.diff(np.r_[start, len(rows)])
            beyond = np.where(k > 0, run[start + np.maximum(k - 1, 0)], 0.0)
            weight = (pull - beyond) / reg
            following = start + np.minimum(k, size - 1)
            held = (k < size) & (t[following] < weight)
            weight = np.where(held, t[following], weight)
            dual[rows] = passed != rising
            r = following[held]
            part = np.clip((pull - beyond - reg * weight)[held] / force[r], 0.0, 1.0)
            dual[rows[r]] = np.where(rising[r], 1.0 - part, part)
            kink[rows[r]] = (part > 0) & (part < 1)
            v[g[start]] = weight
        return v, dual, kink


def evaluate(block: Block, classes: list[int], points: np.ndarray, n: int, reg: float, curved: bool) -> list[np.ndarray]:
    """For each class the value, gradient and, if asked for, curvature that the block's rows add (without the shared penalty)."""
    one = np.column_stack([block.x, np.ones(len(block.y))])
    margins, out = one @ points.T, []
    for j, c in enumerate(classes):
        s, m = np.where(block.y == c, 1.0, -1.0), margins[:, j]
        v, dual, kink = block.rare(m, s, n, reg)
        z = m + v[block.group] * block.value
        parts = [[np.maximum(0.0, 1.0 - s * z).sum() / n + reg / 2 * (v @ v)], one.T @ (-s * dual) / n]
        if curved:
            here = one[kink]
            parts.append(((here * (reg / block.value[kink] ** 2)[:, None]).T @ here).ravel())
        out.append(np.concatenate(parts))
    return out


def bfgs(start: np.ndarray, reg: float, tol: float, max_iter: int):
    """Minimises by asking for (value, gradient, curvature or None) at points; returns the best point and its value."""
    w = start
    f, g, curvature = yield w
    inverse = None
    if curvature is not None:
        size, vectors = np.linalg.eigh(curvature)
        inverse = (vectors / np.maximum(size, max(1e-6 * size.max(), 1e-12))) @ vectors.T
    past, fresh = [f], False
    for _ in range(max_iter):
        if g[:-1] @ g[:-1] / (2 * reg) + abs(g[-1]) * max(1.0, abs(w[-1])) <= 1e-2 * tol * abs(f):
            break
        if len(past) > MEMORY and past[-1 - MEMORY] - f <= tol * abs(f):
            break
        step = -g / max(1.0, np.linalg.norm(g)) if inverse is None else -(inverse @ g)
        slope = step @ g
        if slope >= 0:
            inverse, step = None, -g / max(1.0, np.linalg.norm(g))
            slope = step @ g
        low, high, t, best = 0.0, np.inf, 1.0, None
        for _ in range(30):  # weak Wolfe conditions by bisection
            f2, g2, _ = yield w + t * step
            if f2 > f + 1e-4 * t * slope:
                high = t
            else:
                best = (w + t * step, f2, g2)
                if g2 @ step >= 0.9 * slope:
                    break
                low = t
            t = 2 * low if high == np.inf else (low + high) / 2
        if best is None:
            if fresh:
                break
            inverse, fresh = None, True
            continue
        fresh = False
        move, turn = best[0] - w, best[2] - g
        w, f, g = best
        past.append(f)
        if turn @ move > 1e-14 * np.sqrt((turn @ turn) * (move @ move)):
            if inverse is None:
                inverse = np.eye(len(w)) * (turn @ move) / (turn @ turn)
            rho = 1.0 / (turn @ move)
            left = np.eye(len(w)) - rho * np.outer(move, turn)
            inverse = left @ inverse @ left.T + rho * np.outer(move, move)
    return w, f


class WideOneVsRest(OneVsRest):
    """``OneVsRest`` that fits a ``LinearSVC`` on wide sparse vectors with all classes at a time."""

    def _fit(self, dataset: DataFrame):
        svc = self.getClassifier()
        plain = type(svc) is LinearSVC and svc.getRegParam() > 0 and svc.getFitIntercept() and not svc.getStandardization()
        if plain and not (self.isSet(self.weightCol) and self.getWeightCol()) and SL.is_sparse(dataset, self.getFeaturesCol()):
            model = _fit_wide(dataset, self.getFeaturesCol(), self.getLabelCol(), svc)
            if model is not None:
                return model
        return super()._fit(dataset)


def _fit_wide(df: DataFrame, x: str, label: str, svc: LinearSVC) -> "WideOneVsRestModel | None":
    n, width = SL.rows_and_width(df, x)
    if width <= SL.WIDE:
        return None
    ship_package(df.sparkSession)
    often = SL.entries(df, x).groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).where(
        F.col("n") >= max(SHARED_ROWS, n // 256)).collect()
    if len(often) > MOST_SHARED:
        return None
    # like LinearSVC, a slot without spread has no weight
    shared = np.array(sorted(r["slot"] for r in often), np.int64)
    fixed = np.isin(shared, [r["slot"] for r in often if r["n"] == n and r["low"] == r["high"]])
    rows = df.select(F.col(label).cast("double").cast("int").alias("y"), F.unwrap_udt(F.col(x)).alias("v")).mapInArrow(
        _split(shared), "y int, slot long, value double, many boolean, shared binary")
    rows = cut_lineage(rows)
    n_classes, bad = rows.agg(F.max("y") + 1, F.count_if(
        F.col("many") | F.col("y").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))).first()
    if bad:
        return None
    reg, d = svc.getRegParam(), len(shared)
    most = BLOCK_VALUES // (d + 4) + 1
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, n // most)
    blocks = cut_lineage(rows.drop("many").repartition(tasks, "slot").mapInArrow(lambda b: _packed(b, most), BLOCK))
    free = np.r_[~fixed, True]

    def passed(classes: list[int], points: np.ndarray, curved: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for row in batch.to_pylist():
                    parts = np.stack(evaluate(Block(**row), classes, points, n, reg, curved))
                    total = parts if total is None else total + parts
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        got = blocks.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r["sums"]).reshape(len(classes), -1) for r in got)

    def answer(point: np.ndarray, sums: np.ndarray, curved: bool):
        w = np.r_[point[:-1], 0.0]
        curvature = None
        if curved:
            curvature = sums[d + 2:].reshape(d + 1, d + 1) + reg * np.diag(np.r_[np.ones(d), 0.0])
            curvature[~free, :] = curvature[:, ~free] = 0.0
            curvature[~free, ~free] = reg
        return sums[0] + reg / 2 * (w @ w), (sums[1:d + 2] + reg * w) * free, curvature

    # no start at 0, where all rows of a rare slot have the same margin and so lie on one kink
    most_by_slot = {r["slot"]: max(abs(r["low"]), abs(r["high"])) for r in often}
    start = np.array([0.1 * np.cos(j) / most_by_slot[k] for j, k in enumerate(shared)] + [-0.1]) * free
    searches = {c: bfgs(start, reg, svc.getTol(), svc.getMaxIter()) for c in range(n_classes)}
    asked, found, curved = {c: next(s) for c, s in searches.items()}, {}, d <= CURVED
    while asked:
        classes = sorted(asked)
        sums = passed(classes, np.stack([asked[c] for c in classes]), curved)
        for c, part in zip(classes, sums):
            try:
                asked[c] = searches[c].send(answer(asked[c], part, curved))
            except StopIteration as end:
                found[c] = end.value
                del asked[c]
        curved = False
    points = np.stack([found[c][0] * free for c in range(n_classes)])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(**row)
                margins = b.x @ points[:, :-1].T + points[:, -1]
                v = np.column_stack([b.rare(margins[:, c], np.where(b.y == c, 1.0, -1.0), n, reg)[0]
                                     for c in range(n_classes)])
                slot = b.slot[b.first]
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array([slot[slot >= 0].tobytes()], pa.binary()),
                    "weight": pa.array([v[slot >= 0].tobytes()], pa.binary())})

    coefficients = np.zeros((n_classes, width))
    coefficients[:, shared] = points[:, :-1]
    for r in blocks.mapInArrow(weights, "slot binary, weight binary").toLocalIterator():
        slot = np.frombuffer(r["slot"], np.int64)
        coefficients[:, slot] = np.frombuffer(r["weight"]).reshape(len(slot), n_classes).T
    return WideOneVsRestModel(x, coefficients, points[:, -1], [float(found[c][1]) for c in range(n_classes)])


class WideOneVsRestModel(Saved, Model, HasPredictionCol):
    """The class of the largest margin, the first of equal ones. ``values`` are the objectives reached, by class."""

    def __init__(self, features_col: str, coefficients: np.ndarray, intercepts: np.ndarray, values: list[float]):
        super().__init__()
        self.features_col, self.coefficients, self.intercepts, self.values = features_col, coefficients, intercepts, values

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        if getattr(self, "_broadcast", None) is None:
            self._broadcast = df.sparkSession.sparkContext.broadcast(
                (np.ascontiguousarray(np.asarray(self.coefficients).T), np.asarray(self.intercepts)))
        shared = self._broadcast

        def best(column: pa.Array) -> pa.Array:
            by_slot, intercepts = shared.value
            row, slot, value = SL.vector_parts(column)
            terms = by_slot[slot] * value[:, None]
            margins = np.column_stack([np.bincount(row, terms[:, c], len(column)) + intercepts[c]
                                       for c in range(len(intercepts))])
            return pa.array(margins.argmax(axis=1).astype(float))

        best.__annotations__ = {"column": pa.Array, "return": pa.Array}
        name = self.getPredictionCol() if self.isDefined(self.predictionCol) else "prediction"
        return df.withColumn(name, F.arrow_udf(best, "double")(F.unwrap_udt(F.col(self.features_col))))

