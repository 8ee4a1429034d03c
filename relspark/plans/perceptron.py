"""The perceptron of Spark ML, fitted to and applied to sparse rows.

Spark's own trainer makes every row dense and keeps the dense rows for all its iterations, so it takes rows times
width. Here rows stay sparse: the scaling of the input is part of the first layer's weights and bias, and a
pass takes the entries of the rows. Layers, loss, weights and limits of the search are Spark's; the loss is the mean
over rows, where Spark takes the mean over the means of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.sources.stored import run_scope, stored

#: Rows and entries of a packed block; what a pass makes of one is ENTRIES x the first layer's outputs.
ROWS, ENTRIES = 4096, 1 << 16
#: Bytes of all tasks' gradients that may meet in the driver; more are added up by pieces in other tasks first.
DRIVER_BYTES, PIECE_BYTES = 2 * 1024 * 1024, 1024 * 1024
#: Steps the search remembers, and the relative change of the loss that ends it: as in Spark.
MEMORY, TOLERANCE = 10, 1e-6

PACKED = "rows int, lengths binary, places binary, values binary, classes binary"


@dataclass(frozen=True)
class Rows:
    """Sparse rows: entries per row, and position and value of each entry."""

    lengths: np.ndarray
    places: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(vectors: pa.StructArray) -> Rows:
        """From the parts of vectors, none NULL; an array of a dense one has all its positions. Zeros are left out."""
        if vectors.null_count:
            raise ValueError("Vectors MUST NOT be Null")
        kind, values = vectors.field("type").to_numpy(zero_copy_only=False), vectors.field("values")
        lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        numbers, indices = values.flatten().to_numpy(zero_copy_only=False), vectors.field("indices")
        row = np.repeat(np.arange(len(lengths)), lengths)
        places = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        places[(kind == 0)[row]] = indices.flatten().to_numpy(zero_copy_only=False)
        own = numbers != 0
        lengths = np.bincount(row[own], minlength=len(lengths))
        return Rows(lengths.astype(np.int32), places[own].astype(np.int32), numbers[own])

    def blocks(self) -> Iterator[tuple[int, int, Rows]]:
        """(first row, end, rows) of blocks of at most ROWS rows and, but for a single row, ENTRIES entries."""
        ends, start = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)]), 0
        while start < len(self.lengths):
            end = int(np.searchsorted(ends, ends[start] + ENTRIES, "right")) - 1
            end = min(max(end, start + 1), start + ROWS)
            cut = slice(ends[start], ends[end])
            yield start, end, Rows(self.lengths[start:end], self.places[cut], self.values[cut])
            start = end

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The rows times a matrix of as many rows as they have positions."""
        found, some = np.zeros((len(self.lengths), matrix.shape[1])), self.lengths > 0
        if some.any():
            starts = (np.cumsum(self.lengths) - self.lengths)[some]
            found[some] = np.add.reduceat(self.values[:, None] * matrix[self.places], starts, axis=0)
        return found

    def add_transposed(self, other: np.ndarray, total: np.ndarray) -> None:
        """Add the transposed rows times `other` to a matrix."""
        if len(self.places):
            order = np.argsort(self.places, kind="stable")
            places, row = self.places[order], np.repeat(np.arange(len(self.lengths)), self.lengths)[order]
            starts = np.flatnonzero(np.diff(places, prepend=-1))
            total[places[starts]] += np.add.reduceat(self.values[order, None] * other[row], starts, axis=0)


Layers = list[tuple[np.ndarray, np.ndarray]]


def split(weights: np.ndarray, layers: list[int]) -> Layers:
    """(weights, bias) of each layer, as views of Spark's one array: a column of its matrix is a row here."""
    found, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        end = at + n_in * n_out
        found.append((weights[at:end].reshape(n_in, n_out), weights[end : end + n_out]))
        at = end + n_out
    return found


def first_weights(layers: list[int], seed: int) -> np.ndarray:
    """Random weights in the bounds of Spark's."""
    random = np.random.default_rng(seed)
    parts = [random.uniform(-2.4, 2.4, (n + 1) * m) / np.sqrt(n) for n, m in zip(layers, layers[1:])]
    return np.concatenate(parts)


def scaling(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, offset) of each position that scale its range to [0, 1]; a constant position becomes 0.5."""
    same = high == low
    factor = np.where(same, 0.0, 1 / np.where(same, 1.0, high - low))
    return factor, np.where(same, 0.5, -low * factor)


def over_raw(net: Layers, factor: np.ndarray, offset: np.ndarray) -> Layers:
    """The layers of scaled rows as those of rows as they are."""
    weights, bias = net[0]
    return [(factor[:, None] * weights, bias + offset @ weights), *net[1:]]


def activations(rows: Rows, net: Layers) -> list[np.ndarray]:
    """What each layer gives out; the last gives the probabilities of the classes."""
    found = []
    for i, (weights, bias) in enumerate(net):
        z = (found[-1] @ weights if i else rows.times(weights)) + bias
        if i + 1 < len(net):
            found.append(0.5 * (1 + np.tanh(0.5 * z)))  # the sigmoid
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            found.append(z / z.sum(axis=1, keepdims=True))
    return found


def add_gradient(rows: Rows, classes: np.ndarray, net: Layers, total: Layers) -> float:
    """Add the summed gradient of some rows to `total`, and give their summed loss."""
    out, each = activations(rows, net), np.arange(len(classes))
    loss = -float(np.log(np.maximum(out[-1][each, classes], 1e-300)).sum())
    delta = out[-1]
    delta[each, classes] -= 1
    for i in range(len(net) - 1, -1, -1):
        total[i][1][:] += delta.sum(axis=0)
        if i:
            total[i][0][:] += out[i - 1].T @ delta
            delta = (delta @ net[i][0].T) * out[i - 1] * (1 - out[i - 1])
        else:
            rows.add_transposed(delta, total[0][0])
    return loss


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of (class, vector), as bytes that each pass reads again."""

    def pack(batches):
        for batch in batches:
            sparse = Rows.of(batch.column("vector"))
            if not np.isfinite(sparse.values).all():
                raise ValueError("Vector values MUST NOT be NaN or Infinity")
            classes = batch.column("class").to_numpy(zero_copy_only=False).astype(np.int32)
            for start, end, block in sparse.blocks():
                parts = (block.lengths, block.places, block.values, classes[start:end])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([end - start], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]],
                    ["rows", "lengths", "places", "values", "classes"],
                )

    return rows.select("class", "vector").mapInArrow(pack, PACKED)


def _task_gradients(blocks: DataFrame, net: Layers, layers: list[int], in_driver: bool):
    """(piece, part) rows: each task's summed gradient with its rows and loss, whole or in pieces; and the broadcast."""
    held = blocks.sparkSession.sparkContext.broadcast(net)
    size = sum((n + 1) * m for n, m in zip(layers, layers[1:])) + 2
    step = size if in_driver else PIECE_BYTES // 8

    def summed(batches):
        net = held.value
        total = np.zeros(size)
        views = split(total, layers)
        for batch in batches:
            for row in batch.to_pylist():
                lengths, places, classes = (np.frombuffer(row[x], np.int32) for x in ("lengths", "places", "classes"))
                rows = Rows(lengths, places, np.frombuffer(row["values"]))
                total[-1] += add_gradient(rows, classes, net, views)
                total[-2] += len(classes)
        for i, at in enumerate(range(0, size, step)):
            part = pa.array([total[at : at + step].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), part], ["piece", "part"])

    return blocks.mapInArrow(summed, "piece int, part binary"), held


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in group.column("part"))
    return pa.table({"piece": group.column("piece").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def gradient(blocks: DataFrame, tasks: int, net: Layers, layers: list[int], most: int = DRIVER_BYTES):
    """(mean loss, mean gradient over the rows as they are) of packed blocks, in one pass.

    The driver gets the gradients of all tasks while these are small; else their sum alone, made in pieces
    by other tasks.
    """
    in_driver = tasks * 8 * sum((n + 1) * m for n, m in zip(layers, layers[1:])) <= most
    parts, held = _task_gradients(blocks, net, layers, in_driver)
    if not in_driver:
        parts = parts.groupBy("piece").applyInArrow(_added, "piece int, part binary")
    pieces: dict[int, np.ndarray] = {}
    for row in parts.collect():
        part = np.frombuffer(row.part)
        pieces[row.piece] = pieces[row.piece] + part if row.piece in pieces else part
    held.destroy()
    total = np.concatenate([pieces[i] for i in sorted(pieces)])
    return total[-1] / total[-2], total[:-2] / total[-2]


def minimum(
    at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tolerance: float = TOLERANCE
) -> np.ndarray:
    """Where a function is least, by L-BFGS with steps that meet the Wolfe conditions."""
    loss, slope = at(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        way, held = -slope, []
        for s, y, r in reversed(past):
            held.append(r * (s @ way))
            way -= held[-1] * y
        if past:
            s, y, r = past[-1]
            way *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(held)):
            way += (a - r * (y @ way)) * s
        down = slope @ way
        if not down < 0:
            break
        step, short, long = (1.0 if past else 1 / max(1e-12, float(np.linalg.norm(way)))), 0.0, np.inf
        best = None
        for _ in range(20):
            new = at(x + step * way)
            if not new[0] <= loss + 1e-4 * step * down:
                long = step
            else:
                best = (step, *new)
                if new[1] @ way >= 0.9 * down:
                    break
                short = step
            step = (short + long) / 2 if long < np.inf else 2 * step
        if best is None:
            break
        step, new_loss, new_slope = best
        s, y = step * way, new_slope - slope
        if s @ y > 0:
            past = [*past, (s, y, 1 / (s @ y))][-MEMORY:]
        done = abs(loss - new_loss) <= tolerance * max(abs(loss), abs(new_loss))
        x, loss, slope = x + s, new_loss, new_slope
        if done:
            break
    return x


def fitted(
    rows: DataFrame, low: np.ndarray, high: np.ndarray, layers: list[int], max_iter: int, seed: int
) -> np.ndarray:
    """Spark's array of weights, fitted to (class, vector) whose positions have the ranges `low` to `high`.

    Rows that Spark's trainer refuses fail here too: no class or one beyond the last, no vector, or numbers that are not finite.
    """
    factor, offset = scaling(low, high)
    refused = F.raise_error(F.lit("Labels MUST NOT be Null or NaN, and must be classes")).cast("double")
    known = F.col("class").between(0, layers[-1] - 1)
    rows = rows.withColumn("class", F.when(known, F.col("class")).otherwise(refused))
    with run_scope(rows.sparkSession):
        blocks = stored(packed(rows))
        tasks = min(blocks.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
        blocks = blocks.coalesce(max(1, tasks))

        def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
            net = split(weights, layers)
            loss, slope = gradient(blocks, tasks, over_raw(net, factor, offset), layers)
            first, bias = split(slope, layers)[0]
            first *= factor[:, None]
            first += offset[:, None] * bias
            return loss, slope

        return minimum(at, first_weights(layers, seed), max_iter)


def predicted(vectors: Column, weights: np.ndarray, low: np.ndarray, high: np.ndarray, layers: list[int], context) -> Column:
    """The most probable class of each vector."""
    held = context.broadcast(over_raw(split(weights, layers), *scaling(low, high)))

    @F.arrow_udf("int")
    def most_probable(batch: pa.Array) -> pa.Array:
        rows = Rows.of(batch)
        found = [activations(block, held.value)[-1].argmax(axis=1) for _, _, block in rows.blocks()]
        return pa.array(np.concatenate([*found, np.empty(0, int)]).astype(np.int32), pa.int32())

    return most_probable(vectors)
