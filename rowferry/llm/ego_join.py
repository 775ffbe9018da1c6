"""Embedding near-dedup as an epsilon grid order join.

Unit vectors are projected on their leading principal dimensions, ordered by grid cell,
and cut into sequence intervals. Pairs of intervals are joined recursively from the whole
sequence of a label downwards; a pair whose bounding boxes are further apart than epsilon
is dropped, because a projection never lengthens a distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.graph import components
from rowferry.storage import materialize

DIMS = 6
INTERVAL = 1024
LEAF = 64
FAN = 8
PCA_DIMS = 256
SLACK = 1e-9


def usable(vector: str) -> Column:
    """True for vectors that are not null, not zero, and have finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _moments(batches):
    """Sums of outer products of each task, one row per matrix entry and dimension count."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, part in _by_dim(batch):
            unit = _matrix(part.column("vector"), dim)[:, :PCA_DIMS]
            sums[dim] = sums.get(dim, 0) + unit.T @ unit
    for dim, total in sums.items():
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(flat.size, dim, np.int32)), pa.array(np.arange(flat.size, dtype=np.int32)), pa.array(flat)],
            ["dim", "at", "v"],
        )


def principal_axes(classes: DataFrame, dims: int = DIMS) -> dict[int, np.ndarray]:
    """For each vector length, its leading principal axes as columns.

    Summed over all vectors, map-side first; the driver gets one matrix per vector length, of
    ``PCA_DIMS`` squared entries at most. Any orthonormal axes give right results.
    """
    sums = classes.select("dim", "vector").mapInArrow(_moments, "dim int, at int, v double")
    sums = sums.groupBy("dim", "at").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for dim, part in sums.groupby("dim"):
        n = min(int(dim), PCA_DIMS)
        matrix = part.sort_values("at")["v"].to_numpy().reshape(n, n)
        axes[int(dim)] = np.linalg.eigh(matrix)[1][:, ::-1][:, :dims]
    return axes


def _projector(axes: dict[int, np.ndarray], epsilon: float):
    """Adds the projection ``y`` and the grid cells ``cell`` to each vector."""

    def run(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                axis = axes[dim]
                y = _matrix(part.column("vector"), dim)[:, : axis.shape[0]] @ axis
                y = np.pad(y, ((0, 0), (0, DIMS - y.shape[1])))
                cell = np.floor(y / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(y)), pa.array(list(cell))], [*part.schema.names, "y", "cell"]
                )

    return run


def _interval(rows: list[pa.RecordBatch], serial: int) -> pa.RecordBatch:
    whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    y = np.array(whole.column("y").to_pylist())
    flat = whole.column("vector").flatten()
    return pa.RecordBatch.from_pylist([{
        "label": whole.column("label")[0].as_py(), "dim": whole.column("dim")[0].as_py(),
        "task": TaskContext.get().partitionId(), "serial": serial,
        "low": y.min(axis=0).tolist(), "high": y.max(axis=0).tolist(),
        "cids": whole.column("cid").to_numpy().tobytes(), "weights": whole.column("n").to_numpy().tobytes(),
        "ys": y.tobytes(), "vectors": flat.to_numpy(zero_copy_only=False).astype(np.float64).tobytes(),
    }], schema=INTERVAL_SCHEMA)


INTERVAL_DDL = (
    "label long, dim int, task int, serial int, low array<double>, high array<double>, "
    "cids binary, weights binary, ys binary, vectors binary"
)
INTERVAL_SCHEMA = pa.schema([
    ("label", pa.int64()), ("dim", pa.int32()), ("task", pa.int32()), ("serial", pa.int32()),
    ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
    ("cids", pa.binary()), ("weights", pa.binary()), ("ys", pa.binary()), ("vectors", pa.binary()),
])


def _intervals(batches):
    """Consecutive rows of one label, at most ``INTERVAL`` of them, as one packed row."""
    held: list[pa.RecordBatch] = []
    count, serial, key = 0, 0, None
    for batch in batches:
        labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
        edges = np.flatnonzero((np.diff(labels) != 0) | (np.diff(dims) != 0)) + 1
        for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            at = start
            while at < stop:
                now = (labels[at], dims[at])
                if held and (now != key or count >= INTERVAL):
                    yield _interval(held, serial)
                    held, count, serial = [], 0, serial + 1
                key, size = now, min(stop - at, INTERVAL - count)
                held.append(batch.slice(at, size))
                count, at = count + size, at + size
    if held:
        yield _interval(held, serial)


def _near(a: str, b: str, epsilon: float) -> Column:
    """True unless two boxes are provably further apart than ``epsilon``."""
    gap = F.zip_with(
        F.zip_with(f"{a}low", f"{b}high", lambda x, y: x - y), F.zip_with(f"{b}low", f"{a}high", lambda x, y: x - y),
        lambda p, q: F.greatest(p, q, F.lit(0.0)),
    )
    return F.aggregate(gap, F.lit(0.0), lambda t, g: t + g * g) <= (epsilon + SLACK) ** 2


def interval_pairs(boxes: DataFrame, epsilon: float) -> DataFrame:
    """Pairs ``(id_a, id_b)`` of intervals that may hold links, ``id_a <= id_b`` in sequence order.

    ``boxes``: ``id, label, dim, place`` (position in the label's sequence), ``low``, ``high``.
    Starts with each label's whole sequence and splits both sides ``FAN`` ways per level, so
    distant stretches are dropped long before single intervals are compared.
    """
    top = boxes.agg(F.max("place")).first()[0] or 0
    levels = 0
    while FAN**levels <= top:
        levels += 1

    def nodes(level: int) -> DataFrame:
        bounds = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(DIMS)]
        bounds += [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(DIMS)]
        node = F.floor(F.col("place") / FAN**level).alias("node")
        return boxes.groupBy("label", "dim", node).agg(*bounds).select(
            "label", "dim", "node", F.array(*[f"l{i}" for i in range(DIMS)]).alias("low"),
            F.array(*[f"h{i}" for i in range(DIMS)]).alias("high"),
        )

    pairs = nodes(levels).select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in range(levels - 1, -1, -1):
        child = nodes(level).withColumn("up", F.floor(F.col("node") / FAN))
        sides = [
            child.select("label", "dim", F.col("up").alias(s), F.col("node").alias(f"{s}{s}"), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high"))
            for s in "ab"
        ]
        pairs = pairs.join(sides[0], ["label", "dim", "a"]).join(sides[1], ["label", "dim", "b"])
        pairs = pairs.where((F.col("aa") <= F.col("bb")) & _near("a_", "b_", epsilon))
        pairs = pairs.select("label", "dim", F.col("aa").alias("a"), F.col("bb").alias("b"))
    return pairs


def _unpack(batch: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, ...]:
    def get(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(batch.column(f"{side}_{name}")[i].as_py(), kind)

    cids = get("cids", np.int64)
    vectors = get("vectors", np.float64).reshape(cids.size, -1)
    norms = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / norms
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return cids, get("weights", np.int64), get("ys", np.float64).reshape(cids.size, -1), vectors


def _apart(a: np.ndarray, b: np.ndarray, epsilon: float) -> bool:
    gap = np.maximum(np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)), 0)
    return float(gap @ gap) > (epsilon + SLACK) ** 2


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links ``a-b`` to connect what they connect."""
    root, kept = list(range(size)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _join_intervals(x: tuple, y: tuple, same: bool, cosine: float, epsilon: float):
    """Links between two intervals: weighted degrees, and a spanning forest of the links.

    Recursion halves the longer side until both are leaves, skipping halves that are
    provably distant; a leaf pair is one matrix product, and counts are added up there.
    """
    degree = [np.zeros(x[0].size, np.int64), np.zeros(y[0].size, np.int64)]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def recurse(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0 or _apart(x[2][a0:a1], y[2][b0:b1], epsilon):
            return
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            if a1 - a0 >= b1 - b0:
                mid = (a0 + a1) // 2
                recurse(a0, mid, b0, b1)
                recurse(mid, a1, b0, b1)
            else:
                mid = (b0 + b1) // 2
                recurse(a0, a1, b0, mid)
                recurse(a0, a1, mid, b1)
            return
        near = x[3][a0:a1] @ y[3][b0:b1].T >= cosine
        if same:
            near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        i, j = np.nonzero(near)
        if i.size:
            degree[0][a0:a1] += near @ y[1][b0:b1]
            degree[1][b0:b1] += near.T @ x[1][a0:a1]
            keep = _forest(a1 - a0 + b1 - b0, i, j + (a1 - a0))
            left.append(np.array([p for p, _ in keep]) + a0)
            right.append(np.array([q for _, q in keep]) - (a1 - a0) + b0)

    recurse(0, x[0].size, 0, y[0].size)
    if same:
        degree = [degree[0] + degree[1], np.zeros(0, np.int64)]
    if not left:
        return degree, (np.zeros(0, np.int64),) * 2
    a, b = np.concatenate(left), np.concatenate(right)
    shift = 0 if same else x[0].size
    keep = np.array(_forest(x[0].size + shift + y[0].size, a, b + shift), np.int64).reshape(-1, 2)
    return degree, (x[0][keep[:, 0]], y[0][keep[:, 1] - shift])


def _linker(cosine: float, epsilon: float):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("same")[i].as_py()
                x, y = _unpack(batch, i, "a"), _unpack(batch, i, "b")
                degree, (a, b) = _join_intervals(x, y, same, cosine, epsilon)
                for side, count in zip((x, y), degree, strict=True):
                    hit = np.flatnonzero(count)
                    nothing = pa.nulls(hit.size, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(side[0][hit]), nothing, pa.array(count[hit])], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(a.size, pa.int64())], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``vectors`` needs ``vec_id``, ``embedding`` (an array of numbers) and ``label``; other columns
    aren't read. Vectors link when labels are equal and not null, lengths are equal and the
    cosine, in double precision, reaches ``cosine``. Null, zero and non-finite vectors link with
    nothing. Equal vectors of a label are one class with a multiplicity, so copies cost
    nothing and still count in ``n_links``. Repeated rows are vectors of their own; a null
    id takes part but never names a component while others do. An empty table gives no rows.

    All class pairs inside a cluster are counted in the tasks that compare them; only degrees and
    spanning forests leave these tasks, so dense clusters don't emit their pairs.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    rows = rows.withColumn("live", usable("vector") & F.col("label").isNotNull())
    classes = rows.where("live").groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = classes.select(
        F.monotonically_increasing_id().alias("cid"), "label", F.size("vector").alias("dim"), "n", "first", "vector"
    )
    classes = materialize(classes, "ego-classes")  # class ids must not change between readers
    axes = principal_axes(classes)
    shape = "cid long, label long, dim int, n long, first long, vector array<{}>, y array<double>, cell array<int>"
    kind = classes.schema["vector"].dataType.elementType.simpleString()
    placed = classes.mapInArrow(_projector(axes, epsilon), shape.format(kind))
    ordered = placed.repartitionByRange("label", "dim", "cell", "cid").sortWithinPartitions("label", "dim", "cell", "cid")
    packed = materialize(ordered.mapInArrow(_intervals, INTERVAL_DDL), "ego-intervals")

    places = packed.groupBy("label", "dim", "task").agg(F.count("*").alias("m"), F.min("serial").alias("s0"))
    before = Window.partitionBy("label", "dim").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("s0")  # one row per label and range partition
    known = places.select("label", "dim", "task", shift.alias("shift"))
    located = packed.join(known, ["label", "dim", "task"]).withColumn("place", F.col("serial") + F.col("shift"))
    pairs = interval_pairs(located.select("label", "dim", "place", "low", "high"), epsilon)

    payload = ["cids", "weights", "ys", "vectors"]
    sides = [
        located.select("label", "dim", F.col("place").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in payload]) for s in "ab"
    ]
    tasks = pairs.join(sides[0], ["label", "dim", "a"]).join(sides[1], ["label", "dim", "b"])
    tasks = tasks.withColumn("same", F.col("a") == F.col("b")).drop("label", "dim", "a", "b")
    found = materialize(tasks.mapInArrow(_linker(cosine, epsilon), "a long, b long, n long"), "ego-links")

    degrees = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "cid")
    every = classes.select("cid", "label", "vector", "n", "first").join(degrees, "cid", "left").join(roots, "cid", "left")
    every = every.withColumn("root", F.coalesce("root", "cid"))
    names = every.groupBy("root").agg(F.min("first").alias("component_id"))
    every = every.join(names, "root").select(
        "label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    alone = rows.where(~F.col("live")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("live").join(every, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
