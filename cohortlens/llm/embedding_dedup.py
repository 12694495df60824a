"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of at least c are within eps = sqrt(2 - 2c). On the leading
principal axes they lie in grid cells, several to eps; in the order of these cells, runs
of vectors are blocks with bounds on more of the axes. Two sequences of blocks are joined
recursively: intervals whose bounds are farther apart than eps cannot hold a link and are
skipped; the others are split, down to pairs of blocks and to short runs within them.
What is left is compared on the leading axes first, and in full only where these leave
a distance of at most eps.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, packed
from cohortlens.llm.components import components

#: Least cosine of a link, vectors of a block, of a run within it, children of an interval.
COSINE = 0.93
BLOCK = 1024
RUN = 32
FAN = 8
#: Leading axes of the grid order, its cells to eps, and leading axes of bounds and first comparisons.
AXES = 6
FINE = 4
BOUNDS = 16
#: Room for rounding in squared distances of unit vectors.
SLACK = 1e-9
#: Partial sums of moments meet in so many groups first.
GROUPS = 64

_BLOCK = "label int, dim int, part int, seq int, lo array<double>, hi array<double>, ids binary, weights binary, vectors binary"


@contextmanager
def _few_rows_a_batch(spark: SparkSession, rows: int = 8):
    """Arrow batches of few rows while blocks of vectors go through Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reach(cosine: float) -> float:
    """Squared distance within which unit vectors of at least this cosine lie."""
    return 2 - 2 * cosine + SLACK


def principal_axes(classes: DataFrame, axes: int = BOUNDS) -> dict[int, np.ndarray]:
    """The leading principal axes of the unit vectors of each dimension.

    Every task sends one matrix of sums for a dimension; they are added up in groups.
    The axes only steer what is skipped.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = _units(_matrix(batch.column(1).take(pa.array(own))))
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                total[int(dim)] = total.get(int(dim), 0) + x.T @ x
                part = (part + len(own)) % GROUPS
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([m.tobytes()])],
                ["dim", "part", "m"],
            )

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        m = sum(np.frombuffer(b) for b in rows["m"])
        return pd.DataFrame({"dim": rows["dim"][:1], "part": rows["part"][:1], "m": [m.tobytes()]})

    schema = "dim int, part int, m binary"
    rows = classes.select("dim", "vector").mapInArrow(sums, schema)
    found: dict[int, np.ndarray] = {}
    for r in rows.groupBy("dim", "part").applyInPandas(added, schema).collect():
        size = r["dim"] + 1
        found[r["dim"]] = found.get(r["dim"], 0) + np.frombuffer(bytes(r["m"])).reshape(size, size)
    out = {}
    for dim, m in found.items():
        n = m[-1, -1]
        mean = m[-1, :-1] / n
        _, vectors = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
        out[dim] = vectors[:, ::-1][:, : min(axes, dim)]
    return out


def vector_classes(rows: DataFrame) -> DataFrame:
    """(cid, label, dim, vector, n, first) of each distinct usable vector of a label.

    Usable: label and vector not NULL, no NULL or non-finite component, not all zero.
    """
    usable = rows.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").alias("vector")).filter(
        "label IS NOT NULL AND size(vector) > 0"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(vector, x -> x != 0)"
    )
    classes = usable.groupBy("label", "vector").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first")
    )
    return cut(
        classes.select(
            F.monotonically_increasing_id().alias("cid"),
            "label",
            F.size("vector").alias("dim"),
            "vector",
            "n",
            "first",
        ),
        "vector-classes",
    )


def _on_axes(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the leading axes; zeros stand for axes that short vectors lack."""
    found = _units(vectors) @ axes
    return np.pad(found, ((0, 0), (0, BOUNDS - found.shape[1])))


def grid_blocks(classes: DataFrame, held, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Runs of at most ``block`` vectors in grid order, with their range on each leading axis.

    ``held`` is the broadcast of the axes by dimension, a matrix of ``BOUNDS`` columns each.
    """
    width = float(np.sqrt(reach(cosine))) / FINE

    @F.pandas_udf("array<int>")
    def cells(dims: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.zeros((len(dims), AXES), np.int32)
        for dim in dims.unique():
            own = np.flatnonzero(dims == dim)
            x = np.stack(vectors.iloc[own].to_numpy()).astype(np.float64)
            out[own] = np.floor(_on_axes(x, held.value[dim])[:, :AXES] / width)
        return pd.Series(list(out), dtype=object)

    placed = classes.withColumn("cell", cells("dim", "vector"))
    ordered = placed.repartitionByRange("label", "dim", "cell", "cid").sortWithinPartitions(
        "label", "dim", "cell", "cid"
    )
    runs = ordered.select("label", "dim", "cell", "cid", "n", "vector", F.spark_partition_id().alias("part"))
    return runs.mapInArrow(lambda b: _block_rows(b, block, held.value), _BLOCK)


def _block_rows(batches: Iterator[pa.RecordBatch], block: int, axes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    seq = 0

    def made(t: pa.Table) -> pa.RecordBatch:
        kind = t.column("vector").type.value_type
        vectors = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = vectors.astype(np.float32 if pa.types.is_float32(kind) else np.float64)
        head = {c: int(t.column(c)[0].as_py()) for c in ("label", "dim", "part")}
        places = _on_axes(vectors.astype(np.float64).reshape(t.num_rows, -1), axes[head["dim"]])
        row = head | {
            "seq": seq,
            "lo": places.min(axis=0).tolist(),
            "hi": places.max(axis=0).tolist(),
            "ids": t.column("cid").to_numpy().astype(np.int64).tobytes(),
            "weights": t.column("n").to_numpy().astype(np.int64).tobytes(),
            "vectors": vectors.tobytes(),
        }
        types = [pa.int32()] * 4 + [pa.list_(pa.float64())] * 2 + [pa.binary()] * 3
        names = ["label", "dim", "part", "seq", "lo", "hi", "ids", "weights", "vectors"]
        return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, types, strict=True)], names)

    def key(t: pa.Table) -> np.ndarray:
        return np.stack([t.column(c).to_numpy() for c in ("label", "dim")], axis=1)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        while held.num_rows:
            k = key(held)
            other = np.flatnonzero((k != k[0]).any(axis=1))
            n = min(block, int(other[0])) if len(other) else block
            if n > held.num_rows or (not len(other) and n == held.num_rows):
                break
            yield made(held.slice(0, n))
            held, seq = held.slice(n), seq + 1
    if held is not None and held.num_rows:
        yield made(held)


def _bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    low = [F.min(F.col("lo")[i]) for i in range(BOUNDS)]
    high = [F.max(F.col("hi")[i]) for i in range(BOUNDS)]
    return rows.groupBy(*keys).agg(F.array(*low).alias("lo"), F.array(*high).alias("hi"))


def block_pairs(blocks: DataFrame, cosine: float = COSINE, fan: int = FAN) -> DataFrame:
    """(label, dim, a, b) with a <= b of blocks that may hold a link.

    Blocks of a label are numbered in grid order. Level k has intervals of fan^k
    blocks; from the one interval on top, each pair that is not provably distant is
    split into the pairs of its children.
    """
    numbered = blocks.select("label", "dim", "no", "lo", "hi")
    top = numbered.agg(F.max("no")).first()[0] or 0
    levels = [numbered]
    while top >= 1:
        top //= fan
        levels.append(
            _bounds(levels[-1].withColumn("no", F.floor(F.col("no") / fan).cast("bigint")), ["label", "dim", "no"])
        )
    apart = " + ".join(
        f"power(greatest(la[{i}] - hb[{i}], lb[{i}] - ha[{i}], 0D), 2)" for i in range(BOUNDS)
    )
    near = f"{apart} <= {reach(cosine)!r}D"
    pairs = levels[-1].select("label", "dim", F.col("no").alias("a"), F.col("no").alias("b"))
    for level in reversed(levels[:-1]):
        one = level.select("label", "dim", F.col("no").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        two = level.select("label", "dim", F.col("no").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        children = F.sequence(F.lit(0).cast("bigint"), F.lit(fan - 1).cast("bigint"))
        split = (
            pairs.withColumn("i", F.explode(children))
            .withColumn("j", F.explode(children))
            .select("label", "dim", (F.col("a") * fan + F.col("i")).alias("a"), (F.col("b") * fan + F.col("j")).alias("b"))
            .filter("a <= b")
        )
        pairs = (
            split.join(one, ["label", "dim", "a"])
            .join(two, ["label", "dim", "b"])
            .filter(near)
            .select("label", "dim", "a", "b")
        )
    return pairs


def _compared(batches: Iterator[pa.RecordBatch], cosine: float, axes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _pair_links(row, cosine, axes[row["dim"]])


def _run_bounds(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First vector of each run of ``RUN``, and the run's range on the leading axes."""
    begin = np.arange(0, len(places), RUN)
    return begin, np.minimum.reduceat(places, begin), np.maximum.reduceat(places, begin)


def linked_vectors(
    x: np.ndarray, y: np.ndarray, axes: np.ndarray, cosine: float = COSINE
) -> tuple[np.ndarray, int, int]:
    """Which vectors of ``x`` and ``y`` link, and how many pairs were compared on the axes and in full.

    Runs whose bounds are farther apart than eps are skipped. Of the others, pairs that
    the leading axes alone set farther apart are left out; the cosine decides the rest.
    """
    linked = np.zeros((len(x), len(y)), bool)
    p, q = _on_axes(x, axes), _on_axes(y, axes)
    most = reach(cosine)
    begin, low, high = _run_bounds(p)
    begin2, low2, high2 = _run_bounds(q)
    norm, norm2 = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    size2 = np.diff(np.append(begin2, len(y)))
    square, square2 = (p * p).sum(axis=1), (q * q).sum(axis=1)
    first = full = 0
    for at, lo, hi in zip(begin, low, high, strict=True):
        gap = np.maximum(np.maximum(lo - high2, low2 - hi), 0)
        columns = np.flatnonzero(np.repeat((gap * gap).sum(axis=1) <= most, size2))
        rows = slice(at, at + RUN)
        apart = square[rows, None] + square2[columns] - 2 * (p[rows] @ q[columns].T)
        i, j = np.nonzero(apart <= most)
        first += apart.size
        if 4 * len(i) > apart.size:
            full += apart.size
            dots = x[rows] @ y[columns].T
            linked[rows, columns] = dots / (norm[rows, None] * norm2[columns]) >= cosine
        else:
            full += len(i)
            i, j = i + at, columns[j]
            dots = np.einsum("ij,ij->i", x[i], y[j])
            linked[i, j] = dots / (norm[i] * norm2[j]) >= cosine
    return linked, first, full


def _pair_links(row: dict, cosine: float, axes: np.ndarray) -> pa.RecordBatch:
    """(cid, n, root) of vectors of a block pair that have links in it.

    ``n`` counts the linked vectors with their copies; ``root`` joins what this pair's
    links connect.
    """
    same = row["a"] == row["b"]

    def side(name: str):
        ids = np.frombuffer(row[f"ids_{name}"], np.int64)
        raw = row[f"vectors_{name}"]
        kind = np.float32 if len(raw) == 4 * row["dim"] * len(ids) else np.float64
        x = np.frombuffer(raw, kind).reshape(len(ids), -1).astype(np.float64)
        return ids, np.frombuffer(row[f"weights_{name}"], np.int64), x / np.abs(x).max(axis=1, keepdims=True)

    ids, weights, x = side("a")
    ids2, weights2, x2 = (ids, weights, x) if same else side("b")
    linked, _, _ = linked_vectors(x, x2, axes, cosine)
    if same:
        np.fill_diagonal(linked, False)
        count = linked @ weights
        all_ids, graph = ids, linked
    else:
        count = np.concatenate([linked @ weights2, linked.T @ weights])
        all_ids = np.concatenate([ids, ids2])
        graph = np.zeros((len(all_ids),) * 2, bool)
        graph[: len(ids), len(ids) :] = linked
        graph[len(ids) :, : len(ids)] = linked.T
    own = np.flatnonzero(graph.any(axis=1))
    root = np.full(len(all_ids), -1)
    for v in own[np.argsort(all_ids[own])]:
        if root[v] < 0:
            wave = np.array([v])
            root[v] = v
            while len(wave):
                wave = np.flatnonzero(graph[wave].any(axis=0) & (root < 0))
                root[wave] = v
    return pa.RecordBatch.from_arrays(
        [pa.array(all_ids[own]), pa.array(count[own]), pa.array(all_ids[root[own]])], ["cid", "n", "root"]
    )


def vector_links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(cid, n, root) rows: linked vectors of each class by block pair, and whom they connect."""
    spark = classes.sparkSession
    numbering = Window.partitionBy("label", "dim").orderBy("part", "seq")
    held = spark.sparkContext.broadcast(principal_axes(classes))
    blocks = cut(grid_blocks(classes, held, cosine, block), "grid-blocks")
    bounds = cut(
        blocks.select("label", "dim", "part", "seq", "lo", "hi").withColumn(
            "no", (F.row_number().over(numbering) - 1).cast("bigint")
        ),
        "grid-bounds",
    )
    pairs = block_pairs(bounds, cosine)
    data = blocks.drop("lo", "hi").join(bounds.drop("lo", "hi"), ["label", "dim", "part", "seq"])

    def named(name: str) -> DataFrame:
        held = [F.col(c).alias(f"{c}_{name}") for c in ("ids", "weights", "vectors")]
        return data.select("label", "dim", F.col("no").alias(name), *held)

    met = pairs.join(named("a"), ["label", "dim", "a"]).join(named("b"), ["label", "dim", "b"])
    with _few_rows_a_batch(spark):
        links = met.mapInArrow(lambda b: _compared(b, cosine, held.value), "cid bigint, n bigint, root bigint")
        return cut(links, "vector-links")


def dedup_embeddings(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``rows`` with ``n_links``, ``component_id`` and ``kept``.

    Vectors of equal label and length link at a cosine of ``cosine`` or more, in
    double precision. Equal vectors are one class, compared once; block pairs yield
    sums and spanning links, never pairs of a group. Vectors that are NULL, empty,
    zero or hold NULL or non-finite components, and those without label, link with
    nothing. ``component_id`` is the smallest ``vec_id`` reachable, its own for a
    vector without links; of rows without ``vec_id`` none counts as smallest. Columns
    with the names of the results are replaced. An empty table gives no rows.
    """
    classes = vector_classes(rows)
    links = vector_links(classes, cosine)
    roots = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    degrees = links.groupBy("cid").agg(F.sum("n").alias("others"))
    found = (
        classes.join(degrees, "cid", "left")
        .join(roots, F.col("cid") == F.col("vertex"), "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    firsts = found.groupBy("root").agg(F.min("first").alias("component"))
    by_class = cut(
        found.join(firsts, "root").select(
            F.col("label").alias("class_label"),
            F.col("vector").alias("class_vector"),
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"),
            "component",
        ),
        "vector-results",
    )
    base = rows.drop("n_links", "component_id", "kept")
    joined = packed(base).join(
        by_class,
        (F.col("row.label").cast("int") == F.col("class_label")) & (F.col("row.embedding") == F.col("class_vector")),
        "left",
    )
    component = F.coalesce("component", "row.vec_id")
    return joined.select(
        "row.*",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("row.vec_id") == component, F.lit(True)).alias("kept"),
    )


def embedding_digest(rows: DataFrame) -> DataFrame:
    """Per vector: links, component and whether it stays."""
    found = dedup_embeddings(rows.select("vec_id", "label", "embedding"))
    return found.select("vec_id", "n_links", "component_id", "kept")
