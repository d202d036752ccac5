"""Cosine similarity join of vectors by epsilon grid order.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the join looks for pairs within that distance. Vectors
are projected on their leading principal directions, which never lengthens a distance, cut into grid cells
as wide as the distance, and sorted by cell. The sequence is cut into blocks; intervals of blocks are joined
recursively, from few long ones down to single blocks, and a pair of intervals whose bounding boxes are
further apart than the distance is skipped with all that is in it. Blocks that are left meet in a task, where
cosines are taken in double precision.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from deltascope.llm import common, components

COSINE = 0.93
#: Vectors that the principal directions are fitted on, how many directions, vectors of a block, children of an interval.
SAMPLE, DIRECTIONS, BLOCK, FAN = 20_000, 8, 1024, 8
_SLACK = 1e-6


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(x, kind) for x in raw]).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # keeps squares of very large or small numbers in range
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def prepare(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, width, digest and raw bytes; digest and raw are null where a vector can't have links."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, digests, raws = [], [], []
            for vec_id, label, x in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
                raw = None
                if vec_id is not None and label is not None and x.is_valid and len(x.values) and not x.values.null_count:
                    values = x.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(values).all() and values.any():
                        raw = (values + 0).astype(kind).tobytes()
                widths.append(len(raw) if raw else None)
                digests.append(hashlib.md5(raw).digest() if raw else None)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(widths, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "width", "digest", "raw"])

    return vectors.mapInArrow(read, "vec_id long, label string, width int, digest binary, raw binary")


def directions(sample: list[bytes], kind: str, count: int = DIRECTIONS) -> np.ndarray:
    """Orthonormal rows: the leading principal directions of the sample."""
    rows = _unit(sample, kind)
    rows = rows - rows.mean(axis=0)
    _, vectors = np.linalg.eigh(rows.T @ rows)
    return np.ascontiguousarray(vectors[:, ::-1][:, :count].T)


def block_links(a: np.ndarray, b: np.ndarray | None, cosine: float) -> np.ndarray:
    """Which rows of a link with which of b, or of a itself (without the diagonal)."""
    other = a if b is None else b
    linked = a @ other.T >= cosine
    if b is None:
        np.fill_diagonal(linked, False)
    return linked


def all_linked(a: np.ndarray, b: np.ndarray, cosine: float) -> bool:
    """Whether the balls around both blocks prove that every pair links."""
    x, y = a.mean(axis=0), b.mean(axis=0)
    reach = np.sqrt(((a - x) ** 2).sum(axis=1).max()) + np.sqrt(((b - y) ** 2).sum(axis=1).max()) + np.sqrt(((x - y) ** 2).sum())
    return reach < np.sqrt(2 - 2 * cosine) - _SLACK


def spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column the smallest node that links within the block pair reach."""
    low, other = left.copy(), right.copy()
    none = np.iinfo(np.int64).max
    while True:
        row = np.minimum(low, np.where(linked, other, none).min(axis=1, initial=none))
        column = np.minimum(other, np.where(linked, row[:, None], none).min(axis=0, initial=none))
        if (row == low).all() and (column == other).all():
            return low, other
        low, other = row, column


def near_pairs(blocks: DataFrame, distance: float, fan: int = FAN) -> DataFrame:
    """label, width, x, y (x <= y): numbers of the blocks whose boxes are within the distance, found from long intervals down."""
    keys = ["label", "width"]
    most = blocks.agg(F.max("number")).first()[0]
    if most is None:
        return blocks.select(*keys, F.col("number").alias("x"), F.col("number").alias("y"))
    levels = 0
    while fan**levels <= most:
        levels += 1

    def boxes(level: int) -> DataFrame:
        ends = [f(F.col(side)[k]).alias(f"{side}{k}") for side, f in (("low", F.min), ("high", F.max)) for k in range(DIRECTIONS)]
        grouped = blocks.groupBy(*keys, F.floor(F.col("number") / fan**level).alias("at")).agg(*ends)
        return grouped.select(*keys, "at", *[F.array(*[F.col(f"{side}{k}") for k in range(DIRECTIONS)]).alias(side) for side in ("low", "high")])

    def apart(k: int):
        gap = F.greatest(F.col("high")[k] * 0, F.col("low")[k] - F.col("other_high")[k], F.col("other_low")[k] - F.col("high")[k])
        return gap * gap

    square = sum((apart(k) for k in range(1, DIRECTIONS)), apart(0))
    pairs = boxes(levels).select(*keys, F.col("at").alias("x"), F.col("at").alias("y"))
    for level in range(levels - 1, -1, -1):
        children = F.sequence(F.lit(0), F.lit(fan - 1))
        split = pairs.select(*keys, (F.col("x") * fan).alias("x"), F.explode(children).alias("i"), (F.col("y") * fan).alias("y"))
        split = split.select(*keys, (F.col("x") + F.col("i")).alias("x"), "y", F.explode(children).alias("j")).select(*keys, "x", (F.col("y") + F.col("j")).alias("y")).where("x <= y")
        box = boxes(level)
        left = box.withColumnRenamed("at", "x")
        right = box.select(*keys, F.col("at").alias("y"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
        met = split.join(left, [*keys, "x"]).join(right, [*keys, "y"])
        pairs = common.stored(met.where(square <= (distance + _SLACK) ** 2).select(*keys, "x", "y"), "intervals")
    return pairs


def similar_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Only vectors with equal, non-null labels and equal length are compared. A vector that is null, empty,
    zero, or holds null or non-finite numbers has no links and is a component of its own; so is a row with
    a null id, whose component_id and kept are null. Equal vectors are compared once and counted as often as
    they occur. Rows with one id share a component.
    """
    spark = vectors.sparkSession
    distance = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    if kind == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    prepared = common.stored(prepare(rows, kind), "vectors")
    keys = ["label", "width", "digest"]
    distinct = common.stored(prepared.where("raw is not null").groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "distinct")
    axes = {}
    for width, count in distinct.groupBy("width").count().orderBy("width").collect():
        sample = common.hash_sample(distinct.where(F.col("width") == width), F.xxhash64("node"), SAMPLE, count).select("raw").collect()
        axes[width] = directions([bytes(r.raw) for r in sample], kind)
    names = [f"p{k}" for k in range(DIRECTIONS)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.zeros((batch.num_rows, DIRECTIONS))
            widths, raws = batch.column("width").to_pylist(), batch.column("raw").to_pylist()
            for width in set(widths) & axes.keys():
                own = [k for k, w in enumerate(widths) if w == width]
                found = _unit([raws[k] for k in own], kind) @ axes[width].T
                places[own, : found.shape[1]] = found
            columns = [pa.array(places[:, k]) for k in range(DIRECTIONS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    placed = distinct.select("label", "width", "node", "copies", "raw").mapInArrow(project, "label string, width int, node long, copies long, raw binary, " + ", ".join(f"{n} double" for n in names))
    placed = common.stored(placed, "projected")
    cells = [F.floor(F.col(n) / distance) if distance > 0 else F.col(n) for n in names]
    order = ["label", "width", *cells, *names[:2], "node"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, number = TaskContext.get().partitionId(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, number
            first = held[0]
            places = np.array([r[5:] for r in held])
            out = {
                "label": [first[0]], "width": pa.array([first[1]], pa.int32()), "task": pa.array([task], pa.int32()), "part": [number],
                "nodes": [[r[2] for r in held]], "copies": [[r[3] for r in held]], "raws": [[r[4] for r in held]], "low": [places.min(axis=0).tolist()], "high": [places.max(axis=0).tolist()],
            }
            held, number = [], number + 1
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (row[:2] != held[0][:2] or len(held) >= block):
                    yield close()
                held.append(row)
        if held:
            yield close()

    shape = "label string, width int, task int, part long, nodes array<long>, copies array<long>, raws array<binary>, low array<double>, high array<double>"
    blocks = ordered.mapInArrow(cut, shape)
    blocks = common.stored(blocks, "blocks")
    head = blocks.select("label", "width", "task", "part", "low", "high").withColumn("number", F.row_number().over(Window.partitionBy("label", "width").orderBy("task", "part")).cast("long") - 1)
    head = common.stored(head, "heads")
    numbered = blocks.join(head.select("label", "width", "task", "part", "number"), ["label", "width", "task", "part"]).select("label", "width", "number", "nodes", "copies", "raws")
    left = numbered.select("label", "width", F.col("number").alias("x"), "nodes", "copies", "raws")
    right = numbered.select("label", "width", F.col("number").alias("y"), F.col("nodes").alias("other_nodes"), F.col("copies").alias("other_copies"), F.col("raws").alias("other_raws"))
    meeting = near_pairs(head, distance).join(left, ["label", "width", "x"]).join(right, ["label", "width", "y"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nodes, copies, raws, others, other_copies, other_raws = (batch.column(c)[k].as_py() for c in ("nodes", "copies", "raws", "other_nodes", "other_copies", "other_raws"))
                alone = batch.column("x")[k].as_py() == batch.column("y")[k].as_py()
                nodes, copies, others, other_copies = (np.array(v, np.int64) for v in (nodes, copies, others, other_copies))
                a = _unit(raws, kind)
                b = a if alone else _unit(other_raws, kind)
                if all_linked(a, b, cosine):
                    counts = other_copies.sum() - (copies if alone else 0), copies.sum()
                    low = np.full(len(nodes), min(nodes.min(), others.min())), np.full(len(others), min(nodes.min(), others.min()))
                    counts = np.broadcast_to(counts[0], len(nodes)), np.broadcast_to(counts[1], len(others))
                else:
                    linked = block_links(a, None if alone else b, cosine)
                    counts = linked @ other_copies, copies @ linked
                    low = spanning(linked, nodes, others)
                sides = [(nodes, counts[0], low[0])] + ([] if alone else [(others, counts[1], low[1])])
                found = [np.concatenate([s[i] for s in sides]).astype(np.int64) for i in range(3)]
                kept = (found[1] > 0) | (found[2] != found[0])
                yield pa.RecordBatch.from_arrays([pa.array(f[kept]) for f in found], names=["node", "links", "low"])

    compared = common.stored(meeting.mapInArrow(compare, "node long, links long, low long"), "compared")
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    valid = prepared.where("raw is not null and vec_id is not null").select("vec_id", *keys).join(distinct.select(*keys, "node"), keys)
    joined = compared.select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(components.same_id_links(valid, "vec_id"))
    classes = components.components(joined)
    named = distinct.select(*keys, "node", "copies").join(links, "node", "left").join(classes, "node", "left")
    named = named.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    members = prepared.select("vec_id", *keys).join(named, keys, "left")
    # A row without a usable vector is in the component of the other rows with its id.
    again = prepared.where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1").select("vec_id")
    by_id = members.join(again, "vec_id").groupBy("vec_id").agg(F.min("component_id").alias("of_id")).where("of_id is not null")
    members = members.join(by_id, "vec_id", "left")
    out = members.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("of_id", "component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
