"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

Shingles are windows of five words. A shingle weighs its count in the text times 1 + IDF_SHARE * log10(1 / f),
f the share of documents that hold it, but at least RARE: so a rarer shingle counts for more, and what many
copies of one text have in common still counts enough for its near copies to be found. Shares are counted
over all documents in a table of fixed size by hash; as both the counts and the documents grow with the
input, so does a slot's share stay as it is.

Improved consistent weighted sampling draws BANDS * ROWS samples from each text; texts with a band in common
are candidates. Chains of candidates are gathered, large ones in blocks that meet two by two, and there the
weighted Jaccard similarity of all texts that share a band decides. Only a spanning set of the links found
leaves a task.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deltascope.llm import common, components, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 21, 6
IDF_SHARE, RARE = 0.1, 1e-3
#: Slots of the table of document shares, and pieces in which it is summed.
SLOT_BITS, PIECE_BITS = 22, 14
#: Rows of the tables that the random numbers of a shingle come from.
TABLE_BITS = 13
#: Shingles that a block of a chain of candidates holds, about.
BLOCK_SHINGLES = 1_000_000


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, ascending, their counts, and where each text's begin and end.

    A text of one to four words has one shingle, all of it; one without words has none.
    """
    codes, distinct, places = words.split(column)
    own = words.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    sizes = np.diff(places)
    at, key = words.windows(own, places, SHINGLE)
    text = np.searchsorted(places, at, side="right") - 1
    for n in range(1, SHINGLE):
        some = np.flatnonzero(sizes == n)
        if len(some):
            shorter = np.zeros(len(some), np.uint64)
            for k in range(n):
                shorter = words.mix(shorter * np.uint64(0xD6E8FEB86659FD93) + own[places[some] + k] + np.uint64(n + 2))
            at, key, text = np.concatenate([at, places[some]]), np.concatenate([key, shorter]), np.concatenate([text, some])
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(key)))
    return key[first], counts, np.searchsorted(text[first], np.arange(len(column) + 1))


def slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def share_levels(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """For each slot, the weight's level (0 to 255) from the share of documents that hold its shingles.

    Each task counts in a table of fixed size; the tables are added piece by piece. The driver gets a byte a slot.
    """
    total = max(docs.count(), 1)
    width = 1 << PIECE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for piece in common.pieces(batch, most=common.PIECE_BYTES // 2):
                key, _, bounds = shingles(piece.column("text"))
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                found = np.unique((text << SLOT_BITS) | slot(key)) & ((1 << SLOT_BITS) - 1)
                np.add.at(held, found, 1)
        if not held.any():
            return
        for k in range(0, 1 << SLOT_BITS, width):
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k // width], pa.int32()), "counts": pa.array([held[k : k + width].astype("<u4").tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = np.zeros(width, np.int64), 0
        for batch in batches:
            for number, counts in zip(batch.column("piece").to_pylist(), batch.column("counts")):
                held += np.frombuffer(counts.as_py(), "<u4")
        yield pa.RecordBatch.from_pydict({"piece": pa.array([number], pa.int32()), "levels": pa.array([level_of(held / total).tobytes()], pa.binary())})

    tables = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "piece int, counts binary")
    parts = tables.groupBy("piece").applyInArrow(add, "piece int, levels binary")
    levels = np.full(1 << SLOT_BITS, level_of(np.zeros(1))[0], np.uint8)
    for row in parts.collect():
        levels[row.piece * width : (row.piece + 1) * width] = np.frombuffer(bytes(row.levels), np.uint8)
    return levels


def level_of(share: np.ndarray) -> np.ndarray:
    """Rounded 255 * log10(1 / share) / log10(1 / RARE)."""
    return np.rint(255 * np.log10(np.clip(share, RARE, 1)) / np.log10(RARE)).astype(np.uint8)


def weights(key: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return counts * (1 + IDF_SHARE * -np.log10(RARE) * levels[slot(key)] / 255.0)


@functools.cache
def _draws() -> tuple[np.ndarray, ...]:
    """r, 1/r, ln c and b of improved consistent weighted sampling, by table row and sample."""
    rng = np.random.default_rng(20)
    shape = (1 << TABLE_BITS, BANDS * ROWS)
    r = rng.gamma(2, 1, shape).astype(np.float32) + np.float32(1e-6)
    return r, 1 / r, np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape).astype(np.float32)


def band_hashes(key: np.ndarray, weight: np.ndarray, step: int = 2048) -> np.ndarray:
    """Hash of each band of one text."""
    r, inverse, log_c, b = _draws()
    mask = np.uint64((1 << TABLE_BITS) - 1)
    x = words.mix(key)
    rows = [((x >> np.uint64(TABLE_BITS * k)) & mask).astype(np.intp) for k in range(3)]
    log_w = np.log(weight).astype(np.float32)[:, None]
    samples = np.arange(BANDS * ROWS)
    best, chosen = np.full(BANDS * ROWS, np.inf, np.float32), np.zeros(BANDS * ROWS, np.int64)
    for i in range(0, len(key), step):
        part = slice(i, i + step)
        shift = b[rows[2][part]]
        t = np.floor(log_w[part] * inverse[rows[0][part]] + shift)
        t -= shift
        t += 1
        t *= r[rows[0][part]]
        a = log_c[rows[1][part]] - t
        low = a.argmin(axis=0)
        value = a[low, samples]
        less = value < best
        best[less], chosen[less] = value[less], low[less] + i
    t = np.floor(log_w[chosen, 0] * inverse[rows[0][chosen], samples] + b[rows[2][chosen], samples]).astype(np.int64).astype(np.uint64)
    sample = words.mix(key[chosen] ^ words.mix(t * np.uint64(0x9E3779B97F4A7C15) + samples.astype(np.uint64))).reshape(BANDS, ROWS)
    out = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        out = words.mix(out * np.uint64(0xD6E8FEB86659FD93) + sample[:, k])
    return out


def spanning_links(keys: list[np.ndarray], held: list[np.ndarray], sides: np.ndarray, bands: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of texts with a band in common and at least this weighted Jaccard similarity, as many as join all that are so linked.

    sides: 0 or 1; if both occur, only pairs across are looked at. Texts that are joined already are not compared again.
    """
    count = len(keys)
    flat = np.concatenate(keys)
    owner = np.repeat(np.arange(count), [len(k) for k in keys])
    weight = np.concatenate(held)
    totals = np.bincount(owner, weight, minlength=count)
    _, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(number.max() + 2))
    owners, weights_by = owner[order], weight[order]
    ends = np.cumsum([len(k) for k in keys])
    across = sides.min() != sides.max()
    group = np.arange(count)  # texts that are joined have the same number
    found = []
    for i in range(count):
        others = (bands == bands[i]).any(axis=1)
        others[: i + 1] = False
        if across:
            others &= sides != sides[i]
        others &= group != group[i]
        # A similarity of s needs totals within a factor of s.
        others &= (totals >= similarity * totals[i] * (1 - 1e-9)) & (totals[i] >= similarity * totals * (1 - 1e-9))
        if not others.any():
            continue
        own = number[ends[i] - len(keys[i]) : ends[i]]
        lengths = starts[own + 1] - starts[own]
        stops = np.cumsum(lengths)
        at = np.arange(stops[-1]) + np.repeat(starts[own] - stops + lengths, lengths)
        common_weight = np.bincount(owners[at], np.minimum(weights_by[at], np.repeat(held[i], lengths)), minlength=count)
        linked = others & (common_weight >= similarity * (totals + totals[i] - common_weight) - 1e-9)
        joined, first = np.unique(group[linked], return_index=True)
        found += [(i, int(j)) for j in np.flatnonzero(linked)[first]]
        group[np.isin(group, joined)] = group[i]
    return found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept for each row: the smallest id of the texts that links join to it, and whether that is its own.

    Equal texts are always linked, also empty ones (a null text is empty); other texts without words have no
    links. Rows with a null id are in no class and kept. Rows with one id share a class, and so do all their copies.
    Ids are integers.
    """
    spark = docs.sparkSession
    rows = common.whole_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    levels = spark.sparkContext.broadcast(share_levels(rows))  # a byte for each of 2^SLOT_BITS slots

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, most=common.PIECE_BYTES // 2):
                key, counts, bounds = shingles(piece.column("text"))
                weight = weights(key, counts, levels.value)
                bands = [band_hashes(key[a:b], weight[a:b]).view(np.int64) if b > a else None for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("digest"), pa.array(bands, pa.list_(pa.int64())), pa.array(np.diff(bounds))], names=["doc_id", "digest", "bands", "n_shingles"])

    marked = rows.where("doc_id is not null").withColumn("digest", F.md5(F.col("text").cast("binary")))
    sketches = common.stored(marked.mapInArrow(sketch, "doc_id long, digest string, bands array<long>, n_shingles long"), "sketches")
    # One row for each text; its node is the smallest id.
    nodes = common.stored(sketches.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "texts")
    banded = nodes.where("bands is not null").select("node", F.posexplode("bands").alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "value", "low")
    chains = components.components(banded.join(buckets, ["band", "value"]).select(F.col("node").alias("a"), F.col("low").alias("b")))
    chains = common.stored(chains.join(nodes.select("node", "bands", "n_shingles"), "node"), "chains")
    large = chains.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("blocks > 1")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, most=common.PIECE_BYTES // 2):
                key, counts, bounds = shingles(piece.column("text"))
                weight = weights(key, counts, levels.value).astype("<f8")
                spans = list(zip(bounds, bounds[1:]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("node"), piece.column("component"), piece.column("bands"), pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([weight[a:b].tobytes() for a, b in spans], pa.binary())],
                    names=["node", "component", "bands", "keys", "weights"],
                )

    texts = marked.select(F.col("doc_id").alias("node"), "digest", "text").join(chains.join(nodes.select("node", "digest"), "node").hint("shuffle_hash"), ["node", "digest"]).dropDuplicates(["node", "digest"])
    sized = texts.select("node", "component", "bands", "text").mapInArrow(vectors, "node long, component long, bands array<long>, keys binary, weights binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    blocked = sized.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    # Block x meets block y in the task (x, y), and itself in (x, x).
    meeting = blocked.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        node = table.column("node").to_pylist()
        keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        held = [np.frombuffer(w, "<f8") for w in table.column("weights").to_pylist()]
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sides = np.array([a != b for a, b in zip(table.column("own").to_pylist(), table.column("x").to_pylist())], np.int8)
        links = spanning_links(keys, held, sides, bands, similarity) if len(node) > 1 else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([node[i] for i, _ in links], pa.int64()), "b": pa.array([node[j] for _, j in links], pa.int64())})

    links = meeting.select("node", "own", "x", "y", "component", "bands", "keys", "weights").groupBy("component", "x", "y").applyInArrow(verify, "a long, b long")
    members = sketches.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest")
    links = links.unionByName(components.same_id_links(members, "doc_id"))
    classes = components.components(links).select("node", F.col("component").alias("found"))
    named = nodes.select("digest", "node").join(classes, "node", "left").select("digest", F.coalesce("found", "node").alias("class_id"))
    placed = sketches.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")
    return placed.withColumn("kept", F.col("doc_id") == F.col("class_id")).unionByName(rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def keep(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id, with the columns the documents came with.

    Of rows with that id the one with the smallest text stays (a null text first).
    """
    kept = near_duplicates(docs, similarity, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.asc_nulls_first(text_col)))
    known = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").withColumn("_place", place).where("_place = 1")
    return known.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
