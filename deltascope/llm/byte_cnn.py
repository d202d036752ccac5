"""Quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Learned filters slide over each chunk;
of each filter the largest response in a chunk counts, rectified. The mean of these over all chunks goes
through one logistic unit. The network is trained on a bounded sample of labelled documents and scores whole
texts in tasks that read only the text.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltascope.llm import common

CHUNK, OVERLAP = 512, 32
WIDTH, STRIDE, DIMENSIONS, FILTERS = 8, 2, 4, 24
#: Bounds of the training sample: documents of each label, bytes of one of them, and chunks of one of them per pass.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_CHUNKS = 1500, 1 << 16, 24
PASSES, BATCH, RATE, SEED = 12, 64, 0.01, 11
#: From this score on, the label 1 is predicted.
THRESHOLD = 0.3


@dataclass
class Network:
    embedding: np.ndarray  # (257, DIMENSIONS); 256 stands for "after the end"
    filters: np.ndarray  # (WIDTH * DIMENSIONS, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (FILTERS,)
    shift: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.shift]


def fresh_network(seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    embedding = draw(257, DIMENSIONS)
    embedding[256] = 0
    return Network(embedding, draw(WIDTH * DIMENSIONS, FILTERS) / np.float32(np.sqrt(WIDTH * DIMENSIONS)), np.zeros(FILTERS, np.float32), 0.1 * draw(FILTERS), np.zeros(1, np.float32))


def chunk_starts(size: int) -> np.ndarray:
    """Places of the chunks of a text of `size` bytes: one at least, and every byte is in one."""
    return np.arange(0, max(1, size - OVERLAP), CHUNK - OVERLAP)


def chunks_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of chunks as rows of CHUNK numbers; 256 from each text's end on."""
    at = starts[:, None] + np.arange(CHUNK)
    if not len(values):
        return np.full(at.shape, 256, np.int16)
    return np.where(at < ends[:, None], values[np.minimum(at, len(values) - 1)], np.int16(256)).astype(np.int16)


def responses(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter responses (chunk, place, filter), and the windows they came from."""
    embedded = net.embedding[chunks]
    count, places = len(chunks), (CHUNK - WIDTH) // STRIDE + 1
    s = embedded.strides
    windows = np.lib.stride_tricks.as_strided(embedded, (count, places, WIDTH, DIMENSIONS), (s[0], STRIDE * s[1], s[1], s[2]))
    windows = np.ascontiguousarray(windows).reshape(count * places, WIDTH * DIMENSIONS)
    return (windows @ net.filters).reshape(count, places, FILTERS), windows


def pooled(net: Network, chunks: np.ndarray, step: int = 128) -> np.ndarray:
    """Rectified largest response of each filter in each chunk."""
    out = [responses(net, chunks[i : i + step])[0].max(axis=1) for i in range(0, len(chunks), step)]
    return np.maximum(np.concatenate(out) + net.bias, 0) if out else np.zeros((0, FILTERS), np.float32)


def score_texts(net: Network, column: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text."""
    values, offsets = common.text_bytes(column)
    own = [chunk_starts(n) + a for a, n in zip(offsets[:-1].tolist(), np.diff(offsets).tolist())]
    counts = np.array([len(x) for x in own])
    if not len(counts):
        return np.zeros(0)
    starts, ends = np.concatenate(own), np.repeat(offsets[1:], counts)
    sums = np.zeros((len(counts), FILTERS))
    texts = np.repeat(np.arange(len(counts)), counts)
    for i in range(0, len(starts), 1024):
        np.add.at(sums, texts[i : i + 1024], pooled(net, chunks_of(values, starts[i : i + 1024], ends[i : i + 1024])))
    logits = (sums / counts[:, None]) @ net.weights.astype(np.float64) + float(net.shift[0])
    return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def _gradients(net: Network, chunks: np.ndarray, text_of: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
    """Mean gradient of the logistic loss over some texts."""
    raw, windows = responses(net, chunks)
    places = raw.shape[1]
    best = raw.argmax(axis=1)
    top = np.take_along_axis(raw, best[:, None], axis=1)[:, 0] + net.bias
    active = top > 0
    counts = np.bincount(text_of, minlength=len(marks))
    means = np.zeros((len(marks), FILTERS))
    np.add.at(means, text_of, np.where(active, top, 0) / counts[text_of][:, None])
    error = (1 / (1 + np.exp(-np.clip(means @ net.weights + net.shift, -50, 50))) - marks) / len(marks)
    back = (error / counts)[text_of][:, None] * net.weights * active
    where = best + (np.arange(len(chunks)) * places)[:, None]
    filters, embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    for f in range(FILTERS):
        filters[:, f] = windows[where[:, f]].T @ back[:, f]
        rows = np.take_along_axis(chunks, best[:, [f]] * STRIDE + np.arange(WIDTH), axis=1)
        np.add.at(embedding, rows, back[:, f][:, None, None] * net.filters[:, f].reshape(WIDTH, DIMENSIONS))
    embedding[256] = 0
    return [embedding, filters, back.sum(axis=0), error @ means, np.array([error.sum()])]


def train(texts: list[str], marks: list[int], share: float, passes: int = PASSES, seed: int = SEED) -> Network:
    """A network from a sample that holds both labels. share: how often label 1 occurs where the sample was drawn from."""
    net = fresh_network(seed)
    y = np.array(marks, float)
    if not 0 < share < 1 or len(set(marks)) < 2:
        known = share if 0 < share < 1 else (1.0 if share >= 1 else 0.0)
        net.weights[:] = 0
        net.shift[:] = np.log(max(known, 1e-3) / max(1 - known, 1e-3))
        return net
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    first = [np.zeros(p.shape) for p in net.parts()]
    second = [np.zeros(p.shape) for p in net.parts()]
    step = 0
    for done in range(passes):
        rate = RATE * (1 - done / passes)
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            rows, text_of = [], []
            for k, d in enumerate(batch):
                starts = chunk_starts(len(data[d]))
                if len(starts) > SAMPLE_CHUNKS:
                    starts = rng.choice(starts, SAMPLE_CHUNKS, replace=False)
                rows.append(chunks_of(data[d], starts, np.full(len(starts), len(data[d]))))
                text_of += [k] * len(starts)
            step += 1
            for p, g, m, v in zip(net.parts(), _gradients(net, np.concatenate(rows), np.array(text_of), y[batch]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    sampled = y.mean()
    net.shift += np.float32(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))  # the sample holds the labels in other shares
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network for the labels 0 and 1 of the documents that `labels` holds.

    The sample has up to SAMPLE_DOCS documents of each label, those with the smallest hashes of the id among
    the documents of at most SAMPLE_BYTES bytes. Contradicting labels are left out; without both labels every
    score is the share of label 1 (a half if there are none).
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("mark")).where("mark in (0, 1) and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("other")).where("mark = other").drop("other")
    short = common.whole_text(docs, id_col, text_col).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = short.select("doc_id").join(marks, "doc_id")
    counts = dict(rows.groupBy("mark").count().collect())
    drawn = [r for m in (0, 1) for r in common.hash_sample(rows.where(F.col("mark") == m), F.xxhash64("doc_id"), SAMPLE_DOCS, counts.get(m, 0)).collect()]
    if not drawn:
        return train([], [], 0.5)
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in drawn], rows.schema).distinct()
    sample = short.join(F.broadcast(chosen), "doc_id").collect()  # at most 2 * SAMPLE_DOCS ids
    sample.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in sample], [r.mark for r in sample], counts.get(1, 0) / sum(counts.values()))


def with_score(docs: DataFrame, net: Network, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns and the score (0 to 1) of each whole text; null and empty texts get that of one empty chunk. A column called `name` is replaced."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, text_col):
                found = score_texts(net, piece.column(text_col).cast(pa.string()).fill_null(""))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found)], names=[*piece.schema.names, name])

    kept = common.small_batches(docs).drop(name)
    return kept.mapInArrow(score, common.extended(kept, **{name: "double"}))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least `threshold`, with the columns they came with."""
    name = "quality score"
    return with_score(docs, fit(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= threshold).select(*docs.columns)
