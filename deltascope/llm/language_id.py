"""Language identification by a string kernel, Nyström landmarks and ridge regression.

Texts become lower-case letters with one break between words. The blended-spectrum presence kernel of two
texts is the number of different n-grams, n from 1 to GRAMS, that both hold, over the geometric mean of what
each holds; n-grams are those of the landmark texts. Landmarks L turn a text into K(x, L) K(L, L)^(-1/2), on
which one ridge regression per language is fitted; with the kernel this is a single matrix product, so a
batch of texts is scored as presence matrix times landmark matrix times coefficients.
"""
from __future__ import annotations

import functools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deltascope.llm import common

GRAMS = 3
#: Bounds of what is fitted: landmarks and training texts of a language, characters of a training text.
LANDMARKS, TEXTS, TEXT_CHARS = 48, 400, 1 << 13
#: Landmarks and training texts of all languages together; with more languages each has fewer, at least one.
MOST_LANDMARKS, MOST_TEXTS = 3072, 25_600
RIDGE = 0.1
UNKNOWN = "und"
_TABLE_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case form of each code point that is a letter, 0 for all others."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts with one 0 between words and around texts, the text of each, and how many letters each text has."""
    values, offsets = common.text_bytes(column)
    codes = np.frombuffer(values.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    places = np.concatenate([[0], np.cumsum((values & 0xC0) != 0x80)])[offsets]
    marks = np.zeros(len(codes) + 2 * len(column), np.uint32)  # a break before and after each text
    at = np.arange(len(codes)) + np.repeat(2 * np.arange(len(column)) + 1, np.diff(places))
    marks[at] = _letters()[codes]
    text_of = np.repeat(np.arange(len(column)), np.diff(places) + 2)
    kept = marks > 0
    counts = np.bincount(text_of[kept], minlength=len(column))
    kept[1:] |= marks[:-1] > 0  # the break after a word
    kept[np.searchsorted(text_of, np.arange(len(column)))] = True  # and the one before the text
    return marks[kept], text_of[kept], counts


def grams(marks: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and text of each n-gram within a text; single breaks are left out."""
    if len(marks) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(len(marks) - n + 1, np.uint64)
    for k in range(n):
        code = (code << np.uint64(21)) | marks[k : len(marks) - n + 1 + k].astype(np.uint64)
    inside = text_of[: len(code)] == text_of[n - 1 :]
    if n == 1:
        inside &= marks > 0
    return code[inside], text_of[: len(code)][inside]


def _slots(code: np.ndarray, n: int) -> np.ndarray:
    x = (code ^ np.uint64(n * 0xD6E8FEB86659FD93 % 2**64)) * _SPREAD  # n-grams of different length have equal codes
    return ((x ^ (x >> np.uint64(32))) * _SPREAD) >> np.uint64(64 - _TABLE_BITS)


@dataclass
class Classifier:
    languages: list[str]
    codes: list[np.ndarray]  # for each n, the n-gram codes, by number
    slots: np.ndarray  # number of the n-gram in each slot, or the count of n-grams
    crowded: list[int]  # for each n, how many of the n-grams, the last ones and sorted, found their slot taken
    landmarks: np.ndarray  # (n-grams, landmarks): presence over the root of what the landmark holds
    coefficients: np.ndarray  # (landmarks, languages)

    def presence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams each text holds, and its letters."""
        marks, text_of, counts = letters(column)
        known = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint64)
        size = len(known)
        out = np.zeros((len(column), size + 1), np.float32)
        flat, low = out.reshape(-1), 0
        for n, own in enumerate(self.codes, 1):
            code, text = grams(marks, text_of, n)
            number = self.slots[_slots(code, n)]
            hit = (number >= low) & (number < low + len(own))
            hit[hit] = known[number[hit]] == code[hit]
            flat[text[hit] * (size + 1) + number[hit]] = 1
            rest = own[len(own) - self.crowded[n - 1] :]
            if len(rest):
                code, text = code[~hit], text[~hit]
                place = np.minimum(np.searchsorted(rest, code), len(rest) - 1)
                hit = rest[place] == code
                flat[text[hit] * (size + 1) + low + len(own) - len(rest) + place[hit]] = 1
            low += len(own)
        return out[:, :size], counts

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Regression value of each text and language, and the texts' letters."""
        held, counts = self.presence(column)
        norm = np.sqrt(np.maximum(held.sum(axis=1), 1))
        return (held @ self.landmarks / norm[:, None]) @ self.coefficients, counts


def train(texts: list[str], langs: list[str]) -> Classifier:
    """A classifier from texts in the order in which landmarks are taken: the first LANDMARKS of each language."""
    languages = sorted(set(langs))
    if not languages:
        return Classifier([], [], np.zeros(1 << _TABLE_BITS, np.int32), [], np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    most = max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages)))
    chosen = [k for lang in languages for k in [i for i, x in enumerate(langs) if x == lang][:most]]
    marks, text_of, _ = letters(pa.array([texts[k] for k in chosen]))
    slots, codes, crowded, low = np.full(1 << _TABLE_BITS, -1, np.int64), [], [], 0
    for n in range(1, GRAMS + 1):
        own = np.unique(grams(marks, text_of, n)[0])
        place = _slots(own, n)
        _, first = np.unique(place, return_index=True)
        alone = np.zeros(len(own), bool)  # a slot belongs to one n-gram; the others are looked up by their order
        alone[first[slots[place[first]] < 0]] = True
        slots[place[alone]] = low + np.arange(alone.sum())
        codes.append(np.concatenate([own[alone], own[~alone]]))
        crowded.append(int((~alone).sum()))
        low += len(own)
    size = low
    model = Classifier(languages, codes, np.where(slots < 0, size, slots).astype(np.int32), crowded, np.zeros((size, 0), np.float32), np.zeros((0, 0)))
    held = np.concatenate([model.presence(pa.array(texts[i : i + 256]))[0] for i in range(0, len(texts), 256)])
    unit = held / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
    model.landmarks = np.ascontiguousarray(unit[chosen].T)
    inner = (unit[chosen] @ model.landmarks).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    root = vector * np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)
    phi = (unit @ model.landmarks).astype(np.float64) @ root
    target = (np.array(langs)[:, None] == np.array(languages)).astype(np.float64)
    share = target.mean(axis=0)
    weight = (1 / np.maximum(share, 1e-9))[[languages.index(x) for x in langs]]  # languages count alike
    gram = (phi * weight[:, None]).T @ phi
    solved = np.linalg.solve(gram + RIDGE * len(languages) * np.eye(len(gram)), (phi * weight[:, None]).T @ target)
    model.coefficients = (root @ solved).astype(np.float32)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """A classifier from a bounded sample of the documents whose language is not null.

    Each language gives up to TEXTS texts, by hash of id and text, of which the first TEXT_CHARS characters are read.
    With more than MOST_TEXTS / TEXTS languages each gives fewer. All are learned; only beyond MOST_LANDMARKS of them
    the rarest (ties by name) are not, and the warning names their number.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return train([], [])
    if languages > MOST_LANDMARKS:
        warnings.warn(f"{languages - MOST_LANDMARKS} of {languages} languages are not learned")
        rows = rows.join(counts.orderBy(F.desc("count"), "lang").limit(MOST_LANDMARKS).select("lang"), "lang", "left_semi")
    each = max(1, min(TEXTS, MOST_TEXTS // languages))
    cut = rows.select("lang", F.substring("text", 1, TEXT_CHARS).alias("text"), F.xxhash64("doc_id", "text").alias("order"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    sample = cut.withColumn("place", place).where(F.col("place") <= each).orderBy("lang", "place").select("lang", "text").collect()
    return train([r.text for r in sample], [r.lang for r in sample])


def with_language(docs: DataFrame, model: Classifier, text_col: str = "text", name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns, the language of each whole text and a score from 0 to 1. Columns of these names are replaced.

    `und` with score 0 where the text is null or has no letter, or no language was learned.
    """
    kept = common.small_batches(docs).drop(name, score_name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in common.pieces(batch, text_col):
                found, counts = model.scores(piece.column(text_col).cast(pa.string()).fill_null(""))
                if not model.languages:
                    best, score = [UNKNOWN] * len(counts), np.zeros(len(counts))
                else:
                    top = found.argmax(axis=1)
                    best = [model.languages[k] if c else UNKNOWN for k, c in zip(top, counts)]
                    score = np.where(counts > 0, np.clip(found[np.arange(len(top)), top], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(best, pa.string()), pa.array(score)], names=[*piece.schema.names, name, score_name])

    return kept.mapInArrow(predict, common.extended(kept, **{name: "string", score_name: "double"}))
