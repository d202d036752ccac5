"""Removal of repeated windows against brute force over all windows."""
import hashlib
import random
import re

import numpy as np
import pytest

from deltascope.llm import recompression


def brute(rows, window=13):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    first = {}
    for (doc, _), words in zip(rows, texts):
        for k in range(len(words) - window + 1 if doc is not None else 0):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), words in zip(rows, texts):
        gone = [False] * len(words)
        for k in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[k : k + window])] < doc:
                gone[k : k + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((str(doc), len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def found(frame, **options):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in recompression.without_repeats(frame, **options).collect())


def mixed_rows(seed, kinds):
    """Texts of `kinds` words, glued from shared passages, runs of one word, and noise; repeated and missing ids, null texts."""
    rng = random.Random(seed)
    pool = [[rng.randrange(kinds) for _ in range(size)] for size in (15, 40, 300, 300)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            passage = rng.choice(pool)
            start = rng.randrange(len(passage))
            words += passage[start : start + rng.choice([5, 13, 14, 30, 300])]
            words += [rng.randrange(kinds) for _ in range(rng.randrange(4))]
            if rng.random() < 0.2:
                words += [rng.randrange(kinds)] * rng.randrange(30)
        rows.append((rng.choice([None, doc, doc, doc, 3]), rng.choice([" ", "\n", "   "]).join(f"w{x}" for x in words) if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed, kinds, bits", [(0, 1, 20), (1, 2, 15), (2, 3, 20), (3, 8, 15), (4, 40, 20), (5, 400, 20)])
def test_removed_words(spark, seed, kinds, bits):
    rows = mixed_rows(seed, kinds)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=bits) == brute(rows)


def test_copies_long_texts_and_clashing_names(spark):
    rng = random.Random(9)
    base = " ".join(f"t{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(7, base), (8, base), (5, "x " + base[:4000]), (9, "Ünïcode " * 40), (10, "ünïcode " * 40), (11, "Ünïcode " * 12), (12, "")]
    frame = spark.createDataFrame([(d, t, 1, "a", 2) for d, t in rows], "doc_id long, text string, place int, first string, low int")
    assert found(frame) == brute(rows)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert found(frame) == []
    assert found(spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string")) == brute([(1, None), (None, "a b")])


def test_equal_words_have_equal_symbols():
    """Wherever the words that fix a pair stand, the parse has that pair."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 6, 200)
    codes = np.concatenate([rng.integers(0, 6, 50), passage, rng.integers(0, 6, 31), passage, rng.integers(0, 6, 9)])
    parse = recompression.Parse(recompression.words.mix(codes.astype(np.uint64) + np.uint64(1)), np.array([0, 260, len(codes)]), small=(1, 2, 3))
    for low, high in parse.small:
        spans = set(zip(low.tolist(), high.tolist()))
        for a, b in spans:
            if 50 <= a and b <= 250:
                assert (a + 231, b + 231) in spans
            if 281 <= a and b <= 481:
                assert (a - 231, b - 231) in spans
