"""Collocations against counts of all stretches of words."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deltascope.llm import collocations


def brute(rows, at_least, most):
    totals, times = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    times[lang, tuple(words[k : k + size])] += 1
    frequent = {k: v for k, v in times.items() if v >= at_least and len(k[1]) > 1}
    out = {}
    for (lang, phrase), a in frequent.items():
        inside = lambda longer: any(longer[k : k + len(phrase)] == phrase for k in range(len(longer) - len(phrase) + 1))
        if any(code == lang and len(p) > len(phrase) and inside(p) and v >= a for (code, p), v in frequent.items()):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            l, r = times[lang, phrase[:k]], times[lang, phrase[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    result = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:most], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(result)


def found(frame, at_least, most):
    return sorted(tuple(r) for r in collocations.collocations(frame, at_least, most).collect())


def sentences(seed, kinds, count=120):
    rng = random.Random(seed)
    names = ["The", "of", "ÄÖ", "ä", "x-y", "Café", "1", "'s", "a b", "no break", *(f"w{k}" for k in range(kinds))]
    frames = [[rng.choice(names) for _ in range(rng.choice([2, 3, 5, 9, 20]))] for _ in range(8)]
    rows = []
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(frames) if rng.random() < 0.6 else [rng.choice(names)]
            words.append(rng.choice(["", "", ".", ", ", "!?", "\n", "\t", "\x0c", " ; "]))
        rows.append((rng.choice([" ", "  ", "\t"]).join(words) if rng.random() < 0.95 else None, rng.choice(["en", "en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("seed, kinds, at_least, most", [(0, 3, 2, 2000), (1, 10, 3, 25), (2, 40, 4, 2000), (3, 1, 30, 10)])
def test_ranked_phrases(spark, seed, kinds, at_least, most):
    rows = sentences(seed, kinds)
    assert found(spark.createDataFrame(rows, "text string, lang string").repartition(3), at_least, most) == brute(rows, at_least, most)


def test_repeats_long_texts_and_clashing_names(spark):
    rng = random.Random(4)
    passage = " ".join(f"t{rng.randrange(300)}" for _ in range(700))
    rows = [(passage, "en"), (passage, "en"), (passage + " " + passage, "en"), ("a a a a a a a a a a", "xx"), ("A a. a a a", "xx"), ("", "en"), (None, None)]
    frame = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "text string, lang string, times int, phrase string, kind int")
    assert found(frame, 2, 2000) == brute(rows, 2, 2000)


def test_many_of_one_phrase(spark):
    rows = [("new york times", None)] * 600 + [("old york", None)] * 300 + [("new day", None)] * 400
    assert found(spark.createDataFrame(rows, "text string, lang string"), 100, 5) == brute(rows, 100, 5)
    assert found(spark.createDataFrame(rows, "text string, lang string"), 350, 5) == brute(rows, 350, 5)


def test_no_rows(spark):
    assert found(spark.createDataFrame([], "text string, lang string"), 2, 5) == []


def test_exact_products(spark):
    """Scores beyond 64 bits in their products."""
    big = 3_000_000_000_037
    table = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 11), ("en", "b", 1, big + 7)], "lang string, phrase string, size int, times long")
    row = collocations.scored(table, spark.createDataFrame([("en", 10**13 + 9)], "lang string, n long")).first()
    assert row.score == 1000 * big * (10**13 + 9) // ((big + 11) * (big + 7))


def test_paths_hold_every_edge_once():
    """Weights of the edges on all paths are the counts of the phrases of five words."""
    rng = np.random.default_rng(8)
    codes = np.concatenate([np.tile(rng.integers(0, 50, 400), 3), rng.integers(0, 3, 300), rng.integers(0, 200, 300)]).astype(np.int64)
    linked = rng.random(len(codes)) > 0.02
    linked[0] = False
    graph = collocations.Graph(codes, linked, np.zeros(len(codes), np.int64))
    want, begin = Counter(), 0
    for end in [*np.flatnonzero(~linked)[1:], len(codes)]:
        want.update(tuple(codes[k : k + 5].tolist()) for k in range(begin, end - 4))
        begin = end
    have = Counter()
    for start, stop, weight in zip(*graph.paths()):
        assert stop - start <= collocations.PATH_WORDS
        for k in range(start, stop - 4):
            have[tuple(codes[k : k + 5].tolist())] += int(weight)
    assert have == want
    assert len(graph.paths()[0]) < len(want) / 2


def test_a_shared_slot_makes_no_phrase_frequent(spark):
    """A key that shares its slot in one table with a frequent one has another in the next."""
    key = np.uint64(0x123456789ABCDEF0)
    frame = spark.createDataFrame([("a a a", "en")] * 40, "text string, lang string")
    bits = collocations.frequent_slots(frame, lambda pieces, keys: np.full(len(keys), key), 100)
    near = np.array([key, key ^ np.uint64(1 << 30), key ^ np.uint64(1 << 60)], np.uint64)
    assert collocations._set(bits, near).tolist() == [True, False, False]


def test_a_task_hands_on_a_phrase_once():
    """However many rows are added up, as long as few are left of them."""
    names = pa.array(["en", "de"])
    some = np.random.default_rng(9)
    rows = [collocations._rows(names, some.integers(0, 2, 200_000), 0, pa.array([f"p{k}" for k in some.integers(0, 50, 200_000)]), np.ones(200_000)) for _ in range(12)]
    out = pa.Table.from_batches(collocations._combined(lambda batches: batches)(iter(rows)))
    assert out.num_rows == 100 and sum(out.column("times").to_pylist()) == 12 * 200_000


def test_rows_do_not_grow_with_tasks(spark):
    """The same texts in more partitions make no more rows, and the same result."""
    rows = sentences(6, 5, 400)
    frame = spark.createDataFrame(rows, "text string, lang string")
    most = spark.sparkContext.defaultParallelism
    parts = collocations.graph_rows(frame.repartition(10 * most), 4)
    assert parts.count() <= most * parts.select("lang", "kind", "phrase").distinct().count()
    assert parts.rdd.getNumPartitions() <= most
    assert found(frame.repartition(10 * most), 4, 2000) == brute(rows, 4, 2000)
