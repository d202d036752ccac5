"""The language model: counts and base against brute force, probabilities that add up, gradients, learning."""
import math
import random
import re
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deltascope.llm import maxent_lm, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_list(text):
    return [*(text or "").translate(LOWER).encode().split(), None]


def corpus():
    rng = random.Random(3)
    nouns, verbs = ["cat", "dog", "bird", "Fish"], ["sees", "hears", "likes"]
    line = lambda: " ".join(x for _ in range(rng.randint(1, 25)) for x in (rng.choice(["the", "a"]), rng.choice(nouns), rng.choice(verbs)))
    rows = [(k, line() + " rare" + str(k % 37), k % 5 == 1, "n") for k in range(300)]
    rows += [(900, None, False, "n"), (901, "", True, "n"), (902, "É É\x1f Ä the", True, "n"), (None, "the cat", True, "n"), (3, rows[3][1], rows[3][2], "n"), (903, "the dog sees " * 9000, True, "n")]
    return rows


@pytest.mark.parametrize("head", [maxent_lm.HEAD, 6])
def test_scores(spark, head):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, score string")
    found = maxent_lm.learn_and_score(frame, head=head).collect()
    counts = Counter(t for r in rows if not r[2] for t in token_list(r[1]))
    total, types = sum(counts.values()), len(counts)
    below = math.log10(total + 0.5 * (types + 1))
    want = sorted((str(i), h, len(t := token_list(text)), sum(counts[x] > 0 for x in t), total, round(sum(math.log10(counts[x] + 0.5) - below for x in t), 5)) for i, text, h, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
    assert all(r.score < 0 for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * (0.8 if head > 6 else 0.97)


def test_without_training_texts(spark):
    frame = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    found = {r.doc_id: r for r in maxent_lm.learn_and_score(frame).collect()}
    assert [(found[k].n_tokens, found[k].n_known, found[k].train_tokens, found[k].base_score) for k in (1, 2)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in found.values())
    assert maxent_lm.learn_and_score(frame.limit(0)).count() == 0


def test_probabilities_add_up(spark):
    frame = spark.createDataFrame([(r[1],) for r in corpus() if r[1]], "text string")
    counts = maxent_lm.count_tokens(frame)
    vocab = maxent_lm.vocabulary(counts, 40)
    weights = maxent_lm.train(frame, vocab)
    rng = np.random.default_rng(0)
    types = [(r.hash, r.ending, r.c) for r in counts.collect()]
    hashes, endings = np.array([t[0] for t in types]).view(np.uint64), np.array([t[1] for t in types])
    cells = vocab.look_up(hashes, endings)[0]
    parts = (np.array([t[2] for t in types]) + 0.5) / vocab.masses[cells]
    for context in rng.choice(cells, (5, 3)):
        bounds = np.array([0, 4])
        hashed = maxent_lm.features(np.append(context, 0), bounds)[:, 3:]
        every = np.tile(hashed, len(types) + 1)
        p = 10 ** maxent_lm.log_probabilities(weights, every, np.append(cells, vocab.unknown))
        assert 0.98 < p[-1] + (p[:-1] * parts).sum() < 1 + 1e-6


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(1)
    weights = maxent_lm.Weights(np.zeros((1, maxent_lm.CLASSES), np.float32), np.zeros((maxent_lm.CLASSES, maxent_lm.SLOTS), np.float32), np.zeros((maxent_lm.CLASS_ROWS, maxent_lm.CLASSES), np.float32), np.zeros((maxent_lm.SLOT_ROWS, maxent_lm.SLOTS), np.float32))
    cells = np.zeros(4000, np.int64)
    for k in range(1, 4000):
        cells[k] = (cells[k - 1] * 7 + rng.integers(1, 3)) % 900
    hashed = maxent_lm.features(cells, np.array([0, 2500, 4000]))
    learner = maxent_lm.Learner(weights)
    losses = []
    for _ in range(6):
        losses.append(-maxent_lm.log_probabilities(learner.weights, hashed, cells).mean())
        learner.learn(hashed, cells)
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.9 * losses[0]


def test_features_do_not_cross_texts():
    hashed = maxent_lm.features(np.array([5, 6, 7, 5, 6]), np.array([0, 3, 3, 5]))
    assert (hashed[:, 0] == hashed[:, 3]).all() and (hashed[:, 1] == hashed[:, 4]).all()
    assert len(np.unique(hashed[:, 2])) == maxent_lm.FEATURES


def test_tokens_are_words_and_an_end():
    texts = ["The the", "", "É é \x1f", "a\tb\nA"]
    hashes, _, at, bounds = maxent_lm.tokens(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(token_list(t)) for t in texts]
    names = [t for text in texts for t in token_list(text)]
    assert len(set(hashes[at].tolist())) == len(set(names))
    assert {(n, h) for n, h in zip(names, hashes[at].tolist())}.__len__() == len(set(names))


def test_unseen_words_keep_their_share_at_every_head(spark):
    """Words that occur once stand for the unknown one inside the head and outside, few for many if need be."""
    rng = random.Random(5)
    line = lambda k: " ".join(f"w{rng.randint(0, 40)}" if rng.random() < 0.8 else f"once{k}x{i}" for i in range(30))
    rows = [(k, line(k), k % 5 == 1) for k in range(400)]
    frame = spark.createDataFrame([(t,) for _, t, h in rows if not h], "text string")
    counts = maxent_lm.count_tokens(frame).cache()
    once = sum(n == 1 for n in Counter(t for _, text, h in rows if not h for t in token_list(text)).values())
    unseen = {}
    for head, most in ((maxent_lm.HEAD, maxent_lm.STAND_INS), (6, maxent_lm.STAND_INS), (maxent_lm.HEAD, 100)):
        vocab = maxent_lm.vocabulary(counts, head, most)
        assert abs(len(vocab.stand_ins) * vocab.stands_for - once / maxent_lm.PRETEND) < 0.35 * once / maxent_lm.PRETEND
        assert vocab.masses[vocab.unknown] == len(vocab.stand_ins) * vocab.stands_for
        weights = maxent_lm.train(frame, vocab)
        total = 0.0
        for _, text, held in rows:
            if held:
                hashes, endings, at, bounds = maxent_lm.tokens(pa.array([text]))
                hashed = maxent_lm.features(hashes[at], bounds)
                new = np.array([t is not None and t.startswith(b"once") for t in token_list(text)])
                total += maxent_lm.log_probabilities(weights, hashed[:, new], np.full(new.sum(), vocab.unknown)).sum() / 80
        unseen[head, most] = total
    # A fifth of the tokens are unseen and a quarter of those seen once stand for them: 6 a text at about a twentieth
    # each, and less because few texts teach each context little. The head must not matter.
    fair = 6 * math.log10(1 / 20)
    assert all(1.6 * fair < x < 0.7 * fair for x in unseen.values()), unseen
    inside, outside, _ = unseen.values()
    assert abs(inside - outside) < 0.1 * abs(fair)


def test_rare_words_are_evidence_of_their_own(spark):
    """Two words without a cell of their own and with the same ending are followed by different words."""
    rng = random.Random(7)
    fill = [f"f{k}" for k in range(900)] * 20
    rng.shuffle(fill)
    lines = []
    for k in range(300):
        part = fill[k * 60 : k * 60 + 60]
        seldom = k % 25 == 0
        lines.append(" ".join([*part[:30], *["aqzz"] * seldom, "left", *part[30:], *["bqzz"] * seldom, "right"]))
    frame = spark.createDataFrame([(x,) for x in lines], "text string").repartition(1)
    vocab = maxent_lm.vocabulary(maxent_lm.count_tokens(frame))
    weights = maxent_lm.train(frame, vocab, 1)
    probabilities = {}
    for text in ("aqzz left", "aqzz right", "bqzz left", "bqzz right"):
        hashes, endings, at, bounds = maxent_lm.tokens(pa.array([text]))
        cells = vocab.look_up(hashes, endings)[0][at]
        probabilities[text] = maxent_lm.log_probabilities(weights, maxent_lm.features(hashes[at], bounds), cells)[1]
        assert cells[0] in vocab.shared
    assert probabilities["aqzz left"] - probabilities["aqzz right"] > probabilities["bqzz left"] - probabilities["bqzz right"] + 0.1


def test_rows_and_classes_follow_the_training_data():
    def shapes(total, types):
        side = maxent_lm.side_for(types)
        none = np.zeros(0, np.uint64)
        vocab = maxent_lm.Vocabulary(none, none, none, none, 0, none, 1, np.ones(side * side), total, types)
        return [p.shape for p in maxent_lm.fresh_weights(vocab).parts()]

    assert shapes(1000, 50) == [(1, 32), (32, 32), (1 << 14, 32), (1 << 15, 32)]
    assert shapes(1 << 25, 300_000) == [(1, 64), (64, 64), (1 << 15, 64), (1 << 16, 64)]
    assert shapes(1 << 40, 1 << 30) == [(1, 64), (64, 64), (1 << 16, 64), (1 << 17, 64)]


@pytest.mark.parametrize("places, rows", [(1, 5), (3000, 70_000), (500, 30), (200, 1)])
def test_sums_by_row(places, rows):
    """Rows that occur once, a few times, and more often than FEW."""
    some = np.random.default_rng(places)
    gradient, at = some.normal(size=(places, 32)).astype(np.float32), some.integers(0, rows, (4, places))
    total, row, times = maxent_lm.sums_by_row(at.ravel(), gradient)
    want = np.zeros((rows, 32))
    np.add.at(want, at.ravel(), np.tile(gradient, (4, 1)))
    assert len(set(row)) == len(row) and (np.bincount(at.ravel(), minlength=rows)[row] == times).all() and times.sum() == at.size
    assert np.allclose(total, want[row], atol=1e-3)


def test_second_cell_of_a_place():
    """The probability of another cell at some places is what it would be if it were looked up there alone."""
    some = np.random.default_rng(7)
    shapes = [(1, 32), (32, 32), (64, 32), (128, 32)]
    weights = maxent_lm.Weights(*[some.normal(size=shape).astype(np.float32) for shape in shapes])
    hashed, cells = some.integers(0, 1 << 62, (4, 500)).astype(np.uint64), some.integers(0, 1024, 500)
    places = np.flatnonzero(some.random(500) < 0.3)
    own, other = maxent_lm.log_probabilities_of_two(weights, hashed, cells, places, 77, step=64)
    assert np.allclose(own, maxent_lm.log_probabilities(weights, hashed, cells))
    assert np.allclose(other, maxent_lm.log_probabilities(weights, hashed[:, places], np.full(len(places), 77)))


def test_softmax_of_small_and_large_sums():
    """Rows are shifted where the power of e would leave the range of a float, and give the same as they are."""
    some = np.random.default_rng(11)
    for scale in (1, 30, 1000):
        x = (some.normal(size=(50, 32)) * scale).astype(np.float32)
        x[:2] -= 3 * scale
        wide = x.astype(np.float64)
        want = np.exp(wide - wide.max(axis=1, keepdims=True))
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(maxent_lm._softmax(x.copy()), want, atol=1e-5)
        at = (np.arange(50), want.argmax(axis=1))
        assert np.allclose(maxent_lm._log_softmax_at(x.copy(), at)[0], np.log(want[at]), atol=1e-5)


def test_learning_takes_little_room():
    """A batch is worked on in steps, in room that is used again, not in large arrays made anew."""
    some, side = np.random.default_rng(12), 64
    weights = maxent_lm.Weights(*[np.zeros(shape, np.float32) for shape in ((1, side), (side, side), (1 << 16, side), (1 << 17, side))])
    hashed, cells = some.integers(0, 1 << 62, (4, maxent_lm.BATCH)).astype(np.uint64), some.integers(0, side * side, maxent_lm.BATCH)
    learner = maxent_lm.Learner(weights)
    tracemalloc.start()
    learner.learn(hashed, cells)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * maxent_lm.BATCH * side * 4


def test_rows_that_occur_some_dozens_of_times_are_added_up_together():
    """The number of calls follows how often rows occur, not how many rows there are."""
    some = np.random.default_rng(13)
    gradient, rows = some.normal(size=(30_000, 8)).astype(np.float32), some.permutation(np.arange(120_000) % 3000)
    calls = 0

    def count(frame, event, argument):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        for _ in maxent_lm.sums_of_rows(rows, gradient):
            pass
    finally:
        sys.setprofile(None)
    assert calls < 1000
    total, row, times = maxent_lm.sums_by_row(rows, gradient)
    want = np.zeros((3000, 8))
    np.add.at(want, rows, np.tile(gradient, (4, 1)))
    assert (np.sort(row) == np.arange(3000)).all() and (times == 40).all() and np.allclose(total, want[row], atol=1e-3)


def test_words_of_odd_texts():
    some = random.Random(14)
    texts = ["", "".join(some.choices(" \t\n\x0b\x0c\r\x08\x0e\x1f@AZ[az`{\x00\u00c9\u00a0\u4e2d", k=2000)), " ", "B", "", "\t", "a\nZ ", " q"]
    for column in (pa.array(texts), pa.array(texts).slice(2)):
        for lower in (False, True):
            codes, distinct, places = words.split(column, lower)
            want = [re.findall("[^\x20\x09-\x0D]+", t.translate(LOWER) if lower else t) for t in column.to_pylist()]
            assert [[distinct[k].as_py() for k in codes[a:b]] for a, b in zip(places, places[1:])] == want
