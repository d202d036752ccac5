"""Joins and near duplicates against brute force over all pairs."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from deltascope.llm import components, grid_join, minhash


def closed(nodes, links):
    """Smallest node that each node reaches."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7), (1, 0), (1, 0)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == closed(nodes, links)
    assert components.components(spark.createDataFrame(links, "a long, b long").limit(0)).count() == 0


def brute_vectors(rows, cosine):
    """Links by cosine of every pair of rows with equal labels."""
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    unit = {k: np.array(rows[k][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[k][1], np.float32).astype(float)) for k in good}
    links, counts = [], Counter()
    for x, a in enumerate(good):
        for b in good[x + 1 :]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links.append((rows[a][0], rows[b][0]))
                counts[a] += 1
                counts[b] += 1
    reach = closed({r[0] for r in rows if r[0] is not None}, links)
    return sorted((str(r[0]), counts[k], str(reach.get(r[0])), str(None if r[0] is None else reach[r[0]] == r[0])) for k, r in enumerate(rows))


def vector_rows():
    rng = np.random.default_rng(5)
    rows, number = [], 0
    for label in (0, 1, 2):
        for _ in range(6):
            center = rng.normal(size=12)
            for _ in range(rng.integers(1, 25)):
                rows.append((number, (center + rng.normal(size=12) * rng.choice([0.02, 0.15, 0.4])).astype(np.float32).tolist(), label))
                number += 1
    hot = rng.normal(size=12).astype(np.float32).tolist()
    rows += [(number + k, hot, 1) for k in range(60)]
    number += 60
    rows += [(number, [2 * x for x in hot], 1), (number + 1, hot, None), (number + 2, None, 1), (number + 3, [0.0] * 12, 1), (number + 4, [float("nan"), *hot[1:]], 1), (number + 5, [None, *hot[1:]], 1)]
    rows += [(number + 6, [float("inf"), *hot[1:]], 1), (number + 7, [], 1), (number + 8, hot[:5], 1), (number + 9, hot[:5], 1), (None, hot, 1), (number + 10, [1e-30 * x for x in hot], 1), (number + 11, [-0.0, 1.0], 2)]
    return rows


def test_grid_join(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, raw string, width int")
    for block in (8, 1024):
        found = grid_join.similar_vectors(frame, block=block).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), str(r.kept)) for r in found) == brute_vectors(rows, grid_join.COSINE)
    assert grid_join.similar_vectors(frame.limit(0)).count() == 0
    alone = grid_join.similar_vectors(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1e-9], "a")], "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(map(tuple, alone)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_balls_prove_links_only_where_all_link():
    rng = np.random.default_rng(1)
    for spread in (1e-3, 0.05, 0.2):
        for _ in range(30):
            a = np.ones(8) + rng.normal(size=(20, 8)) * spread
            b = np.ones(8) + rng.normal(size=(20, 8)) * spread
            a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
            assert not grid_join.all_linked(a, b, 0.93) or (a @ b.T >= 0.93).all()


def near_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(14):
        base = [word() for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    shared = " ".join(word() for _ in range(55))
    texts += [" ".join(word() for _ in range(60)) + " " + shared for _ in range(10)]
    return texts + ["", " ", "\n", "one two", "one  two", "one two three", "zz " * 4000, "zz " * 4001]


def brute_classes(rows):
    """Links between all rows whose texts are equal or have a weighted Jaccard similarity of 0.8, with weights by definition."""
    known = [(i, t or "") for i, t in rows if i is not None]
    vectors = []
    for _, text in rows:
        w = (text or "").encode().split()
        vectors.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    share = Counter(s for v in vectors[: len(rows)] for s in v)
    total = len(rows)
    weight = lambda v: {s: n * (1 + minhash.IDF_SHARE * np.log10(1 / max(share[s] / total, minhash.RARE))) for s, n in v.items()}
    held = [(i, t, weight(v)) for (i, t), v in zip([(i, t or "") for i, t in rows], vectors) if i is not None]
    links = []
    for x, (a, s, v) in enumerate(held):
        for b, t, w in held[x + 1 :]:
            common = sum(min(v[k], w[k]) for k in v.keys() & w.keys())
            if s == t or (common and common >= minhash.SIMILARITY * (sum(v.values()) + sum(w.values()) - common)):
                links.append((a, b))
    return closed({i for i, _ in known}, links)


def test_near_duplicates(spark, monkeypatch):
    rows = list(enumerate(near_texts()))
    random.Random(1).shuffle(rows)
    rows += [(1000, None), (1001, rows[0][1]), (rows[3][0], rows[3][1]), (None, rows[0][1])]
    frame = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, class_id string, node int")
    want = brute_classes(rows)
    found = minhash.near_duplicates(frame).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _ in rows)
    assert {r.doc_id: r.class_id for r in found} == want | {None: None}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in found)
    kept = minhash.keep(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [*set(want.values()), None]))
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 60)  # chains in many blocks
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(frame).collect()} == want | {None: None}
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    """Over many samples the share that two texts have in common estimates their weighted Jaccard similarity."""
    rng = np.random.default_rng(2)
    estimates = []
    for _ in range(30):
        keys = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = np.sort(keys[:150]), np.sort(keys[40:])
        weights = dict(zip(keys.tolist(), rng.integers(1, 4, 200).tolist()))
        wa, wb = np.array([weights[k] for k in a.tolist()], float), np.array([weights[k] + (k % 3 == 0) for k in b.tolist()], float)
        both = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
        common = sum(min(both[0].get(k, 0), both[1].get(k, 0)) for k in keys.tolist())
        similarity = common / (wa.sum() + wb.sum() - common)
        match = np.mean(minhash.band_hashes(a, wa) == minhash.band_hashes(b, wb))
        estimates.append((match, similarity**minhash.ROWS))
    match, expected = np.mean(estimates, axis=0)
    assert abs(match - expected) < 0.03


def test_shingles_of_short_texts():
    keys, counts, bounds = minhash.shingles(pa.array(["", "a", "a b c d e", "a b c d e f a b c d e", "a b", "a  b"]))
    assert np.diff(bounds).tolist() == [0, 1, 1, 6, 1, 1]
    assert counts[bounds[3] : bounds[4]].tolist().count(2) == 1
    assert keys[bounds[4]] == keys[bounds[5]] and keys[bounds[2]] in keys[bounds[3] : bounds[4]]


def test_rows_with_one_id_share_a_class(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    frame = spark.createDataFrame([(1, a, 0), (5, a, 1), (5, b, 2), (7, b, 3), (8, c, 4), (9, None, 5), (8, None, 6)], "doc_id long, text string, n int")
    found = minhash.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in found) == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (8, 8, True), (8, 8, True), (9, 8, False)]
    assert sorted(r.n for r in minhash.keep(frame).collect()) == [0, 6]

    up, right, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    vectors = spark.createDataFrame([(1, up, "x"), (5, up, "x"), (5, right, "x"), (7, right, "x"), (8, far, "y"), (5, None, "x"), (9, None, "x")], "vec_id long, embedding array<double>, label string")
    found = grid_join.similar_vectors(vectors).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (5, 0, 1), (5, 1, 1), (5, 1, 1), (7, 1, 1), (8, 0, 8), (9, 0, 9)]


def test_vectors_of_many_lengths(spark):
    rows = [(n * 10 + k, [1.0 + k * 1e-3] * (n - 1) + [1.0], "x") for n in range(2, 24) for k in range(2)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert found == {i: (1, i // 10 * 10) for i, *_ in rows}
