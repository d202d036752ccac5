"""Quality rules, byte network, language identification and licence scan."""
import math
import random
import re

import numpy as np
import pyarrow as pa

from deltascope.llm import byte_cnn, language_id, licence_scan, quality_rules
from deltascope.llm.licence_texts import LICENCES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts):
    """Rows with a null text, a null id, a repeated row and columns whose names clash."""
    data = [(k, t, "x", 5) for k, t in enumerate(texts)] + [(700, None, "x", 5), (None, texts[0], "x", 5), (1, texts[1], "x", 5)]
    return spark.createDataFrame(data, "doc_id long, text string, score string, n_words int")


def brute_stats(text):
    text = text or ""
    found = WORD.findall(text)
    windows = {}
    for k in range(len(found) - 4):
        windows.setdefault(tuple(found[k : k + 5]), []).append(k)
    covered = {k + i for at in windows.values() if len(at) > 1 for k in at for i in range(5)}
    seen, copies, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies, lines = copies + (line in seen), lines + 1
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered), lines, len(re.findall("[A-Z]", text))


STAT_TEXTS = ["", " \n\t", "a b c d e f a b c d e", "x\n x\nx\n\n\nx", "é# É| 日本 語 <>", "one two three four five " * 30, "A\x1fB\x0bC\x85D\rE", "w" * 70_000, "a a a a a a", "a a a a a"]


def test_stats_are_those_of_brute_force(spark):
    rng = random.Random(1)
    texts = STAT_TEXTS + ["".join(rng.choice("ab \n\t#É") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    frame = docs(spark, texts)
    found = quality_rules.document_stats(frame).collect()
    want = sorted((str(r.doc_id), *brute_stats(r.text)) for r in frame.collect())
    assert sorted((str(r.doc_id), *(r[c] for c in quality_rules.STAT_NAMES)) for r in found) == want
    assert quality_rules.document_stats(frame.limit(0)).count() == 0


def test_binomial_test_is_exact():
    for n in (1, 7, 50):
        for p in (0.01, 0.3):
            for k in range(n):
                want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert abs(quality_rules.binomial_tail(k, n, p) - want) < 1e-12
    assert not quality_rules.certified(0, 0, 0.01, 0.05)
    assert quality_rules.certified(0, 1000, 0.01, 0.05) and not quality_rules.certified(0, 100, 0.01, 0.05)


def test_cutoffs_stay_within_the_allowed_share():
    """In draws from a known rate, a certified cutoff hardly ever loses more than allowed; useless rules get none."""
    rule, grid = "symbols", quality_rules.RULES["symbols"][2]
    rng = np.random.default_rng(0)
    allowed = 0.05 / len(quality_rules.RULES)
    beyond = 0
    for _ in range(200):
        reached = rng.choice([0, 5], 3000, p=[1 - 1.5 * allowed, 1.5 * allowed])
        counts = [(1, rule, int(k), int((reached == k).sum()), 40) for k in (0, 5)]
        chosen = quality_rules.choose_cutoffs(counts)
        beyond += chosen.get((1, rule), 1) <= grid[len(grid) - 5]
    assert beyond <= 2
    assert quality_rules.choose_cutoffs([(1, rule, 0, 5000, 10), (1, rule, 16, 0, 300)]) == {(1, rule): grid[0]}
    assert quality_rules.choose_cutoffs([(1, rule, 0, 5000, 300)]) == {}


def test_rules_learn_and_keep(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(60)) for _ in range(900)]
    bad = [" ".join(word() + "###" for _ in range(60)) for _ in range(120)]
    frame = spark.createDataFrame([(k, t, "s") for k, t in enumerate(good + bad)] + [(5000, None, "s"), (None, good[0], "s"), (5001, "too short", "s")], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(k, int(k < 900)) for k in range(1020)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    kept = quality_rules.keep(frame, labels)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {*range(900), None}
    stats = quality_rules.document_stats(frame)
    assert quality_rules.learn(stats, labels.limit(0)) == {}
    judged = quality_rules.judge(stats, {}).collect()
    assert sum(r.kept for r in judged) == 1021
    assert quality_rules.keep(frame.limit(0), labels).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(3)
    net = byte_cnn.fresh_network(1)
    net = byte_cnn.Network(*[p.astype(np.float64) for p in net.parts()])
    chunks = rng.integers(0, 257, (6, byte_cnn.CHUNK)).astype(np.int16)
    text_of, marks = np.array([0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        pooled = np.maximum(byte_cnn.responses(net, chunks)[0].max(axis=1) + net.bias, 0)
        means = np.stack([pooled[text_of == k].mean(axis=0) for k in range(3)])
        p = 1 / (1 + np.exp(-(means @ net.weights + net.shift)))
        return -(marks * np.log(p) + (1 - marks) * np.log(1 - p)).mean()

    found = byte_cnn._gradients(net, chunks, text_of, marks)
    for part, gradient in zip(net.parts(), found):
        flat = part.reshape(-1)
        for k in rng.integers(0, min(flat.size, 256 * byte_cnn.DIMENSIONS), 6):
            held = flat[k]
            flat[k] = held + 1e-5
            high = loss()
            flat[k] = held - 1e-5
            low = loss()
            flat[k] = held
            assert abs((high - low) / 2e-5 - gradient.reshape(-1)[k]) < 1e-4


def test_every_byte_is_in_a_chunk():
    for size in (0, 1, 31, 32, 480, 481, 512, 513, 992, 993, 5000):
        starts = byte_cnn.chunk_starts(size)
        assert starts[0] == 0 and starts[-1] + byte_cnn.CHUNK >= size and (np.diff(starts) < byte_cnn.CHUNK).all()
    net = byte_cnn.fresh_network(2)
    texts = ["", "abc", "x" * 5000, "é" * 700]
    one = [byte_cnn.score_texts(net, pa.array([t]))[0] for t in texts]
    assert np.allclose(byte_cnn.score_texts(net, pa.array(texts)), one, atol=1e-6)
    changed = "x" * 4990 + "!?!?!?!?!?"
    assert byte_cnn.score_texts(net, pa.array([changed]))[0] != one[2]


def test_network_learns_and_scores_held_out_texts(spark):
    rng = random.Random(9)
    line = lambda tail: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + tail for _ in range(rng.randint(20, 60)))
    texts = [line("" if k % 3 else "$$$") for k in range(240)]
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(160)] + [(None, 1), (5, 0), (5, 1)], "doc_id long, quality int")
    net = byte_cnn.fit(frame, labels)
    scored = byte_cnn.with_score(frame, net)
    assert set(scored.columns) == set(frame.columns)
    rows = scored.collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 243
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in rows if r.doc_id is not None and 160 <= r.doc_id < 240]) > 0.95
    assert byte_cnn.keep(frame, labels).columns == frame.columns
    share = byte_cnn.fit(frame, labels.where("quality = 1"))
    assert all(r.score > 0.9 for r in byte_cnn.with_score(frame, share).collect())
    assert all(r.score == 0.5 for r in byte_cnn.with_score(frame, byte_cnn.fit(frame, labels.limit(0))).collect())
    assert byte_cnn.with_score(frame.limit(0), net).count() == 0


def test_kernel_is_that_of_sets():
    texts, langs = ["the cat and the dog", "le chat et le chien", "the bird", "l'oiseau"], ["en", "fr", "en", "fr"]
    model = language_id.train(texts, langs)

    def held(text):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        padded = " " + " ".join(words) + " " if words else " "
        return {padded[k : k + n] for n in range(1, language_id.GRAMS + 1) for k in range(len(padded) - n + 1)} - {" "}

    known = set().union(*map(held, texts))
    probes = [*texts, "the chat", "", "zzz 123", "ÉTÉ the"]
    presence, _ = model.presence(pa.array(probes))
    assert presence.shape[1] == len(known)  # no two n-grams share a slot in so small a set
    assert presence.sum(axis=1).tolist() == [len(held(t) & known) for t in probes]
    inner = presence @ presence.T
    for a, x in enumerate(probes):
        for b, y in enumerate(probes):
            assert inner[a, b] == len(held(x) & held(y) & known)


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    vocabulary = {"en": ["the", "dog", "house", "with", "water", "right"], "fr": ["le", "chien", "maison", "avec", "l'eau", "où"], "ru": ["дом", "вода", "собака", "право", "и", "на"]}
    rows = [(k, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(3, 40))), lang, "c") for k, lang in ((k, ["en", "en", "fr", "ru"][k % 4]) for k in range(400))]
    rows += [(900, None, "en", "c"), (901, "12 !! ", "fr", "c"), (902, "", "fr", "c"), (903, "le chien", None, "c"), (None, "the dog", "en", "c"), (1, rows[1][1], rows[1][2], "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fit(frame.where("doc_id % 3 > 0 or doc_id is null"))
    found = {r.doc_id: r for r in language_id.with_language(frame, model).collect()}
    assert np.mean([found[k].lang_pred == found[k].lang for k in range(0, 400, 3)]) > 0.97
    assert [found[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[900].score == 0
    assert language_id.with_language(frame.limit(0), model).count() == 0
    nothing = language_id.fit(frame.limit(0))
    assert {r.lang_pred for r in language_id.with_language(frame, nothing).collect()} == {"und"}


def test_licence_scan(spark):
    import duckdb

    mit = LICENCES["MIT"]
    variants = [
        mit, mit.upper(), "Copyright (c) 2020 Somebody\n(c) 1999 Other.\nAll rights reserved.\n\n" + mit, mit.replace("\n", "\r\n   * ").replace('"', "“"), mit.replace("noninfringement", "non-infringement"),
        mit + "and more", mit[:-40], "", "released UNDER the mit licence", "Released under the MIT License", "The copyright notice", "x" * 200_000,
    ]
    want = ["MIT"] * 5 + [None] * 3 + ["MIT-notice"] * 2 + [None] * 2
    rows = [(k, t, "d", "l") for k, t in enumerate(variants)] + [(50, None, "d", "l"), (0, mit, "d", "l"), (None, mit, "d", "l")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, license_id string")
    found = licence_scan.scan(frame).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.license_id) for r in found} == {*enumerate(want), (50, None), (None, "MIT")}
    connection = duckdb.connect()
    documents = frame.toArrow()
    connection.register("documents", documents)
    assert sorted(map(str, connection.sql(licence_scan.scan_sql()).fetchall())) == sorted(str(tuple(r)) for r in found)
    assert licence_scan.scan(frame.limit(0)).count() == 0
    own = spark.createDataFrame([("B", "My licence"), ("A", "my LICENSE!"), ("C", None), ("D", " ")], "license_id string, text string")
    assert {r.license_id for r in licence_scan.scan(spark.createDataFrame([(1, "My license."), (2, "")], "doc_id long, text string"), own).collect()} == {"A", None}


def test_languages_with_long_texts_only_and_many_languages(spark):
    rng = random.Random(3)
    syllables = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    words = {f"l{k:02}": ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(12)] for k in range(70)}
    rows = [(f"{lang}-{n}", " ".join(rng.choice(own) for _ in range(20)), lang) for lang, own in words.items() for n in range(8)]
    rows += [(f"long-{n}", " ".join(rng.choice(["zxq", "qzx", "xxz"]) for _ in range(4000)), "long") for n in range(4)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = language_id.fit(frame)
    assert len(model.languages) == 71
    probes = spark.createDataFrame([(lang, " ".join(rng.choice(own) for _ in range(30))) for lang, own in [*words.items(), ("long", ["zxq", "qzx", "xxz"])]], "want string, text string")
    found = language_id.with_language(probes, model).collect()
    assert np.mean([r.lang_pred == r.want for r in found]) > 0.95
    assert {r.lang_pred for r in found if r.want == "long"} == {"long"}


def test_crowded_slots_are_looked_up(monkeypatch):
    """With a table far too small every n-gram of the landmarks still counts."""
    texts, langs = ["the cat and the dog", "le chat et le chien", "the bird", "l'oiseau"], ["en", "fr", "en", "fr"]
    probes = pa.array([*texts, "the chat", "", "zzz 123", "ÉTÉ the"])
    wide, _ = language_id.train(texts, langs).presence(probes)
    monkeypatch.setattr(language_id, "_TABLE_BITS", 4)
    model = language_id.train(texts, langs)
    assert sum(model.crowded) > 40
    small, _ = model.presence(probes)
    assert (small.sum(axis=1) == wide.sum(axis=1)).all() and (small @ small.T == wide @ wide.T).all()
