"""Quality rules with cutoffs that limit, with proof, how many good documents they reject.

Every rule compares one rate of a text with a cutoff from a fixed list. Labelled documents that no fit has
seen are the holdout. For each stratum and rule the cutoffs are tested from the mildest on: a cutoff is
certified if so few good holdout documents reach it that the exact binomial test rejects "its false
rejections exceed the allowed share". The first cutoff that fails ends the sequence, so testing many cutoffs
needs no correction; strata and rules are corrected for by Bonferroni. Each rule gets an equal part of the
allowed share, so that all together stay within it. Of the certified cutoffs the one is taken that rejects
the most bad documents, each good one counting against several of them; none if there is no gain.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deltascope.llm import common, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]

#: A text below this many words, or with a larger share of repeated words than this many hundredths, fails without further rules.
LEAST_WORDS = 10
MOST_REPEATED = 20

#: Rate of each rule (numerator, denominator) and its cutoffs, mildest first. Fixed before any label is seen.
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)),
    "duplicate_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeated_words": ("n_repeat_words", "n_words", (0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05)),
    "upper_case": ("n_upper", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "word_length": ("word_chars", "n_words", (60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0)),
}
#: Upper bounds of words of all strata but the last.
LENGTH_BANDS = (50, 200, 800)
#: Largest share of good documents of a stratum that all rules together may reject, and the chance that any stratum exceeds it.
ALLOWED, RISK = 0.05, 0.05
#: A good document rejected counts as so many bad ones kept.
GOOD_WEIGHT = 20


def _stats(column: pa.Array) -> list[np.ndarray]:
    values, offsets = common.text_bytes(column)
    lead = (values & 0xC0) != 0x80
    symbol = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
    per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    codes, _, places = words.split(column)
    at, key = words.windows(codes, places, REPEAT_WINDOW, words.mix(np.arange(1, len(column) + 1, dtype=np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    for k in range(REPEAT_WINDOW):
        same &= codes[at[order][1:] + k] == codes[at[order][:-1] + k]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + REPEAT_WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    lines, copies = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for k, text in enumerate(column.to_pylist()):
        full = [x for x in text.split("\n") if x.strip(common.WORD_BREAKS)]
        lines[k], copies[k] = len(full), len(full) - len(set(full))
    return [np.diff(places), per_text(lead & ~words.breaks(values)), per_text(symbol[values]), copies, np.diff(inside[places]), lines, per_text((values >= 65) & (values <= 90))]


def with_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns and the counts in STATS, under names with `prefix`. A null text has no words.

    A column with the name of a count is replaced.
    """
    names = [prefix + x for x in STAT_NAMES]
    kept = common.small_batches(docs).drop(*[c for c in docs.columns if c in names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch, text_col):
                texts = piece.column(text_col).cast(pa.string()).fill_null("")
                yield pa.RecordBatch.from_arrays([*piece.columns, *map(pa.array, _stats(texts))], names=[*piece.schema.names, *names])

    return kept.mapInArrow(count, common.extended(kept, **dict.fromkeys(names, "bigint")))


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each row."""
    return with_stats(common.whole_text(docs, id_col, text_col)).drop("text")


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def stratum(prefix: str = "") -> Column:
    """Number of the length band."""
    return reduce(lambda c, i: c + (F.col(prefix + "n_words") >= LENGTH_BANDS[i]).cast("int"), range(len(LENGTH_BANDS)), F.lit(0))


def _rate(rule: str, prefix: str = "") -> Column:
    above, below, _ = RULES[rule]
    return F.when(F.col(prefix + below) > 0, F.col(prefix + above) / F.col(prefix + below)).otherwise(F.lit(0.0))


def _passed(rule: str) -> Column:
    """How many of the rule's cutoffs the rate reaches."""
    return reduce(lambda c, x: c + (_rate(rule) >= x).cast("int"), RULES[rule][2], F.lit(0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed from the largest term down while terms matter."""
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, -1, -1):
        total += term
        if term < total * 1e-17:
            break
        term *= i * (1 - p) / ((n - i + 1) * p)
    return min(total, 1.0)


def certified(false: int, good: int, allowed: float, risk: float) -> bool:
    """Whether `false` rejections among `good` holdout documents prove, up to `risk`, a rate of at most `allowed`."""
    return good > 0 and false < allowed * good and binomial_tail(false, good, allowed) <= risk


def choose_cutoffs(counts: list[tuple[int, str, int, int, int]], allowed: float = ALLOWED, risk: float = RISK) -> dict[tuple[int, str], float]:
    """Cutoffs by (stratum, rule), from rows (stratum, rule, cutoffs reached, good, bad) of the holdout."""
    strata = sorted({row[0] for row in counts})
    chosen = {}
    for s in strata:
        for rule, (_, _, cutoffs) in RULES.items():
            rows = [r for r in counts if r[0] == s and r[1] == rule]
            good = sum(r[3] for r in rows)
            best, gain = None, 0
            for k, cutoff in enumerate(cutoffs, 1):
                hit = [r for r in rows if r[2] > len(cutoffs) - k]  # who reaches a cutoff reaches all stricter ones
                lost, caught = sum(r[3] for r in hit), sum(r[4] for r in hit)
                if not certified(lost, good, allowed / len(RULES), risk / ((len(LENGTH_BANDS) + 1) * len(RULES))):
                    break
                if caught - GOOD_WEIGHT * lost > gain:
                    best, gain = cutoff, caught - GOOD_WEIGHT * lost
            if best is not None:
                chosen[s, rule] = best
    return chosen


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", allowed: float = ALLOWED, risk: float = RISK) -> dict[tuple[int, str], float]:
    """Cutoffs from the counts of labelled documents. Only numbers of documents by stratum, rule and cutoff reach the driver.

    Labels other than 0 and 1, contradicting labels of one document and null ids are left out; no labels give
    no cutoffs. Texts that fail without further rules are not part of the holdout.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("mark")).where("mark in (0, 1) and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("other")).where("mark = other").select("doc_id", "mark")
    held = stats.where(~base_failed()).join(marks, "doc_id")
    rows = held.select(stratum().alias("stratum"), "mark", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), _passed(r).alias("reached")) for r in RULES])))
    table = rows.groupBy("stratum", "rule", "reached").agg(F.sum("mark").alias("good"), F.sum(1 - F.col("mark")).alias("bad"))
    return choose_cutoffs([tuple(r) for r in table.collect()], allowed, risk)


def rejected_by(cutoffs: dict[tuple[int, str], float], prefix: str = "") -> Column:
    """Names of the rules whose cutoff a row reaches, as an array."""
    hits = [F.when((stratum(prefix) == s) & (_rate(rule, prefix) >= cutoff), F.lit(rule)) for (s, rule), cutoff in sorted(cutoffs.items())]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def judge(stats: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """The counts with base_failed, rejected_by (names of rules) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rejected_by": rejected_by(cutoffs)}).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(labels.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
    cutoffs = learn(document_stats(labelled), labels, id_col)
    prefix = "rule stat "
    return with_stats(docs, text_col, prefix).where(~base_failed(prefix) & (F.size(rejected_by(cutoffs, prefix)) == 0)).select(*docs.columns)
