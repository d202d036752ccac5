"""Language model: maximum entropy with hashed n-gram and skip features and a class-factored softmax.

Every token type is in one of CLASSES * SLOTS cells, or more when there are many types: the most frequent ones
have a cell of their own, all others share one with those of the same hashed ending, and types never seen in
training are one type with a cell of its own. The probability of a token is that of its cell's class, times that
of its slot in the class, times its part of the cell's smoothed count; the first two are softmaxes over sums of
weight rows, one row for each feature of the words that went before. Features are found by the words' own hashes,
however rare the words are, and there are more rows for more training tokens. All known types and the unknown one
add up to 1, less the next to nothing that cells without types get.

The weights start at the cells' frequencies and are trained in rounds. In a round every task starts from the
same weights, walks its part of the round's documents in batches, and hands back, for each row, the weights
it has reached and how often the row occurred; their weighted mean starts the next round. Counts are exact and
cover all training documents. Words are known by a 64-bit hash.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from deltascope.llm import common, words

#: Classes and slots of each at least, and at most; in between about the cube root of the number of types.
CLASSES, SLOTS = 32, 32
MOST_CLASSES = 64
#: Cells shared by word endings; the rest, but for the unknown type's, belong to frequent types.
SHARED = 256
#: Most frequent types that every task knows; the others are looked up in a join.
HEAD = 1 << 19
#: Weight rows of the classes and of the slots. Features: the last token, the one before, the last two, the third last.
#: There are as many rows at least; one class row for each ROW_TOKENS training tokens up to MOST_CLASS_ROWS, and twice as many slot rows.
CLASS_ROWS, SLOT_ROWS, FEATURES = 1 << 14, 1 << 15, 4
ROW_TOKENS, MOST_CLASS_ROWS = 1024, 1 << 16
ROUNDS, RATE = 2, 0.15
#: Tokens that the learner takes at a time: more of them share rows in larger batches.
BATCH = 32768
#: Places or weight rows that are worked on at a time, so that their numbers stay in a core's cache from step to step.
STEP = 2048
#: Gradients of one row that are added before the others, which have a sum of their own.
FEW = 16
#: Rows that occur at most so often are added up together, others one by one.
OFTEN = 64
#: Of the types that occur once in training, one in so many stands for the unknown type there, in the head or not.
PRETEND = 4
#: Types that stand for the unknown one, at most; when there would be more, fewer stand for it and each counts for several.
STAND_INS = 1 << 20
#: Sums of weights up to this size are taken to the power of e as they are; softmaxes need not be shifted for them.
LARGE = 40
PIECES = 48
#: Token types that a task holds while it counts.
HELD_TYPES = 500_000
_END, _START = np.uint64(0x5E5E5E5E0E4D0001), np.uint64(0x5E5E5E5E0E4D0002)
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes, their endings' hashes (0 to SHARED - 1), the place of each token among them, and where each text's tokens begin and end.

    A text's tokens are its words, A to Z as a to z, and one end.
    """
    codes, distinct, places = words.split(column, lower=True)
    values, offsets = common.text_bytes(distinct)
    last = offsets[1:] - 1
    ending = values[last].astype(np.uint64) << np.uint64(8) if len(distinct) else np.zeros(0, np.uint64)
    longer = np.diff(offsets) > 1
    ending[longer] |= values[last[longer] - 1].astype(np.uint64)
    hashes = np.append(words.hashes(distinct), _END)
    endings = np.append((words.mix(ending * _M2) % np.uint64(SHARED)).astype(np.int16), np.int16(0))
    bounds = places + np.arange(len(places))
    out = np.full(bounds[-1], len(distinct), np.int64)
    body = np.ones(bounds[-1], bool)
    body[bounds[1:] - 1] = False
    out[body] = codes
    return hashes, endings, out, bounds


def count_tokens(texts: DataFrame) -> DataFrame:
    """hash, ending, c of each token type; tasks add up their own tokens first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def added() -> tuple[np.ndarray, ...]:
            key, ending, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            return key[order][first], ending[order][first], np.add.reduceat(n[order], first)

        def rows() -> pa.RecordBatch:
            key, ending, n = added()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ending), pa.array(n)], names=["hash", "ending", "n"])

        for batch in batches:
            for piece in common.pieces(batch, most=common.PIECE_BYTES // 2):
                key, ending, at, _ = tokens(piece.column("text"))
                n = np.bincount(at, minlength=len(key))
                held.append((key[n > 0], ending[n > 0], n[n > 0]))
                # Added up when there are about twice as many as the last time: few tokens are put in order again and again.
                if sum(len(x[0]) for x in held[1:]) > max(len(held[0][0]), HELD_TYPES // 8):
                    held = [added()]
            if held and len(held[0][0]) > HELD_TYPES:
                yield rows()
                held = []
        if held:
            yield rows()

    parts = texts.select("text").mapInArrow(count, "hash long, ending short, n long")
    return parts.groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("c"))


def _found(ascending: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in an ascending list that is not empty, and whether it is there. Looked up in order, near ones share what is in cache."""
    order = np.argsort(hashes)
    at = np.empty(len(hashes), np.intp)
    at[order] = np.minimum(np.searchsorted(ascending, hashes[order]), len(ascending) - 1)
    return at, ascending[at] == hashes


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the head, ascending
    counts: np.ndarray
    cells: np.ndarray
    shared: np.ndarray  # cell of each ending
    unknown: int  # cell of the unknown type
    stand_ins: np.ndarray  # hashes of the types that stand for the unknown one in training, ascending
    stands_for: int  # how many such types each of them counts for
    masses: np.ndarray  # of each cell: sum of c + 0.5 over its types
    total: int
    types: int

    def look_up(self, hashes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each type, whether it is in the head, and its count if it is."""
        if not len(self.hashes):
            return self.shared[endings], np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at, inside = _found(self.hashes, hashes)
        return np.where(inside, self.cells[at], self.shared[endings]), inside, np.where(inside, self.counts[at], 0)


def side_for(types: int) -> int:
    """Number of classes, and of slots in each."""
    side = CLASSES
    while side < MOST_CLASSES and (2 * side) ** 3 <= types:
        side *= 2
    return side


def vocabulary(counts: DataFrame, head: int = HEAD, most: int = STAND_INS) -> Vocabulary:
    """Head and cells from the table of counts. The driver gets the head, at most `head` types, a sum for each ending, and about `most` stand-ins."""
    total, types, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    stands_for = 1
    while once > PRETEND * stands_for * most:
        stands_for *= 2
    # The end of a text is no word and never stands for one.
    chosen = (F.col("c") == 1) & (F.pmod("hash", F.lit(PRETEND * stands_for)) == 0) & (F.col("hash") != int(_END))
    stand_ins = np.sort(np.ascontiguousarray(counts.where(chosen).select("hash").toArrow().column(0).to_numpy()).view(np.uint64))
    # How many types occur how often, in classes that are exact for small numbers: the head is cut between two.
    often = F.when(F.col("c") <= 64, F.col("c")).otherwise(F.floor(F.lit(64) + 16 * F.log2(F.col("c") / 64)))
    least, inside = 0, 0
    for row in sorted(counts.groupBy(often.alias("often")).count().collect(), key=lambda r: -r.often):
        inside += row["count"]
        if inside > head:
            least = row.often + 1
            break
    top = counts.where(often >= least).toArrow()
    key, ending, c = (top.column(n).to_numpy() for n in ("hash", "ending", "c"))
    key = np.ascontiguousarray(key).view(np.uint64)
    order = np.lexsort((key, -c))
    key, ending, c = key[order], ending[order], c[order]
    masses_of = np.zeros(SHARED)
    for row in counts.groupBy("ending").agg(F.sum(F.col("c") + 0.5).alias("mass")).collect():
        masses_of[row.ending] += row.mass
    size = side_for(types) ** 2
    own = min(len(key), size - SHARED - 1)
    masses_of -= np.bincount(ending[:own], c[:own] + 0.5, minlength=SHARED) if own else 0
    masses_of[masses_of < 0.25] = 0  # no types are left with this ending
    # Cells by mass: a class holds cells of similar frequency.
    mass = np.concatenate([c[:own] + 0.5, masses_of, [max(len(stand_ins) * stands_for, 0.5)], np.zeros(size - own - SHARED - 1)])
    place = np.empty(size, np.int64)
    place[np.argsort(-mass, kind="stable")] = np.arange(size)
    cells = np.concatenate([place[:own], place[own : own + SHARED][ending[own:]]])
    order = np.argsort(key)
    masses = np.zeros(size)
    masses[place] = mass
    return Vocabulary(key[order], c[order].astype(np.int64), cells[order], place[own : own + SHARED], int(place[own + SHARED]), stand_ins, stands_for, masses, int(total), int(types))


@dataclass
class Weights:
    class_bias: np.ndarray
    slot_bias: np.ndarray
    class_rows: np.ndarray
    slot_rows: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.class_bias, self.slot_bias, self.class_rows, self.slot_rows]

    def copy(self) -> "Weights":
        return Weights(*[p.copy() for p in self.parts()])


def fresh_weights(vocab: Vocabulary) -> Weights:
    side = int(np.sqrt(len(vocab.masses)))
    rows = CLASS_ROWS
    while rows < MOST_CLASS_ROWS and 2 * rows * ROW_TOKENS <= vocab.total:
        rows *= 2
    mass = np.maximum(vocab.masses, 1e-9).reshape(side, side)
    slots = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)
    classes = np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32)
    return Weights(classes[None], slots, np.zeros((rows, side), np.float32), np.zeros((rows * (SLOT_ROWS // CLASS_ROWS), side), np.float32))


def features(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each feature of what precedes each token, from the tokens' own hashes. Before a text's start stands a mark of its own."""
    start = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.arange(len(hashes))
    before = []
    for back in (1, 2, 3):
        previous = np.full(len(hashes), _START, np.uint64)
        previous[back:] = hashes[:-back]
        previous[at - start < back] = _START
        before.append(previous)
    one, two, three = before
    out = np.empty((FEATURES, len(hashes)), np.uint64)
    for row, raw in zip(out, (one, two + np.uint64(1 << 12), words.mix(one + _M1) + two, three + np.uint64(1 << 13))):
        row[:] = words.mix(raw * _M2 + np.uint64(1))
    return out


def _exp(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """e to the power of each row in `out`, and the rows' sums.

    Softmaxes don't change when a number is taken from all of a row; that is done, in `x`, only when some are large.
    """
    if max(x.max(initial=0), -x.min(initial=0)) > LARGE:
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=out) @ np.ones(x.shape[1], x.dtype)


def _softmax(x: np.ndarray, buffer: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Softmax of each row of `x`, which may be shifted."""
    buffer = np.empty_like(x) if buffer is None else buffer
    sums = _exp(x, buffer)
    return np.multiply(buffer, (1 / sums)[:, None], out=out)


def _rows(w: Weights, hashed: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class rows and slot rows of each feature; the numbers of rows are powers of two."""
    first = hashed & np.uint64(len(w.class_rows) - 1)
    second = words.mix(hashed + classes.astype(np.uint64) * _M1) & np.uint64(len(w.slot_rows) - 1)
    return first.astype(np.intp), second.astype(np.intp)


def _room(places: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Room for the sums of some places and for numbers made of them."""
    return tuple(np.empty((places, side), np.float32) for _ in range(2))


def _added(rows: np.ndarray, places: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all features of the weight rows at their places, and a buffer of that size."""
    total, buffer = (x[: places.shape[1]] for x in room)
    rows.take(places[0], axis=0, out=total, mode="clip")
    for k in range(1, FEATURES):
        total += rows.take(places[k], axis=0, out=buffer, mode="clip")
    return total, buffer


def _class_sums(w: Weights, first: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, buffer = _added(w.class_rows, first, room)
    x += w.class_bias[0]
    return x, buffer


def _slot_sums(w: Weights, second: np.ndarray, classes: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    y, buffer = _added(w.slot_rows, second, room)
    y += w.slot_bias.take(classes, axis=0, out=buffer, mode="clip")
    return y, buffer


def _forward(w: Weights, first: np.ndarray, second: np.ndarray, classes: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Probabilities of all classes in `p`, and of all slots of the given classes in `q`."""
    room = _room(min(STEP, len(classes)), p.shape[1])
    for i in range(0, len(classes), STEP):
        here = slice(i, i + STEP)
        _softmax(*_class_sums(w, first[:, here], room), out=p[here])
        _softmax(*_slot_sums(w, second[:, here], classes[here], room), out=q[here])


def _log_softmax_at(x: np.ndarray, *chosen: tuple[np.ndarray, np.ndarray], buffer: np.ndarray | None = None) -> list[np.ndarray]:
    """Natural logarithm of the softmax at the rows and columns of each of `chosen`; `x` may be shifted."""
    logs = np.log(_exp(x, np.empty_like(x) if buffer is None else buffer).astype(np.float64))
    return [x[rows, columns] - logs[rows] for rows, columns in chosen]


def log_probabilities(w: Weights, hashed: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """log10 of the probability of each cell, given the features at its place."""
    return log_probabilities_of_two(w, hashed, cells, np.zeros(0, np.intp), 0)[0]


def log_probabilities_of_two(w: Weights, hashed: np.ndarray, cells: np.ndarray, places: np.ndarray, cell: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability of each cell, given the features at its place; and that of `cell` at each of `places`, which ascend."""
    out, others = np.empty(len(cells)), np.empty(len(places))
    side = w.slot_bias.shape[1]
    room = _room(min(step, len(cells)), side)
    for i in range(0, len(cells), step):
        batch = hashed[:, i : i + step]
        classes, slots = np.divmod(cells[i : i + step], side)
        first, second = _rows(w, batch, classes)
        at = np.arange(len(classes))
        # The class softmax is the same for another cell; only the slots are those of its class.
        since, until = np.searchsorted(places, [i, i + step])
        here = places[since:until] - i
        other = np.full(len(here), cell // side)
        x, buffer = _class_sums(w, first, room)
        p, r = _log_softmax_at(x, (at, classes), (here, other), buffer=buffer)
        x, buffer = _slot_sums(w, second, classes, room)
        out[i : i + step] = p + _log_softmax_at(x, (at, slots), buffer=buffer)[0]
        x, buffer = _slot_sums(w, _rows(w, batch[:, here], other)[1], other, room)
        others[since:until] = r + _log_softmax_at(x, (np.arange(len(here)), np.full(len(here), cell % side)), buffer=buffer)[0]
    return out / np.log(10), others / np.log(10)


def sums_of_rows(rows: np.ndarray, gradient: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sum of the gradients of each distinct row, the rows, and how often each occurs, at most STEP rows at a time.

    `rows` holds the gradients' rows once or several times over. Sums stay as they are until the next ones are asked for.
    """
    # Rows and their places as one number: plain numbers sort much faster than an order of numbers is found.
    bits = len(rows).bit_length()
    keys = (rows.astype(np.int64) << bits) | np.arange(len(rows))
    keys.sort()
    places = (keys & ((1 << bits) - 1)) % len(gradient)
    keys >>= bits
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times = np.diff(np.append(first, len(keys)))
    space, buffer = (np.empty((min(STEP, len(keys)), gradient.shape[1]), gradient.dtype) for _ in range(2))

    def added(since: int, until: int) -> np.ndarray:
        """Sum of the gradients at places that follow each other in the order of rows."""
        here = places[since : min(since + len(buffer), until)]
        total = np.add.reduce(gradient.take(here, axis=0, out=buffer[: len(here)], mode="clip"), axis=0)
        for j in range(since + len(buffer), until, len(buffer) - 1):
            here = places[j : min(j + len(buffer) - 1, until)]
            buffer[0] = total
            gradient.take(here, axis=0, out=buffer[1 : len(here) + 1], mode="clip")
            np.add.reduce(buffer[: len(here) + 1], axis=0, out=total)
        return total

    # Rows that occur often one by one. The sum of the first FEW gradients and that of the others are added.
    many = np.flatnonzero(times > OFTEN)
    for i in range(0, len(many), STEP):
        runs = many[i : i + STEP]
        for one, since, often in zip(space, first[runs], times[runs]):
            np.add(added(since, since + FEW), added(since + FEW, since + often), out=one)
        yield space[: len(runs)], keys[first[runs]], times[runs]
    # The others by how often they occur: the first, second, ... gradients of all that have one are added at once.
    fewer = (OFTEN + 1 - np.minimum(times, OFTEN + 1)).astype(np.uint8)  # bytes are put in order in one pass
    by_times = np.argsort(fewer, kind="stable")[len(many) :]
    first, times, fewer = first[by_times], times[by_times], fewer[by_times]
    for i in range(0, len(first), STEP):
        since, often = first[i : i + STEP], times[i : i + STEP]
        # How many occur more than 0, 1, 2, ... times.
        more = np.searchsorted(fewer[i : i + STEP], np.arange(OFTEN + 1, OFTEN + 1 - often[0], -1).astype(np.uint8))
        for start in range(0, often[0], FEW) if often[0] <= FEW else (0, FEW):
            part = space[: len(since)] if not start else np.empty((more[FEW], gradient.shape[1]), gradient.dtype)
            gradient.take(places[since[: len(part)] + start], axis=0, out=part, mode="clip")
            for k in range(start + 1, often[0] if start else min(FEW, often[0])):
                part[: more[k]] += gradient.take(places[since[: more[k]] + k], axis=0, out=buffer[: more[k]], mode="clip")
            if start:
                space[: len(part)] += part
        yield space[: len(since)], keys[since], often


def sums_by_row(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of all rows together."""
    return tuple(np.concatenate(x) for x in zip(*((total.copy(), own, times) for total, own, times in sums_of_rows(rows, gradient))))


class Learner:
    """Weights that follow gradients, with a step size for each row (Adagrad)."""

    def __init__(self, weights: Weights, rate: float = RATE):
        self.weights, self.rate = weights.copy(), rate
        self.sums = [np.full(len(p), 1e-2, np.float32) for p in weights.parts()]
        self.seen = [np.zeros(len(p), np.int64) for p in weights.parts()]
        # Room that every batch uses again.
        self.outputs = [np.empty((BATCH, bias.shape[1]), np.float32) for bias in (weights.class_bias, weights.slot_bias)]
        self.spare = [np.empty((min(STEP, len(p)), p.shape[1]), np.float32) for p in weights.parts()]

    def _step(self, part: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Moves the rows of all features, given as one array for each, by their sums of the gradients."""
        for sums, own, times in sums_of_rows(rows.ravel(), gradient):
            self._move(part, own, sums, times)

    def _move(self, part: int, rows: np.ndarray, total: np.ndarray, times: np.ndarray) -> None:
        """Moves the rows against their gradients, which are used up."""
        sums, weights = self.sums[part], self.weights.parts()[part]
        sums[rows] = moved = sums[rows] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        self.seen[part][rows] += times
        total *= (self.rate / np.sqrt(moved))[:, None]
        np.subtract(weights.take(rows, axis=0, out=self.spare[part][: len(rows)], mode="clip"), total, out=total)
        # A row as one item of many bytes is copied whole.
        row = np.dtype((np.void, total.strides[0]))
        np.put(weights.view(row), rows, total.view(row), mode="clip")

    def learn(self, hashed: np.ndarray, cells: np.ndarray, times: np.ndarray | None = None) -> None:
        """Follows the gradients of all places, each counted once or as often as `times` says."""
        for i in range(0, len(cells), BATCH):
            classes, slots = np.divmod(cells[i : i + BATCH], self.weights.slot_bias.shape[1])
            first, second = _rows(self.weights, hashed[:, i : i + BATCH], classes)
            p, q = (x[: len(classes)] for x in self.outputs)
            _forward(self.weights, first, second, classes, p, q)
            at = np.arange(len(classes))
            p[at, classes] -= 1
            q[at, slots] -= 1
            if times is not None:
                p *= times[i : i + BATCH, None]
                q *= times[i : i + BATCH, None]
            self._move(0, np.zeros(1, np.intp), np.ones((1, len(p)), np.float32) @ p, np.array([len(classes)]))
            self._step(1, classes, q)
            self._step(2, first, p)
            self._step(3, second, q)


def training_targets(vocab: Vocabulary, hashes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each type as a target, and how often it counts; stand-ins are the unknown type."""
    cells, _, _ = vocab.look_up(hashes, endings)
    if not len(vocab.stand_ins):
        return cells, np.ones(len(cells), np.float32)
    _, pretend = _found(vocab.stand_ins, hashes)
    return np.where(pretend, vocab.unknown, cells), np.where(pretend, vocab.stands_for, 1).astype(np.float32)


CHANGES = "part int, piece int, ways int, rows binary, changes binary, seen binary"
CHANGES_NAMES = [x.split()[0] for x in CHANGES.split(", ")]


def changes_row(part: int, piece: int, group: int, rows: np.ndarray, changes: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    """Changes of some weight rows, each times how often the row occurred, and how often that was."""
    numbers = [pa.array([x], pa.int32()) for x in (part, piece, group)]
    data = [pa.array([x.tobytes()], pa.binary()) for x in (rows.astype("<u4"), changes.astype("<f4"), seen.astype("<i8"))]
    return pa.RecordBatch.from_arrays([*numbers, *data], names=CHANGES_NAMES)


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after some rounds, each over its own part of the documents, by hash of the text."""
    spark = texts.sparkSession
    weights = fresh_weights(vocab)
    known = spark.sparkContext.broadcast(vocab)  # bounded by HEAD and STAND_INS
    for done in range(rounds):
        current = spark.sparkContext.broadcast(weights)  # bounded by MOST_CLASS_ROWS and MOST_CLASSES

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learner, vocab = Learner(current.value), known.value
            for batch in batches:
                for piece in common.pieces(batch, most=common.PIECE_BYTES // 2):
                    hashes, endings, at, bounds = tokens(piece.column("text"))
                    target, times = training_targets(vocab, hashes, endings)
                    learner.learn(features(hashes[at], bounds), target[at], times[at] if vocab.stands_for > 1 else None)
            if not learner.seen[0].any():
                return
            for part, (new, old, seen) in enumerate(zip(learner.weights.parts(), current.value.parts(), learner.seen)):
                for k, at in enumerate(np.array_split(np.arange(len(new)), min(PIECES, len(new)))):
                    if seen[at].any():
                        rows = np.flatnonzero(seen[at]).astype("<u4")
                        own = at[rows]
                        yield changes_row(part, k, TaskContext.get().partitionId() % ways, rows, (new[own] - old[own]) * seen[own, None], seen[own])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            change = count = None
            part = k = group = 0
            for batch in batches:
                for part, k, group, rows, changes, seen in zip(*[batch.column(c).to_pylist() for c in CHANGES_NAMES]):
                    if change is None:
                        size = len(np.array_split(np.arange(shapes[part][0]), min(PIECES, shapes[part][0]))[k])
                        change, count = np.zeros((size, shapes[part][1])), np.zeros(size, np.int64)
                    at = np.frombuffer(rows, "<u4")
                    change[at] += np.frombuffer(changes, "<f4").reshape(len(at), -1)
                    count[at] += np.frombuffer(seen, "<i8")
            kept = np.flatnonzero(count).astype("<u4")
            yield changes_row(part, k, group, kept, change[kept], count[kept])

        # As many learners as cores: what they hand back grows with the rows and the cores, not with both and the input.
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == done).select("text").coalesce(spark.sparkContext.defaultParallelism)
        # Two steps of about the same width, so that what one task adds up grows with the root of the tasks.
        ways = max(1, int(np.sqrt(own.rdd.getNumPartitions())))
        shapes = [p.shape for p in weights.parts()]
        partial = own.mapInArrow(learn, CHANGES).groupBy("part", "piece", "ways").applyInArrow(add, CHANGES)
        found = partial.groupBy("part", "piece").applyInArrow(add, CHANGES)  # of the size of the weights
        for row in found.toLocalIterator():
            p = weights.parts()[row.part]
            at = np.array_split(np.arange(len(p)), min(PIECES, len(p)))[row.piece][np.frombuffer(bytes(row.rows), "<u4")]
            p[at] += np.frombuffer(bytes(row.changes), "<f4").reshape(len(at), -1) / np.frombuffer(bytes(row.seen), "<i8")[:, None]
        current.unpersist()
    return weights


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: Weights, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named, n_tokens, n_known, train_tokens, base_score, score of each row's text.

    Tasks score all tokens. Types outside the head are then joined with the counts; there it shows whether one
    is known, and which of two sums, made for either case, counts.
    """
    spark = docs.sparkSession
    known, model = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(weights)
    schema = common.extended(docs.select(*keep), row="bigint", n_tokens="bigint", head_known="bigint", head_base="double", head_score="double", tail="array<struct<hash:bigint,n:int,as_known:float,as_unknown:float>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, w = known.value, model.value
        number = TaskContext.get().partitionId() << 33
        log_mass = np.log10(np.maximum(vocab.masses, 1e-9))
        for batch in batches:
            for piece in common.pieces(batch, most=common.PIECE_BYTES // 2):
                hashes, endings, at, bounds = tokens(piece.column("text"))
                cells, inside, c = vocab.look_up(hashes, endings)
                cell = cells[at]
                hashed = features(hashes[at], bounds)
                head = inside[at]
                out = np.flatnonzero(~head)
                found, unknown = log_probabilities_of_two(w, hashed, cell, out, vocab.unknown)
                found -= log_mass[cell]
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                smoothed = np.log10(c + 0.5)[at]
                count = len(bounds) - 1
                base = np.bincount(text[head], smoothed[head], minlength=count)
                total = np.bincount(text[head], (found + smoothed)[head], minlength=count)
                key = text[out] * len(hashes) + at[out]
                unique, group = np.unique(key, return_inverse=True)
                n = np.bincount(group, minlength=len(unique))
                tail = pa.StructArray.from_arrays(
                    [
                        pa.array(hashes[unique % len(hashes)].view(np.int64)),
                        pa.array(n.astype(np.int32)),
                        pa.array(np.bincount(group, found[out], minlength=len(unique)).astype(np.float32)),
                        pa.array(np.bincount(group, unknown, minlength=len(unique)).astype(np.float32)),
                    ],
                    names=["hash", "n", "as_known", "as_unknown"],
                )
                spans = np.searchsorted(unique // len(hashes), np.arange(count + 1)).astype(np.int32)
                columns = [piece.column(name) for name in keep]
                columns += [pa.array(number + np.arange(count)), pa.array(np.diff(bounds)), pa.array(np.bincount(text[head], minlength=count)), pa.array(base.astype(float)), pa.array(total.astype(float)), pa.ListArray.from_arrays(pa.array(spans), tail)]
                number += count
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    scored = common.stored(docs.select(*keep, "text").mapInArrow(run, schema), "scored")
    entries = scored.select("row", F.inline("tail"))
    joined = entries.join(counts.select("hash", "c"), "hash", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    smoothed = F.col("n") * F.log10(F.col("c") + 0.5)
    sums = joined.groupBy("row").agg(
        F.sum(smoothed).alias("tail_base"),
        F.sum(F.when(F.col("c") > 0, F.col("as_known").cast("double") + smoothed).otherwise(F.col("as_unknown").cast("double"))).alias("tail_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
    )
    whole = float(np.log10(vocab.total + 0.5 * (vocab.types + 1)))
    none = F.lit(0.0)
    return scored.join(sums, "row", "left").select(
        *keep,
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", none) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", none)).alias("score"),
    )


def learn_and_score(docs: DataFrame, held_out: str = "held_out", keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Scores of all rows by a model learned from those that are not held out.

    A null text is empty and has the end token only. Without any training text every token is unknown and
    base_score is 0. Rows may repeat; each is scored.
    """
    rows = common.small_batches(docs).select(*keep, held_out, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = rows.where(~F.col(held_out)).select("text")
    counts = common.stored(count_tokens(training), "counts")
    vocab = vocabulary(counts, head)
    return score(rows, counts, vocab, train(training, vocab), (*keep, held_out))
