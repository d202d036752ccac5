"""Repair of conversations against a search over all edits."""
import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.llm import conversations

SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows: (role, text, fault). Least (cost, audit) by Dijkstra over (place, what is written), with the repaired lines."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    roles = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        push = lambda c, letter, place, new, line: heapq.heappush(heap, (cost + c, audit + letter, place, new, lines + line))
        push(2, "I", at, turn[state], [f"{roles[turn[state]]}:"])
        if at < len(rows):
            role, text, fault = rows[at]
            push(3, "D", at + 1, state, [])
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] == turn[state] or (role[:1] == "s" and state == ""):
                    push(extra, "K", at + 1, role[:1], [f"{role}:{text}"])
                push(2 + extra, "R", at + 1, turn[state], [f"{roles[turn[state]]}:{text}"])


def brute(table, damage):
    """table: (conv_id, turn, role, text)."""
    by_conv = {}
    for conv, turn, role, text in table:
        rows = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in by_conv.items():
        digest = lambda r: hashlib.sha256(f"{len(str(' ' if conv is None else conv))}:{'true' if conv is None else 'false'}:{len(r[1])}:{' ' if conv is None else conv}:{r[1]}:{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), digest(r)))
        seen, faulty = set(), []
        for turn, role, text in rows:
            last = text.rstrip(SPACES)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        count = lambda name: sum(f == name for _, _, f in faulty)
        cost, audit, lines = cheapest(faulty)
        out.append((str(conv), gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def found(frame):
    return sorted((str(r.conv_id), *list(r)[1:]) for r in conversations.repair(frame).collect())


def chats(seed, count, longest):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "Why?", "", " \t", "Long, and open", "Ü.", "x\ny.", None]
    rows = []
    for conv in range(count):
        for k in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["system", "user", "assistant"][0 if k == 0 and rng.random() < 0.5 else 1 + k % 2]
            if rng.random() < 0.1:
                role = rng.choice(["", None, "tool", "sys", "User", "agent", "\U0001f600x"])
            turn = k if rng.random() < 0.9 else rng.choice([None, k - 1, k + 3])
            rows.append((conv if conv % 11 else None, turn, role, f"{k} words." if rng.random() < 0.6 else rng.choice(texts)))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, damage, partitions", [(0, True, 4), (1, False, 4), (2, True, 23)])
def test_all_columns(spark, seed, damage, partitions):
    rows = chats(seed, 80, 12)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(conversations.damaged(frame) if damage else frame) == brute(rows, damage)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_stretches_of_long_conversations(spark, monkeypatch):
    rows = [(5, k // 2 if k % 7 else k, "user" if k % 3 else "assistant", f"{k % 50} a{'.' if k % 5 else ''}") for k in range(2500)]
    rows += [(6, 1, "user", "same.")] * 300 + [(4, None, None, None), (7, 0, "system", "Only.")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows, False)


def test_stretches_of_any_size():
    """A conversation cut anywhere is repaired as in one go."""
    rng = np.random.default_rng(4)
    tables = conversations.tables()
    for _ in range(200):
        symbols = rng.integers(0, conversations.SYMBOLS, rng.integers(0, 40))
        want = tables.trace(symbols, 0, conversations.NOTHING, True)[0]
        cuts = np.sort(rng.integers(0, len(symbols) + 1, 3))
        parts = np.split(symbols, cuts)
        behind = [0]
        for part in parts[:0:-1]:
            behind.append(int(tables.function(part)[0][behind[-1]]))
        state, audit = conversations.NOTHING, ""
        for k, (part, vector) in enumerate(zip(parts, behind[::-1])):
            edits, state = tables.trace(part, vector, state, k == len(parts) - 1)
            audit += edits
        assert audit == want
        total = tables.function(symbols)[1][0] + tables.vectors[int(tables.function(symbols)[0][0])][conversations.NOTHING]
        costs = {"D": 3, "I": 2, "K": 0, "R": 2}
        kept = [c for c in audit if c != "I"]
        assert total == sum(costs[c] for c in audit) + sum(c != "D" and s and (s - 1) % 2 for c, s in zip(kept, symbols))


def test_no_rows_text_and_clashing_names(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    frame = spark.createDataFrame([(1, 0, "assistant", "a.", 5, "x"), (1, 1, "user", "b.", 5, "y")], SCHEMA + ", rows int, mark string")
    (row,) = conversations.repair(frame, with_text=True).collect()
    assert (row.audit, row.repaired) == ("IKKI", "user:\nassistant:a.\nuser:b.\nassistant:")
    assert row.repaired_sha256 == hashlib.sha256(row.repaired.encode()).hexdigest()
    long = spark.createDataFrame([(1, 0, "user", "b" * 3_000_000), (1, 1, "assistant", "c." * 1_000_000)], SCHEMA)
    assert conversations.repair(long).first().audit == "KK"
    dropped = frame.select("conv_id", "turn", "role", "text", F.lit(0).alias("copies"))
    assert found(dropped) == [("1", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
