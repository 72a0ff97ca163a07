import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest

from cohortlens.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, gone_ string, fault int, same string, nth int"
_SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """(conversation -> rows) after damage, every conversation named."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        role = "user" if deal == 4 else role
        mine += [(turn, role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    return out


def search(rows, kinds):
    """(cost, audit, repaired) by best-first search over all edit strings: no states, no ranks."""
    viable = re.compile(r"(s?(ua)*u?)?\Z")
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, made = heapq.heappop(heap)
        if (audit, i, initials) in seen:
            continue
        seen.add((audit, i, initials))
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, [(r, "" if k is None else rows[k][2]) for r, k in made]
        options = [(5, "I", i, r, None) for r in ("user", "assistant") if not audit.endswith("II")]
        if i < len(rows):
            options.append((2, "D", i + 1, None, None))
            if kinds[i] not in ("blank", "duplicate"):
                stay = 5 if kinds[i] == "truncated" else 0
                options += [(stay, "K", i + 1, rows[i][1], i)] + [(stay + 1, "R", i + 1, r, i) for r in ("user", "assistant")]
        for paid, edit, j, role, k in options:
            then = initials + ("" if role is None else role[:1])
            if viable.match(then):
                heapq.heappush(heap, (cost + paid, audit + edit, j, then, made if role is None else (*made, (role, k))))


def brute(rows):
    out = {}
    for conv, mine in damage(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds, seen = [], set()
        for _, role, text in mine:
            solid = _SOLID.findall(text)
            kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "fine")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, repaired = search(mine, kinds)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def corpus(seed, n=60, longest=7):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "well", "Why? ", "  ", "", "ok.\n", "Yes.", "é!", "\x85.", "a\x85", None, "x. y", "\t\x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "User"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            good = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), good, rng.choice(texts)))
    rows += rows[3:6] + [(901, 5, "user", "Hi.")] + [(900 + i, t, "user", "Hi.") for i in range(40) for t in (5,)]
    rng.shuffle(rows)
    return rows


def found(spark, rows, parts=5, spill=C.SPILL):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).withColumnRenamed("gone_", "conv").repartition(parts)
    got = C.conversation_repair(df, spill).collect()
    assert len(got) == len({g.conv_id for g in got})
    return {g.conv_id: (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit, g.repaired_sha256) for g in got}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_search_over_all_edits(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    got = {g.conv_id: (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit, g.repaired_sha256) for g in C.conversation_repair(table).collect()}
    assert got == brute(rows)


def test_giant_conversation_is_spilled_and_spans_batches(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A. %d." % t, "b%d" % t, " "])) for t in range(900)]
    rows += [(8, t, ["user", "assistant"][t % 2], f"Fine {t}.") for t in range(300)] + [(None, t, ["user", "assistant"][t % 2], f"Fine {t}.") for t in range(200)]
    whole = found(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert found(spark, rows, 3, spill=64) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole[7][6]) >= 800


def test_dropped_conversations_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, [(gone, 0, "user", "Hi.")]) == {gone: nothing}
    assert C.conversation_repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_repaired_turns_have_the_digest_and_pattern(spark):
    rows = C.damaged(spark.createDataFrame(corpus(9), "conv_id long, turn long, role string, text string"))
    plan = C.repair_plan(rows)
    turns = sorted((r for r in C.repaired_turns(rows, plan).collect()), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position))
    made = {c: list(rs) for c, rs in groupby(turns, key=lambda r: r.conv_id)}
    for p in plan.collect():
        mine = made.get(p.conv_id, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == p.repaired_sha256
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert "".join(r.edit for r in mine) == p.audit.replace("D", "")
        assert [r.position for r in mine] == list(range(len(mine)))


def test_very_long_text_and_long_ids(spark):
    big = "word " * 400_000 + "end."
    rows = [(2**60 + 1, 2**53 + 1, "user", big), (2**60 + 1, 2**53 + 3, "assistant", big + "!")]
    assert found(spark, rows) == brute(rows)
