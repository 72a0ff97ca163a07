"""Conversation structure repair: the cheapest edits that make turns alternate."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import frugal
from .common import shuffle_width, stored

#: What edits cost (fixed by the operator's contract); a truncated row that stays costs its own.
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 1, 2, 5, 5
#: Rows of a conversation whose backpointers a task holds; those of more are written in pieces of so many.
SPILL = 1 << 18

#: States of the pattern (s?(ua)+)?: nothing yet, after a system, user, assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_OPS = "DKR"
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60

# Faults of a row, as the stream carries them; GONE marks a conversation, it is no row of it.
FINE, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
_SPACE = " \t\n\x0b\x0c\r"


def _turned(state: int) -> int:
    """State after the one turn that may be inserted in ``state``."""
    return ASSISTANT if state == USER else USER


def _inserted(state: int, n: int) -> tuple[int, list[str]]:
    roles = []
    for _ in range(n):
        state = _turned(state)
        roles.append(_ROLE[state])
    return state, roles


def _moves(state: int, initial: str, fault: int):
    """(edits, new state, cost) of passing one row, after up to two inserted turns."""
    for n in range(3):
        at, paid = _inserted(state, n)[0], INSERT * n
        yield "I" * n + "D", at, paid + DELETE
        if fault in (BLANK, DUPLICATE):
            continue
        stays = paid + (TRUNCATED_STAYS if fault == TRUNCATED else 0)
        if initial == "":
            yield "I" * n + "K", at, stays
        elif (at, initial) in _NEXT:
            yield "I" * n + "K", _NEXT[at, initial], stays
        yield "I" * n + "R", _turned(at), stays + REROLE


@lru_cache(1 << 16)
def step(initial: str, fault: int, costs: tuple, ranks: tuple) -> tuple:
    """One row: (costs, ranks, backpointers, moves) by new state, the costs
    over their least, which is the fifth item.

    Of two edit strings that end in the same row none is a prefix of the
    other, so the order of the strings that lead to the states (their ranks)
    and the edits of this row decide ties: the ASCII-least string wins."""
    best: list = [None] * 4
    for s in range(4):
        if costs[s] < _FAR:
            for edits, t, cost in _moves(s, initial, fault):
                option = (costs[s] + cost, ranks[s], edits, s)
                if best[t] is None or option < best[t]:
                    best[t] = option
    least = min(b[0] for b in best if b)
    order = sorted((b[1], b[2], t) for t, b in enumerate(best) if b)
    rank = {t: i for i, (_, _, t) in enumerate(order)}
    back = bytes(255 if b is None else b[3] | (len(b[2]) - 1) << 2 | _OPS.index(b[2][-1]) << 4 for b in best)
    moves = tuple(None if b is None else (b[3], b[2]) for b in best)
    return tuple(_FAR if b is None else b[0] - least for b in best), tuple(rank.get(t, 9) for t in range(4)), back, moves, least


def _finish(costs: tuple, ranks: tuple) -> tuple[int, int, int]:
    """(cost, state, inserted turns) of the best end."""
    ends = []
    for s in range(4):
        for n in range(3):
            if costs[s] < _FAR and (_inserted(s, n)[0] == ASSISTANT or (s, n) == (START, 0)):
                ends.append((costs[s] + INSERT * n, ranks[s], n, s))
    cost, _, n, s = min(ends)
    return cost, s, n


def _trace(back: bytes | bytearray, state: int) -> tuple[str, int]:
    """(edits of these rows, state before them) when they end in ``state``."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        b = back[at + state]
        out.append("I" * (b >> 2 & 3) + _OPS[b >> 4])
        state = b & 3
    return "".join(reversed(out)), state


class _Conversation:
    """What the stream keeps of one conversation between rows."""

    def __init__(self, key):
        self.key, self.costs, self.ranks, self.paid = key, (0, _FAR, _FAR, _FAR), (0, 9, 9, 9), 0
        # One digest of the repaired text per state, so no text is needed again.
        self.digests: list = [(hashlib.sha256(), False)] + [None] * 3
        self.back, self.pieces = bytearray(), 0
        self.faults, self.illegal, self.last_initial = [0] * 5, 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if fault == GONE:
            return
        self.faults[fault] += 1
        if turn is not None:
            turn = int(turn)
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        self.costs, self.ranks, back, moves, least = step(initial, fault, self.costs, self.ranks)
        self.paid += least
        self.back += back
        old, self.digests = self.digests, [None] * 4
        for t, move in enumerate(moves):
            if move:
                s, edits = move
                at, roles = _inserted(s, len(edits) - 1)
                lines = [f"{r}:" for r in roles]
                if edits[-1] != "D":
                    lines.append(f"{role if edits[-1] == 'K' else _ROLE[_turned(at)]}:{text}")
                self.digests[t] = _written(old[s], lines)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def result(self) -> dict:
        cost, state, n = _finish(self.costs, self.ranks)
        digest, _ = _written(self.digests[state], [f"{r}:" for r in _inserted(state, n)[1]])
        row = {"conv": self.key, "gaps": self.gaps(), "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED],
               "illegal": self.illegal, "cost": self.paid + cost, "repaired_sha256": digest.hexdigest(), "state": state}
        if not self.pieces:
            row["audit"] = _trace(self.back, state)[0] + "I" * n
        else:
            row |= {"tail": "I" * n, "piece": self.pieces, "back": bytes(self.back)}
        return row


def _written(so_far: tuple, lines: list[str]) -> tuple:
    digest, some = so_far
    if not lines:
        return so_far
    digest = digest.copy()
    digest.update((("\n" if some else "") + "\n".join(lines)).encode())
    return digest, True


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_STREAM = ("conv string, " + ", ".join(f"{c} long" for c in _COUNTS)
           + ", repaired_sha256 string, audit string, state int, tail string, piece long, back binary")
_STREAM_COLUMNS = [f.split()[0] for f in _STREAM.split(", ")]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: [r.get(c) for r in rows] for c in _STREAM_COLUMNS}, dtype=object)


def _stream(spill: int):
    """Rows sorted by conversation and turn to one row per conversation, and
    pieces of backpointers of those of more than ``spill`` rows. The state of
    the conversation that a batch ends in goes on to the next batch."""

    @frugal
    def run(batches):
        now: _Conversation | None = None
        for batch in batches:
            out = []
            for conv, turn, role, text, fault in zip(batch["conv"], batch["turn"], batch["role"], batch["text"], batch["fault"], strict=True):
                conv, turn = (None if x is None or x != x else x for x in (conv, turn))
                if now is None or now.key != conv:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv)
                now.add(turn, role, text, int(fault))
                if len(now.back) >= 4 * spill:
                    out.append({"conv": conv, "piece": now.pieces, "back": bytes(now.back)})
                    now.pieces, now.back = now.pieces + 1, bytearray()
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame([now.result()])

    return run


def _walk_back(batches):
    """Pieces of a conversation, the last one first, to the edits of each."""
    conv, state = None, 0
    for batch in batches:
        out = []
        for name, piece, back, end, tail in zip(batch["conv"], batch["piece"], batch["back"], batch["state"], batch["tail"], strict=True):
            if end == end and end is not None:
                conv, state = name, int(end)
            edits, state = _trace(back, state)
            out.append((name, piece, edits + (tail if isinstance(tail, str) else "")))
        yield pd.DataFrame(out, columns=["conv", "piece", "edits"])


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) as the stream takes them,
    with the first fault of every row: partitioned by conversation, sorted by
    turn. Null turns come first; rows of one turn by role and text.

    A row is a duplicate if it is not the first of its role and text in the
    conversation; that needs no memory in the stream, as one more sort of the
    same partitions tells."""
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    same = Window.partitionBy("conv_id", "same").orderBy(F.asc_nulls_first("turn"))
    rows = rows.repartition(shuffle_width(rows.sparkSession), "conv_id")
    rows = rows.withColumn("same", F.when(~F.col("gone"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    rows = rows.withColumn("nth", F.row_number().over(same))
    fault = (F.when(F.col("gone"), GONE).when(body == "", BLANK).when(F.col("nth") > 1, DUPLICATE)
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    rows = rows.withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "fault")


def repair_plan(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """The cheapest edits of every conversation of ``rows`` (conv_id, turn,
    role, text, and optionally gone): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.

    Rows are secondary-sorted and streamed: a task carries the state of the
    dynamic programme (costs and tie ranks of four states, their digests and
    four bytes of backpointers a row) over Arrow batches, so that no text or
    conversation is held. Backpointers of more than ``spill`` rows are
    written in pieces and walked back in a second pass over the pieces alone;
    the audit itself is one string.

    Nulls in role and text count as one space, a null conv_id is a
    conversation, null turns come first and leave gaps alone. Rows marked
    gone only name their conversation: one without others gives zeros, an
    empty audit and the digest of nothing. Repeated rows are duplicates of
    the first, ties of a turn go by role and text, an empty table gives an
    empty result, extra columns are ignored, texts of any length count
    whole. An empty role has no initial: keeping it leaves the pattern."""
    kind = rows.schema["conv_id"].dataType
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    taken = faults(rows.select("conv_id", "turn", space("role"), space("text"), gone.alias("gone")))
    found = stored(taken.mapInPandas(_stream(spill), _STREAM), "repair")
    pieces = found.where("piece is not null").select("conv", "piece", "back", "state", "tail")
    pieces = pieces.repartition(shuffle_width(rows.sparkSession), "conv").sortWithinPartitions("conv", F.desc("piece"))
    edits = pieces.mapInPandas(frugal(_walk_back), "conv string, piece long, edits string")
    joined = edits.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "edits"))), lambda x: x["edits"]), "").alias("whole"))
    whole = found.where("state is not null").join(joined.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")) & F.col("piece").isNotNull(), "left")
    return whole.select(F.col("conv").cast(kind).alias("conv_id"), *_COUNTS[:-1], "cost", F.coalesce("audit", "whole").alias("audit"), "repaired_sha256")


def _apply(batches):
    """Rows after their conversation's audit to the repaired rows."""
    audit, at, n, last, conv = "", 0, 0, "", None

    def inserted():
        nonlocal at, n, last
        while at < len(audit) and audit[at] == "I":
            last = "assistant" if last[:1] == "u" else "user"
            yield conv, n, last, "", "I"
            at, n = at + 1, n + 1

    for batch in batches:
        out = []
        for name, edits, role, text in zip(batch["conv"], batch["audit"], batch["role"], batch["text"], strict=True):
            if isinstance(edits, str):
                conv, audit, at, n, last = name, edits, 0, 0, ""
                if not audit.strip("I"):
                    out.extend(inserted())
                continue
            out.extend(inserted())
            edit, at = audit[at], at + 1
            if edit != "D":
                role = role if edit == "K" else "assistant" if last[:1] == "u" else "user"
                last = role if role else last
                out.append((conv, n, role, text, edit))
                n += 1
            if not audit[at:at + 1] or not audit[at:].strip("I"):
                out.extend(inserted())
        yield pd.DataFrame(out, columns=["conv", "position", "role", "text", "edit"])


def repaired_turns(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, position, role, text,
    edit (K kept, R given another role, I inserted), from the same rows as
    ``repair_plan`` (which is run unless its result is given). A
    conversation's audit travels at the head of its rows in the same sort."""
    kind = rows.schema["conv_id"].dataType
    plan = repair_plan(rows) if plan is None else plan
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    body = rows.where(~gone).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", space("role"), space("text"))
    head = plan.select("conv_id", "audit", F.lit(None).cast(body.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    both = head.unionByName(body).repartition(shuffle_width(rows.sparkSession), "conv_id")
    both = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_last("audit"), F.asc_nulls_first("turn"), "role", "text")
    out = both.select(F.col("conv_id").cast("string").alias("conv"), "audit", "role", "text").mapInPandas(frugal(_apply), "conv string, position long, role string, text string, edit string")
    return out.select(F.col("conv").cast(kind).alias("conv_id"), "position", "role", "text", "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults dealt by crc32(conv_id:turn) mod 20: 0 drops a
    row (marked gone, so that its conversation stays known), 1 empties its
    text, 2 removes [.!?] from it, 3 repeats the row, 4 makes the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(deal == 1, "").when(deal == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(deal == 4, "user").otherwise(space("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(deal == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (deal == 0).alias("gone"), copies.alias("copy")).drop("copy")


def conversation_repair(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """The audits of all damaged conversations (see ``damaged``, ``repair_plan``)."""
    return repair_plan(damaged(rows), spill)
