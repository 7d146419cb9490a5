"""Conversation structure repair by dynamic programming shared over a trie.

A conversation's rows become a signature of one letter each, by role and fault. The distinct signatures, last row first, are sorted: that
is the depth-first order of their prefix trie. One pass keeps the layers of the current path; a layer, the least cost of what follows a
row from each state, is computed once for all signatures that share it, and at a signature's end its cheapest edits are read off the
layers, first row first, so that ties fall to the smallest letter. Only roles, faults and digests are dealt out for that. Texts are dealt
out once, by conversation, and run through an incremental digest behind their conversation's edits.

No group is held: a conversation of any length streams through its task in order, as its digest can only be made in order; what grows
with it is its own signature and list of edits, one byte a row, which the result holds anyway.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, spread_join

SPACE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
REPEATED = 500_000  # rows' roles and digests that a conversation repeats are broadcast up to this number; beyond it they are joined
NEVER = 1 << 60
# States: nothing yet, after the system's row, after the user's, after the assistant's. The last two alternate; the first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # by a row of the role that is due
KEPT = {"S": (SYSTEM, None, None, None), "U": (USER, USER, None, USER), "A": (None, None, ASSISTANT, None), "O": (None,) * 4}
ROLES = {USER: "user", ASSISTANT: "assistant"}


def layer_of(letter: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost from each state before a row, given those after it. X must be deleted; small letters are truncated rows."""
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if letter != "X":
            more = TRUNCATED * letter.islower()
            best = min(best, REROLE + more + after[NEXT[state]])
            kept = KEPT[letter.upper()][state]
            if kept is not None:
                best = min(best, more + after[kept])
        out.append(best)
    return inserted(out)


def inserted(cost: list[int]) -> tuple[int, ...]:
    """Costs with insertions before the row: two in a row lead back to where they began, so one suffices between the last two states."""
    user, assistant = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    return min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant


LAST = inserted([0, NEVER, NEVER, 0])


def edits(letters: str, layers) -> str:
    """The cheapest edits' initials, ASCII-least: at each step the smallest letter with which the least cost is still reached. letters are
    in the rows' order; layers(i) is the layer before row i."""
    out, state, i, now = [], START, 0, layers(0)
    while True:
        if i == len(letters) and state in (START, ASSISTANT):
            return "".join(out)
        cost, after = now[state], None
        if i < len(letters):
            letter, after = letters[i], layers(i + 1)
            more = TRUNCATED * letter.islower()
            kept = None if letter == "X" else KEPT[letter.upper()][state]
        if after is not None and DELETE + after[state] == cost:
            out.append("D")
        elif INSERT + now[NEXT[state]] == cost:
            out.append("I")
            state = NEXT[state]
            continue
        elif kept is not None and more + after[kept] == cost:
            out.append("K")
            state = kept
        else:
            out.append("R")
            state = NEXT[state]
        i, now = i + 1, after


def _solved(batches):
    """(signature, cost, audit) of sorted signatures, each the last row first; the stack of layers is the trie's current path."""
    path, layers = "", array("q", LAST)
    for batch in batches:
        costs, audits, taken = [], [], batch.column("signature").to_pylist()
        for signature in taken:
            shared = _shared(path, signature)
            del layers[4 * (shared + 1) :]
            after = tuple(layers[-4:])
            for letter in signature[shared:]:
                after = layer_of(letter, after)
                layers.extend(after)
            path, n = signature, len(signature)
            audits.append(edits(signature[::-1], lambda i: layers[4 * (n - i) : 4 * (n - i) + 4]))
            costs.append(layers[4 * n + START])
        yield pa.RecordBatch.from_arrays([pa.array(taken, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "cost", "audit"])


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_SUMMARY = "conv_id long, signature string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _summed(batches):
    """(conv_id, signature, gaps, counts) of rows sorted by conversation and order; a row of kind 0 only names its conversation."""
    made: list[tuple] = []
    now = None

    def closed():
        turns = (now["high"] - now["low"] + 1 - now["turns"]) if now["turns"] else 0
        return (now["id"], now["letters"].decode()[::-1], turns, *(now[c] for c in _COUNTS[1:]))

    for batch in batches:
        ids, kinds, turns, roles, digests, faults, again = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "h", "fault", "again"))
        for id, kind, turn, role, h, fault, seen in zip(ids, kinds, turns, roles, digests, faults, again):
            if now is None or id != now["id"]:
                if now is not None:
                    made.append(closed())
                now = {"id": id, "letters": bytearray(), "low": None, "high": None, "turns": 0, "before": None, "role": None} | dict.fromkeys(_COUNTS[1:], 0)
            if not kind:
                continue
            if turn is not None:
                now["turns"] += turn != now["high"]
                now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
            if fault != "blank" and (seen or (turn, role, h) == now["before"]):
                fault = "duplicate"
            first = role[:1]
            letter = "X" if fault in ("blank", "duplicate") else first.upper() if first in ("s", "u", "a") else "O"
            now["letters"] += (letter.lower() if fault == "truncated" else letter).encode()
            if fault:
                now[fault] += 1
            if now["role"] is not None and now["role"] + first not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["role"], now["before"] = first, (turn, role, h)
        if len(made) >= 1000:
            yield _batch(made)
            made = []
    if now is not None:
        made.append(closed())
    yield _batch(made)


def _batch(made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made)) if made else [()] * (2 + len(_COUNTS))
    kinds = [pa.int64(), pa.string()] + [pa.int64()] * len(_COUNTS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "signature", *_COUNTS])


class _Repaired:
    """The digest of a conversation's repaired rows, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.sha.update(f"{'\n' if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            self._add(ROLES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            self.state = NEXT[self.state]
            role = ROLES[self.state]
        elif edit == "K":
            self.state = KEPT[role[0].upper()][self.state]
        if edit != "D":
            self._add(role, text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def _digests(batches):
    """(conv_id, repaired_sha256) of rows sorted by conversation and order, the row of kind 0, which holds the edits, first."""
    id, now, ids, out = None, None, [], []
    for batch in batches:
        for one, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if not kind:
                if now:
                    ids.append(id), out.append(now.digest())
                id, now = one, _Repaired(text)
            else:
                now.row(role, text)
        if len(ids) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])
            ids, out = [], []
    if now:
        ids.append(id), out.append(now.digest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])


_ROW = ["conv_id", "turn", "role", "text"]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the CRC-32 of `conv_id:turn`, nulls taken as one space: of 20 remainders 0 drops a
    row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it the user's."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"))
    rows = rows.withColumn("what", F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.select(*_ROW)


def repair(rows: DataFrame, named: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of rows (conv_id, turn, role,
    text), and of named (conv_id) if given: the faults, and the cheapest edits that make its roles `(s?(ua)+)?`.

    A conversation's rows go by turn, nulls first, then by role and by the digest of the text. Null roles and texts are one space. A row
    whose role and text come again is a duplicate from the second time on, repeated rows too. Null conv_ids are one conversation. One
    without rows has zeros, no edits and the digest of the empty string. Empty tables give no rows; other columns aren't read.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "conversations")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("h", F.unhex(F.left(F.sha2("text", 256), F.lit(32))))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    light = scratch.save(rows.select("conv_id", "turn", "role", "h", fault.alias("fault")), "light")
    key = F.struct(F.col("turn").isNotNull(), "turn")  # nulls first
    again = light.where("fault is null or fault <> 'blank'").groupBy("conv_id", "role", "h").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1").drop("n")
    again = small(scratch.save(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first"), "again"), REPEATED)
    light = light.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    light = light.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h", "fault", F.coalesce(key > F.col("first"), F.lit(False)).alias("again"))
    if named is not None:
        names = named.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        light = light.unionByName(names.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "role", "h"]
    summary = scratch.save(light.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_summed, _SUMMARY), "summary")
    signatures = summary.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    solved = scratch.save(signatures.mapInArrow(_solved, "signature string, cost long, audit string"), "solved")
    found = scratch.save(spread_join(summary, solved, ["signature"], ["conv_id"]).select("conv_id", *_COUNTS, "cost", "audit"), "found")
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h", "text").unionByName(
        found.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text")), allowMissingColumns=True
    )
    digests = scratch.save(texts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_digests, "conv_id long, repaired_sha256 string"), "digests")
    return found.join(digests.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
