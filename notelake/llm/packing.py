"""Packing of tokenised documents into sequences by the linear grouping scheme.

The lengths' histogram (one number per length, whatever the corpus) holds all that the packing needs, so the plan is made on the
driver in bounded memory: large lengths, in descending order, are cut into groups of equal cardinality and rounded up to the
largest of their group; configurations of these few sizes are optimised one after the other, each the fullest that holds the
largest size left; the documents' own lengths take their groups' places; small pieces go best-fit into what is left. The
plan's entries are runs of equal sequences. Each piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 2048
GROUPS = 512
SMALL = 8  # pieces of at most capacity / SMALL are small


# ---------------------------------------------------------------- tokens


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a byte-level BPE tokenizer file, with their ids."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(chars[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}


#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    """text -> list of ids, as the tokenizers library gives them for the file with add_special_tokens=False.

    The file's vocabulary is run by tiktoken, which gives the same ids several times as fast. Texts that hold the string of an added
    token, and what tiktoken can't take (a run too long for its pattern engine), go to the tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=byte_level_ranks(path), special_tokens={})
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    slow = functools.cache(lambda: Tokenizer.from_file(path))  # few texts need it, and it takes as much memory as the rest

    def encode(text: str) -> list[int]:
        if not any(t in text for t in added):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # the engine's panics aren't Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        return slow().encode(text, add_special_tokens=False).ids

    return encode


def _pieces(path, capacity):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), 0], "<u4")
                first = len(ids) % capacity or capacity
                ends = range(first, len(ids) + 1, capacity)
                for piece, end in enumerate(ends):
                    start = 0 if not piece else end - capacity
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return run


def _batch(rows):
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


# ---------------------------------------------------------------- the plan


class Plan:
    """Runs of pieces: pieces of a length with ranks lo to lo+count-1 go to sequences seq to seq+count-1, all at one offset."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.next: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int]] = []  # length, lo, seq, offset
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (seq, count)
        self.rooms: list[int] = []

    def put(self, length: int, count: int, seq: int, offset: int) -> None:
        lo = self.next.get(length, 0)
        self.rows.append((length, lo, seq, offset))
        self.next[length] = lo + count

    def leave(self, room: int, seq: int, count: int) -> None:
        if room and count:
            if not self.free[room]:
                bisect.insort(self.rooms, room)
            self.free[room].append((seq, count))

    def open(self, lengths: list[int], count: int) -> None:
        offset = 0
        for x in lengths:
            self.put(x, count, self.sequences, offset)
            offset += x
        self.leave(self.capacity - offset, self.sequences, count)
        self.sequences += count

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                self.leave(self.capacity, self.sequences, new := max(1, count * length // self.capacity))
                self.sequences += new
                continue
            room = self.rooms[at]
            seq, many = self.free[room].pop()
            if not self.free[room]:
                self.rooms.pop(at)
            took = min(many, count)
            self.put(length, took, seq, self.capacity - room)
            self.leave(room, seq + took, many - took)
            self.leave(room - length, seq, took)
            count -= took


def linear_groups(counts: np.ndarray, small: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """Lengths over `small`, descending, in groups of equal cardinality: (rounded length, [[length, count], ...])."""
    total = int(counts[small + 1 :].sum())
    each = max(1, -(-total // groups))
    out, room = [], 0
    for length in range(len(counts) - 1, small, -1):
        left = int(counts[length])
        while left:
            if not room:
                out.append((length, []))
                room = each
            took = min(left, room)
            out[-1][1].append([length, took])
            left, room = left - took, room - took
    return out


def _fullest(left: list[tuple[int, int]], room: int) -> list[int]:
    """The pieces, as many as fit, that fill most of the room; left: ascending (size, how many there are). Ties go to the larger sizes."""
    mask = (1 << room + 1) - 1
    reach = [1]  # bit n: some of the sizes so far sum up to n
    for size, n in left:
        sums = reach[-1]
        for _ in range(min(n, room // size)):
            sums |= sums << size & mask
        reach.append(sums)
    total, pick = reach[-1].bit_length() - 1, []
    for (size, n), before in zip(left[::-1], reach[-2::-1]):
        many = next(k for k in range(min(n, total // size), -1, -1) if before >> total - k * size & 1)
        pick += [size] * many
        total -= many * size
    return pick


def make_plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """A packing of counts[length] pieces of each length from 1 to capacity."""
    plan, small = Plan(capacity), capacity // SMALL
    by_size: dict[int, list[list[int]]] = {}
    for size, members in linear_groups(counts, small, groups):
        by_size.setdefault(size, []).extend(members)
    left = {size: sum(n for _, n in members) for size, members in by_size.items()}
    sizes = sorted(left)
    while sizes:
        left[sizes[-1]] -= 1
        config = [sizes[-1], *_fullest([(s, left[s]) for s in sizes if left[s]], capacity - sizes[-1])]
        left[sizes[-1]] += 1
        uses = {s: config.count(s) for s in config}
        many = min(left[s] // u for s, u in uses.items())
        for s, u in uses.items():
            left[s] -= u * many
        sizes = [s for s in sizes if left[s]]
        while many:  # the documents' own lengths take the places
            some = min([many, *(by_size[s][0][1] // u for s, u in uses.items())]) or 1
            lengths = []
            for s, u in uses.items():
                for _ in range(u):
                    run = by_size[s][0]
                    lengths.append(run[0])
                    run[1] -= some
                    if not run[1]:
                        by_size[s].pop(0)
            plan.open(lengths, some)
            many -= some
    for length in range(small, 0, -1):
        plan.best_fit(length, int(counts[length]))
    return plan


def _placed(rows):
    def run(batches):
        length, lo, seq, offset = rows.value
        keys = (length << 44) | lo
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (batch.column("length").to_numpy(zero_copy_only=False) << 44) | rank, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq[at] + rank - lo[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a final id 0; null and empty texts are that id alone. Documents longer than the capacity are cut, whole
    pieces last. Repeated rows are packed as often as they occur; a null doc_id stays null. Sequence ids run from 0, every offset
    from 0 without gaps. Ties in length are ranked by a hash, doc_id and piece. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = scratch.save(docs.mapInArrow(_pieces(tokenizer, capacity), kind), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").count().collect():  # a row per length at most
        counts[r["length"]] = r["count"]
    rows = sorted(make_plan(counts, capacity).rows) or [(0, 0, 0, 0)]
    table = spark.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*rows)))
    salts = 64 + int(counts.sum()) // 100_000  # so that no length's rows meet in one task
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("here", here).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("here") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(table), f"{kind}, sequence_id long, offset long")
