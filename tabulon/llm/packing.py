"""Packing: shortest-pack-first over the length histogram.

1. Each document is tokenized where it is read, cut into pieces of at most `size` tokens (whole ones, then a
   rest), and every piece gets its number among the task's pieces of its length. The pieces are written.
2. The histogram of lengths has at most `size` entries. Lengths are placed longest first; a length goes into the
   shortest pack, the pattern with the most room left, and the counts of patterns are updated - so the work on
   the driver depends on `size` alone, never on the number of documents.
3. A piece's rank among all pieces of its length is its number in the task plus the pieces of that length in
   earlier tasks. Patterns give, for each length, intervals of ranks; a piece finds its sequence and offset there.

No window or sort over all pieces of a length is needed, so a length that a third of all rows share is no hot key.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, table, tidy_batches, written
from .tokens import ByteBpe, Vocabulary, default_vocabulary

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, num long"


def plan_packs(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placing) and how many sequences have each, for `counts` of each length.

    Longest first; shortest pack first: of the open patterns, the one with the most room takes the length, and
    min(left of the length, count of the pattern) of its sequences move on with one more piece. Only if none has
    room are new sequences begun, as many as hold what is left with each as full of this length as it gets - as
    placing one after the other would do.
    """
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted rooms that have an open pattern
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if room == 0:
            done.append((pattern, n))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append((pattern, n))

    for length in sorted((k for k, n in counts.items() if k > 0 and n > 0), reverse=True):
        left = counts[length]
        while left:
            if not rooms or rooms[-1] < length:
                each = min(size // length, left)
                n, left = divmod(left, each)
                put((length,) * each, size - each * length, n)
                continue
            room = rooms[-1]
            pattern, n = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop()
            took = min(n, left)
            if took < n:
                put(pattern, room, n - took)
            put((*pattern, length), room - length, took)
            left -= took
    done += [(p, n) for entries in open_by_room.values() for p, n in entries]
    return sorted(done, reverse=True)


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in order of rank; the i-th piece from the first rank goes to the i-th sequence."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter[int] = Counter()
    base = 0
    for pattern, n in packs:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def pieces(docs: DataFrame, vocabulary: Vocabulary, size: int, end_id: int) -> DataFrame:
    """A row for each piece of each document; see `pack`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64), ByteBpe(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode_bytes(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(value)
            lengths = np.array(out[2], dtype=np.int64)
            nums = np.empty(len(lengths), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            values, first, n_each = np.unique(lengths[order], return_index=True, return_counts=True)
            for v, f, n in zip(values, first, n_each, strict=True):
                nums[order[f : f + n]] = seen[v] + np.arange(n)
                seen[v] += n
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), pa.array([part] * len(nums), pa.int32()), pa.array(nums)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.mapInArrow(tidy_batches(cut), PIECES)


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, size: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack `docs` (doc_id, text) into sequences of at most `size` tokens; one row for each piece.

    A document is its ids, then `end_id`; null and empty texts are the end id alone. Columns: doc_id, start,
    length, ids_crc32 (of the ids as little-endian unsigned 32 bits), doc_tokens, sequence_id, offset. Repeated
    rows and null doc_ids are documents of their own; other columns of `docs` are not looked at. An empty table
    has no rows. Which of several pieces of one length goes to which sequence is open; the patterns are not.
    """
    spark = docs.sparkSession
    found = written(pieces(docs.select("doc_id", "text"), vocabulary or default_vocabulary(), size, end_id), "pieces")
    each = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # the histogram: at most `size` rows
    packs = plan_packs({r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    where = spark.sparkContext.broadcast(slots(packs))
    # pieces of the same length in earlier tasks: a running sum for each length over (tasks) rows, no matter how many pieces
    before = each.selectExpr("part", "length", "sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding) as before")
    n_before = each.count()
    ranked = found.join(maybe_broadcast(before, n_before * 40), ["part", "length"]).select(*[c.split()[0] for c in PIECES.split(", ")[:5]], (F.coalesce("before", F.lit(0)) + F.col("num")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = where.value
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for length in np.unique(lengths):
                rows, mine = table_[int(length)], lengths == length
                at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
                sequence[mine] = rows[at, 1] + ranks[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(tidy_batches(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
