"""Benchmark decontamination by a distributed positional inverted index.

`build_index` makes the index of the training texts: for each segment (documents of SEGMENT words or a little more), its
words, and for each word the ascending positions at which it stands. Positions count on through the segment with a gap
after each document, so no phrase goes across two documents. The index is stored, knows nothing of the benchmark, and
its rows have names of their own, so a document is told by its place and not by its id. `search_index` answers each
segment by itself: a window of an item with a word that the segment hasn't is done with; of the others it starts with
the rarest term's list, subtracts the term's place in the window, and intersects with the offset-adjusted lists of the
other terms, rarest first, until nothing is left or all terms agree. Proximity search takes the rarest term's
positions and asks of every other term of the window whether it stands close enough.

No shuffle is needed, as a document lies in one segment. The benchmark is taken in blocks of bounded size; a block is
broadcast and meets the stored index, and with several blocks the spans of a document are merged by its row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy_batches, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of item texts in one broadcast block, about.
BLOCK_BYTES = 8 << 20
#: Words from which a segment is full; free positions between its documents.
SEGMENT, GAP = 200_000, 1 << 12
INDEX = "segment string, doc_ids binary, doc_nulls binary, n_words binary, starts binary, words binary, lists binary, steps binary"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; null has none."""
    return WORD.findall(text.encode().lower()) if text else []


@dataclass
class Phrases:
    """The windows of a block of items as term numbers."""

    terms: dict[bytes, int]
    #: distinct windows, as tuples of term numbers
    windows: list[tuple[int, ...]]
    #: for each window, the items it is in
    items: list[list[int]]
    #: item numbers to ids, as strings; an item without an id has none
    names: list[str | None]

    @staticmethod
    def of(items: list[tuple], size: int) -> Phrases:
        terms: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], list[int]] = {}
        names = []
        for item_id, text in items:
            words = [terms.setdefault(w, len(terms)) for w in words_of(text)]
            if not words:
                continue
            at = len(names)
            names.append(None if item_id is None else str(item_id))
            for i in range(max(1, len(words) - size + 1)):
                mine = windows.setdefault(tuple(words[i : i + size]), [])
                if not mine or mine[-1] != at:
                    mine.append(at)
        return Phrases(terms, list(windows), list(windows.values()), names)

    def matrix(self) -> np.ndarray:
        """A row of term numbers for each window; shorter ones repeat their first term."""
        width = max(map(len, self.windows), default=1)
        return np.array([w + w[:1] * (width - len(w)) for w in self.windows], np.int64).reshape(-1, width)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def build_index(docs: DataFrame) -> DataFrame:
    """Positional postings of all words of `docs` (doc_id, text): a row for each segment. To be written before it is searched, as names are made up here."""

    def segment(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers = Numbers()
        n_words = np.array([len(t) for t in texts], np.int64)
        starts = np.append(0, np.cumsum(n_words + GAP))[:-1]
        code = np.fromiter((numbers[w] for t in texts for w in t), np.int32, n_words.sum())
        place = np.arange(len(code)) + np.repeat(np.arange(len(texts)) * GAP, n_words)
        order = np.argsort(code, kind="stable")
        lists = np.append(0, np.cumsum(np.bincount(code, minlength=len(numbers)))).astype(np.uint32)
        # a list is kept as steps, the first from 0
        steps = np.diff(place[order], prepend=0)
        steps[lists[:-1]] = place[order][lists[:-1]]
        row = [
            np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array([i is None for i in ids]).tobytes(),
            n_words.tobytes(),
            starts.tobytes(),
            b" ".join(numbers),
            lists.tobytes(),
            steps.astype(np.uint32).tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([x], pa.binary()) for x in row)], names=[c.split()[0] for c in INDEX.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(words_of(text.as_py()))
                n += len(texts[-1]) + 1
                if n >= SEGMENT:
                    yield segment(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield segment(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy_batches(build), INDEX)


class Segment:
    """One row of the index, opened for the terms that are asked for."""

    def __init__(self, row: dict, terms: dict[bytes, int]) -> None:
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["doc_nulls"], bool)
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        lists, steps = np.frombuffer(row["lists"], np.uint32), np.frombuffer(row["steps"], np.uint32)
        self.postings = {t: np.cumsum(steps[lists[i] : lists[i + 1]], dtype=np.int64) for i, w in enumerate(row["words"].split(b" ")) if (t := terms.get(w)) is not None}
        self.has = np.zeros(len(terms), bool)
        self.has[list(self.postings)] = True

    def phrase(self, window: tuple[int, ...]) -> np.ndarray:
        """Starts of all occurrences of the window."""
        if any(t not in self.postings for t in window):
            return np.empty(0, np.int64)
        lists = sorted(((len(self.postings[t]), offset, t) for offset, t in enumerate(window)))
        _, offset, rarest = lists[0]
        starts = self.postings[rarest] - offset
        for _, offset, term in lists[1:]:
            if not len(starts):
                break
            found = self.postings[term]
            at = np.searchsorted(found, starts + offset)
            starts = starts[found[np.minimum(at, len(found) - 1)] == starts + offset]
        return starts

    def proximity(self, window: tuple[int, ...], slack: int) -> np.ndarray:
        """Positions of the window's rarest term that have every other distinct term of it within len(window) - 1 + slack words on either side."""
        if any(t not in self.postings for t in window):
            return np.empty(0, np.int64)
        lists = sorted((self.postings[t] for t in set(window)), key=len)
        at, reach = lists[0], len(window) - 1 + slack
        for found in lists[1:]:
            at = at[np.searchsorted(found, at - reach) < np.searchsorted(found, at + reach, side="right")]
        return at

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _merged_spans(spans: list[tuple[int, int]]) -> list[int]:
    """Intervals [from, to), those that meet made one, flat."""
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


FOUND = "row string, doc_id long, n_words long, spans array<long>, items array<string>, near_items array<string>"


def search_index(index: DataFrame, phrases: Phrases, slack: int | None = None) -> DataFrame:
    """A row for each document of the index: row (its segment and number there), doc_id, n_words, spans (merged
    word intervals [from, to) of exact hits, flat), items (ids with an exact window), near_items (ids that have a
    window within `slack`, null without slack). slack is less than GAP less a window."""
    wanted = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = wanted.value
        matrix = p.matrix()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                segment = Segment(row, p.terms)
                n = len(segment.doc_ids)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                items: list[set[int]] = [set() for _ in range(n)]
                near: list[set[int]] = [set() for _ in range(n)]
                for i in np.flatnonzero(segment.has[matrix].all(axis=1)).tolist() if len(p.terms) else []:
                    window, of = p.windows[i], p.items[i]
                    starts = segment.phrase(window)
                    for start, doc in zip(starts.tolist(), segment.doc_of(starts).tolist(), strict=True):
                        begin = start - int(segment.starts[doc])
                        spans[doc].append((begin, begin + len(window)))
                        items[doc].update(of)
                    if slack is not None:
                        for doc in np.unique(segment.doc_of(segment.proximity(window, slack))).tolist():
                            near[doc].update(of)
                named = lambda found: [p.names[i] for i in sorted(found) if p.names[i] is not None]
                text = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{row['segment']}-{i}" for i in range(n)]),
                        pa.array(segment.doc_ids, mask=segment.nulls),
                        pa.array(segment.n_words),
                        pa.array([_merged_spans(x) for x in spans], pa.list_(pa.int64())),
                        pa.array([named(x) for x in items], text),
                        pa.array([None if slack is None else named(x) for x in near], text),
                    ],
                    names=[c.split()[0] for c in FOUND.split(", ")],
                )

    return index.mapInArrow(tidy_batches(search), FOUND)


def _merged(parts: DataFrame) -> DataFrame:
    """Spans and items of the same document from several blocks of items, joined; a row has one value for each block."""

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [_merged_spans([(s[i], s[i + 1]) for s in every for i in range(0, len(s), 2)]) for every in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(flat, pa.list_(pa.int64())), *batch.columns[4:]], names=batch.schema.names)

    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    grouped = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), every("items"), F.when(F.count("near_items") > 0, every("near_items")).alias("near_items"))
    return grouped.mapInArrow(tidy_batches(join_spans), FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int | None = None) -> DataFrame:
    """For each row of `docs` (doc_id, text), which words and items of `benchmark` (item_id, text) occur in it.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `window` consecutive item words; an item of
    fewer words, but not none, is one window. Columns: row, doc_id, n_words, spans, items, near_items, as
    search_index says. Null or empty texts and items have no words; every document has its row, repeated rows and
    those without an id too; an item without an id hits words but is in no list of items, and items with the same id
    count once in `items` sorted later by the caller. No benchmark: nothing is hit. More columns are not looked at.
    """
    index = written(build_index(docs), "postings")
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    found = None
    for k in range(n_blocks):
        part = search_index(index, Phrases.of([tuple(r) for r in items.where(block == k).collect()], window), slack)
        found = part if found is None else found.unionAll(part)
    return found if n_blocks == 1 else _merged(found)


def summary(leaks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from find_leaks' rows."""
    names = F.array_sort(F.array_distinct("items"))
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return leaks.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
