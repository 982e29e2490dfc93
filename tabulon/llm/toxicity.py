"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of a text is a term. Its weight is (1 + log tf) * idf, times FLOOR for words that don't go with the label;
a word goes with it if its chi-square of the 2x2 table over the examples is `least_chi2` or more. First 4 and 5 letters
that go with the label are terms too, so that a root with unseen endings still counts. Document frequencies are
counted over all documents, for the terms that examples have; a word that no example has weighs as one that no
document has, and only lengthens the text's vector.

The examples (a sample of the labelled rows, at most about `max_examples`, by a hash of the id) are sorted so that
like texts stand together, and cut into blocks. A query adds up the postings of its rarer terms; for its frequent ones
it adds up the greatest weights in each block, and takes the product of lengths where that is less, so each example has
an upper bound. Examples are scored whole in the order of their bounds, until no bound reaches the k-th best: the
result is that of scoring every example. Neighbours vote with 1 / (squared distance + smoothing); votes are calibrated on examples that are left out one at a time,
together with their near copies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, maybe_broadcast, table, tidy_batches

WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")
PREFIXES = (4, 5)
#: Weight of terms that don't go with the label; votes' smoothing; examples in a block; queries in a batch; results that a worker keeps.
FLOOR, SMOOTHING, BLOCK, BATCH, MEMO = 0.1, 0.05, 64, 128, 10_000
#: Share of the examples from which a term is frequent.
FREQUENT = 0.05
#: Least hashes of three words in a row by which examples are told to be near copies.
SIGNATURE = 4


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits, underscores and all that is beyond ASCII, lower-cased."""
    return [w.decode() for w in WORD.findall(text.lower().encode())] if text else []


def signature(words: list[str]) -> tuple[int, ...]:
    """SIGNATURE least hashes of all three words in a row (of fewer, of all); equal for near copies mostly."""
    if not words:
        return ()
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), np.uint64)
    return tuple(int((h * np.uint64(m) ^ (h >> np.uint64(m % 23 + 7))).min()) for m in range(0x9E3779B1, 0x9E3779B1 + 2 * SIGNATURE, 2))


U = np.uint64
IS_WORD = np.array([bool(WORD.match(bytes([i]))) for i in range(256)])
#: A factor and its inverse, modulo 2**64; bytes that are hashed at once; what a beginning's hash differs by from that of a word.
FACTOR, INVERSE, PIECE, HEAD = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), 1 << 20, U(0x2545F4914F6CDD1D)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.append(U(1), np.full(size, f, U))) for f in (FACTOR, INVERSE))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(31))


def hashed(text: str | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The hash of each word; for each length of beginnings, the hashes of those of longer words, and the words' places."""
    b = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)
    word = IS_WORD[b]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    whole, heads = [np.empty(0, U)], [[(np.empty(0, U), np.empty(0, np.int64))] for _ in PREFIXES]
    at = 0
    while at < len(starts):
        # some words at once, so that memory is bounded for a long text
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _powers(1 << (hi - lo).bit_length())
        piece = b[lo:hi]
        sums = np.append(U(0), np.cumsum(piece * up[: hi - lo]))
        s, e = starts[at:to] - lo, ends[at:to] - lo
        whole.append(_mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(U)))
        letters = np.flatnonzero((piece & 0xC0) != 0x80)
        first = np.searchsorted(letters, s)
        for n, found in zip(PREFIXES, heads, strict=True):
            end = letters[np.minimum(first + n, len(letters) - 1)]
            long = np.flatnonzero((first + n < len(letters)) & (end < e))
            s_, e_ = s[long], end[long]
            found.append((_mixed((sums[e_] - sums[s_]) * down[s_] + (e_ - s_).astype(U) + HEAD), long + at))
        at = to
    return np.concatenate(whole), [tuple(map(np.concatenate, zip(*found, strict=True))) for found in heads]


class Vocabulary:
    """Numbers and weights of a text's terms: words, then beginnings, each in order of their hashes."""

    def __init__(self, words: np.ndarray, heads: np.ndarray, weights: np.ndarray, unknown: float) -> None:
        """weights: idf, times FLOOR where that applies, of each term; unknown: that of words that aren't among them."""
        self.words, self.heads, self.weights, self.unknown = words, heads, weights, unknown

    @staticmethod
    def _find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, at, -1)

    def terms(self, text: tuple, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a hashed text (times: how often each word is there): known terms and how often each is there; how often each unknown word is."""
        h, heads = text
        times = np.ones(len(h)) if times is None else times
        words, which = np.unique(h, return_inverse=True)
        n = np.bincount(which, times, len(words))
        ids = self._find(self.words, words)
        known = ids >= 0
        t, m = [ids[known]], [n[known]]
        if len(self.heads):
            found = np.concatenate([self._find(self.heads, x) for x, _ in heads])
            places = np.concatenate([at for _, at in heads])[found >= 0]
            some, which = np.unique(found[found >= 0], return_inverse=True)
            t.append(some + len(self.words))
            m.append(np.bincount(which, times[places], len(some)))
        return np.concatenate(t), np.concatenate(m), n[~known]

    def unit(self, text: tuple, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a hashed text's vector of length 1; unknown words only lengthen it, and are left out."""
        t, n, strange = self.terms(text, times)
        w = (1.0 + np.log(n)) * self.weights[t]
        length = np.sqrt((w**2).sum() + (((1.0 + np.log(strange)) * self.unknown) ** 2).sum())
        return t, w / length if length > 0 else w


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for `lengths[0]` places, then from starts[1], and so on."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


@dataclass
class BlockMaxIndex:
    """Examples by position. Of each rarer term its postings; of each frequent one its weight in every example, by
    blocks, and the greatest in each block."""

    ids: np.ndarray
    labels: np.ndarray
    #: the same number for near copies
    family: np.ndarray
    #: postings of term t: rows and weights from starts[t] to starts[t + 1]
    starts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    #: the number of each frequent term, else -1; their weights by example, their greatest weights by block
    frequent: np.ndarray
    dense: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(examples: list[tuple[int, int, int, np.ndarray, np.ndarray]], n_terms: int, share: float = FREQUENT) -> BlockMaxIndex:
        """examples: id, label, family, terms, weights."""
        held = np.zeros(n_terms, np.int64)
        for e in examples:
            held[e[3]] += 1
        # texts of one kind have the same frequent terms: in order of these, the most frequent first
        rank = np.empty(n_terms, np.int64)
        rank[np.lexsort((np.arange(n_terms), -held))] = np.arange(n_terms)
        examples = sorted(examples, key=lambda e: (np.sort(rank[e[3]])[:8].tolist(), e[0]))
        n = len(examples)
        terms = np.concatenate([np.empty(0, np.int64), *(e[3] for e in examples)])
        weights = np.concatenate([np.empty(0), *(e[4] for e in examples)])
        rows = np.repeat(np.arange(n), [len(e[3]) for e in examples])
        is_frequent = held > max(share * n, 1)
        frequent = np.where(is_frequent, np.cumsum(is_frequent) - 1, -1).astype(np.int32)
        mine = is_frequent[terms]
        dense = np.zeros((-(-n // BLOCK) * BLOCK, int(is_frequent.sum())))
        dense[rows[mine], frequent[terms[mine]]] = weights[mine]
        most = dense.reshape(len(dense) // BLOCK, BLOCK, dense.shape[1]).max(axis=1, initial=0.0).T
        rows, terms, weights = rows[~mine], terms[~mine], weights[~mine]
        order = np.argsort(terms, kind="stable")
        starts = np.append(0, np.cumsum(np.where(is_frequent, 0, held)))
        number = lambda at: np.array([e[at] for e in examples], np.int64)
        return BlockMaxIndex(number(0), number(1), number(2), starts, rows[order].astype(np.int32), weights[order], frequent, dense, np.ascontiguousarray(most))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k greatest cosines with their positions, ties to the smaller position, best first; fewer,
        if fewer share a term. without: for each query a family that takes no part."""
        n = len(self.ids)
        if not n or not queries:
            return [[] for _ in queries]
        partial = np.zeros((len(queries), len(self.dense)))
        asked = np.zeros((len(queries), self.dense.shape[1]))
        for i, (terms, weights) in enumerate(queries):
            at = self.frequent[terms]
            rare = at < 0
            first = self.starts[terms[rare]]
            held = self.starts[terms[rare] + 1] - first
            places = _ranges(first, held)
            partial[i, :n] = np.bincount(self.rows[places], self.weights[places] * np.repeat(weights[rare], held), n)
            asked[i, at[~rare]] = weights[~rare]
            if without is not None:
                partial[i, :n][self.family == without[i]] = -4.0
        # all weights are positive: the whole cosines are these or more. A little is allowed for rounding
        least = np.partition(partial[:, :n], n - k, axis=1)[:, n - k] if n > k else np.zeros(len(queries))
        bound = asked @ self.most + partial.reshape(len(queries), -1, BLOCK).max(axis=2)
        alive = bound >= np.maximum(least, 0.0)[:, None] - 1e-9
        score = np.zeros_like(partial)
        for b in np.flatnonzero(alive.any(axis=0)).tolist():
            who, block = np.flatnonzero(alive[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
            score[who, block] = partial[who, block] + asked[who] @ self.dense[block].T
        out = []
        for mine in np.round(score[:, :n], 10):
            at = np.flatnonzero(mine >= np.partition(mine, n - k)[n - k]) if n > k else np.arange(n)
            at = at[mine[at] > 0]
            top = at[np.lexsort((at, -mine[at]))[:k]]
            out.append(list(zip(mine[top].tolist(), top.tolist(), strict=True)))
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the votes for label 1, each with 1 / (squared distance + SMOOTHING); without neighbours that of all examples."""
        if not near:
            return float(self.labels.mean()) if len(self.labels) else 0.5
        w = 1.0 / (2.0 - 2.0 * np.minimum(1.0, [c for c, _ in near]) + SMOOTHING)
        return float((w * self.labels[[p for _, p in near]]).sum() / w.sum())


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.005, 0.995)
    return np.log(p / (1 - p))


def calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (0.05 at least) and offset of a logistic fit of the labels to the votes' logits, by damped Newton steps with a weak pull to (1, 0)."""
    prior = np.array([1.0, 0.0])
    x = np.column_stack([_logit(votes), np.ones(len(votes))])

    def loss(ab: np.ndarray) -> float:
        z = x @ ab
        return float((np.logaddexp(0, z) - labels * z).sum() + 0.5 * ((ab - prior) ** 2).sum())

    ab = prior
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        gradient = x.T @ (p - labels) + (ab - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while loss(ab - step) > loss(ab) and np.abs(step).max() > 1e-9:
            step = step / 2
        ab = ab - step
    return max(0.05, float(ab[0])), float(ab[1])


@dataclass
class Model:
    vocabulary: Vocabulary
    #: words and beginnings (with ^) that go with the label, by number
    strong: dict[int, str]
    index: BlockMaxIndex
    slope: float
    offset: float
    k: int

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(np.array(vote)) + self.offset, -30, 30))))


@dataclass
class Example:
    doc_id: int
    label: int
    #: the same number for near copies
    family: int
    #: the words, each once, with blanks between, and how often each is there
    words: str
    times: np.ndarray


def _examples(docs: DataFrame, labelled: DataFrame, n: int) -> list[Example]:
    """The labelled documents, by id; of repeated ids the one whose words come first. Bounded by the number of examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times, signed = [], [], []
            for text in batch.column(1).to_pylist():
                mine = words_of(text)
                found = Counter(mine)
                words.append(" ".join(found))
                times.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
                signed.append(repr(signature(mine)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signed, pa.string()), pa.array(words, pa.string()), pa.array(times, pa.binary())], names=["doc_id", "label", "signed", "words", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(labelled, 16 * n), "doc_id").select("doc_id", "text", "label")
    found: dict[int, tuple] = {}
    for doc_id, *mine in zip(*(c.to_pylist() for c in rows.mapInArrow(tidy_batches(run), "doc_id long, label int, signed string, words string, times binary").toArrow().columns), strict=True):
        if doc_id not in found or mine[2:] < found[doc_id][2:]:
            found[doc_id] = mine
    families: dict[str, int] = {}
    return [Example(i, y, families.setdefault(s, len(families)), w, np.frombuffer(t, np.int32).astype(np.float64)) for i, (y, s, w, t) in sorted(found.items())]


def _associated(examples: list[Example], least: float) -> np.ndarray:
    """Hashes of words and beginnings that go with the label, by chi-square. Near copies of one label are no evidence of their own, and count once."""
    distinct = {(e.family, e.label): e for e in reversed(examples)}.values()
    n0, n1 = (sum(e.label == y for e in distinct) for y in (0, 1))
    held = []
    for y in (0, 1):
        mine = [np.unique(np.concatenate([h, *(x for x, _ in heads)])) for h, heads in (hashed(e.words) for e in distinct if e.label == y)]
        held.append(np.unique(np.concatenate([np.empty(0, U), *mine]), return_counts=True))
    every = np.union1d(held[0][0], held[1][0])
    b, a = (np.zeros(len(every)) for _ in (0, 1))
    for n, (h, count) in zip((b, a), held, strict=True):
        n[np.searchsorted(every, h)] = count
    below = (a + b) * (n1 - a + n0 - b) * n0 * n1
    off = np.maximum(np.abs(a * (n0 - b) - b * (n1 - a)) - (n0 + n1) / 2, 0.0)
    return every[(a + b >= 3) & (below > 0) & (off**2 * (n0 + n1) >= least * below)]


def _document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Over all documents: how many there are, and how many have each of the terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        total, df = 0, np.zeros(len(v.words) + len(v.heads), np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += 1
                df[v.terms(hashed(text.as_py()))[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(total, df[at]))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(tidy_batches(count), "term long, n long")
    total, df = 0, np.zeros(len(vocabulary.words) + len(vocabulary.heads))
    sums = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    for term, n in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True):
        if term < 0:
            total = n
        else:
            df[term] = n
    return total, df


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_examples: int = 8_000, least_chi2: float = 24.0, k: int = 15, max_calibration: int = 3_000) -> Model:
    """Learn from `labels` (doc_id, label 0 or 1) on `docs` (doc_id, text).

    The examples are a sample of the labelled rows of about `max_examples` at most, by a hash of doc_id; a document
    with both labels counts as 1; null ids and labels are left out; of repeated ids with different texts one counts.
    All words of the examples are in the index, at any `least_chi2`. Votes are calibrated on every n-th example, at most
    `max_calibration`. Document frequencies come from all of `docs`. Without examples, or with empty tables, all scores are 0.5 or below.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, max_examples / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    examples = _examples(docs, sample, int(1.5 * max_examples))
    strong = _associated(examples, least_chi2)
    known: list[np.ndarray] = [np.empty(0, U)]
    names: dict[int, str] = {}
    for e in examples:
        h, heads = hashed(e.words)
        known.append(h)
        split = None
        for n, x, at in ((0, h, np.arange(len(h))), *((n, *found) for n, found in zip(PREFIXES, heads, strict=True))):
            for i in np.flatnonzero(np.isin(x, strong)).tolist():
                split = split or e.words.split(" ")
                names[int(x[i])] = "^" + split[at[i]][:n] if n else split[at[i]]
        if len(known) >= 500:
            known = [np.unique(np.concatenate(known))]
    vocabulary = Vocabulary(np.unique(np.concatenate(known)), np.array(sorted(h for h, name in names.items() if name[0] == "^"), U), np.empty(0), 0.0)
    marked = {i: names[h] for i, h in enumerate([*vocabulary.words.tolist(), *vocabulary.heads.tolist()]) if h in names}
    total, df = _document_frequencies(docs, vocabulary)
    floor = np.full(len(df), FLOOR)
    floor[list(marked)] = 1.0
    vocabulary.weights, vocabulary.unknown = (np.log((total + 1.0) / (df + 1.0)) + 1.0) * floor, FLOOR * (np.log(total + 1.0) + 1.0)
    vectors = [vocabulary.unit(hashed(e.words), e.times) for e in examples]
    index = BlockMaxIndex.of([(e.doc_id, e.label, e.family, *v) for e, v in zip(examples, vectors, strict=True)], len(df))
    some = range(0, len(examples), max(1, -(-len(examples) // max_calibration)))
    votes = []
    for lo in range(0, len(some), BATCH):
        mine = some[lo : lo + BATCH]
        votes += [index.vote(near) for near in index.nearest([vectors[i] for i in mine], k, [examples[i].family for i in mine])]
    slope, offset = calibrate(np.array(votes), np.array([examples[i].label for i in some], dtype=float)) if examples else (1.0, -0.1)
    del vectors, examples
    give_back()
    return Model(vocabulary, marked, index, slope, offset, k)


RESULT = "score double, predicted int, near_ids array<long>, near_cosines array<double>, near_labels array<long>, evidence array<string>"


def classify(docs: DataFrame, model: Model, into: str | None = None) -> DataFrame:
    """`docs` (doc_id, text) with score (0 to 1), predicted (1 if score >= 0.5), the nearest examples' ids,
    cosines and labels, and the text's own terms that go with the label, heaviest first (at most 8 reported).

    Every row has its score, repeated rows the same; null and empty texts and those that share no word with any example
    have no neighbours, and the score of the examples' share of label 1. Rows stay where they are. More columns are not
    looked at; with `into`, all columns of `docs` come through, and the results are a struct of this name.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if into is None else docs
    at = rows.columns.index("text")
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        memo: dict[bytes, tuple] = {}
        for batch in batches:
            texts = [text or "" for text in batch.column(at).to_pylist()]
            keys = [xxhash.xxh3_128_digest(text) for text in texts]
            if len(memo) >= MEMO:
                memo.clear()
            todo = list({key: text for key, text in zip(keys, texts, strict=True) if key not in memo}.items())
            for lo in range(0, len(todo), BATCH):
                mine = todo[lo : lo + BATCH]
                queries = [m.vocabulary.unit(hashed(text)) for _, text in mine]
                for (key, _), (t, w), near in zip(mine, queries, m.index.nearest(queries, m.k), strict=True):
                    heavy = [name for _, name in sorted((-x, m.strong[i]) for i, x in zip(t.tolist(), w.tolist(), strict=True) if i in m.strong)][:8]
                    places = [p for _, p in near]
                    memo[key] = (m.score(m.index.vote(near)), m.index.ids[places].tolist(), [c for c, _ in near], m.index.labels[places].tolist(), heavy)
            scores, near_ids, cosines, labels, evidence = map(list, zip(*map(memo.__getitem__, keys), strict=True)) if keys else ([], [], [], [], [])
            found = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(near_ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64())), pa.array(labels, pa.list_(pa.int64())), pa.array(evidence, pa.list_(pa.string()))]
            if into is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", *names])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(found, names=names)], names=[*batch.schema.names, into])

    if into is None:
        return rows.mapInArrow(tidy_batches(run), f"doc_id long, {RESULT}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(tidy_batches(run), f"{fields}, `{into}` struct<{RESULT.replace(' ', ': ').replace(',:', ',')}>")


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from; a null id is none of them, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "near_ids", "near_cosines", "evidence")
