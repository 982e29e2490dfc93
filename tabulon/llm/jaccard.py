"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct word shingles; two documents link when 100 * intersection >= 75 * union (the share
is a parameter). Documents of the same set are one *set* from the start, so copies never meet each other in pairs.

Order and classes. A shingle in one set only is class 0, one in up to `frequent` sets class 1, others class 2. The
global order is by the number of sets, in powers of two, then by a hash of those sets, so rare shingles come first. Of a set of n shingles at least t = ceil(0.75 n)
are in any linked set, so n - t of its shingles can be missing there. Its prefix is extended until more than n - t
losses are needed to break all of its signatures: a single shingle of class 0 or 1 breaks with one loss; class-2
shingles are dealt into `groups` subclasses by hash, all *pairs* in a subclass are signatures, and m shingles there
break with m - 1 losses. Two linked sets then share a signature. Sets too small for that (t <= `groups`) use single
shingles throughout, and so do sets that one of those may link to. Class-0 shingles need no signature: they only fill
the prefix, and a set with more than n - t of them has no link at all.

Steps. (1) Documents are cut into blocks; a block's shingles go, packed by hash range, to where they are counted, each
with its set's number in the block (a posting has 6 bytes at any size of the input); shingles of one posting end
there. (2) The others come back by block, each with a hash of the sets that hold it, its holders; prefixes and signatures
are made, of holders in place of shingles, so shingles of the same sets make one signature. (3) Sets with a common
signature make a bucket; each member is verified against its bucket's hub. Signatures are dealt to ranges by their least
holder, so that those of near copies meet in one range or a few, where a pair of hub and member is one row: however many
ranges there are, a set isn't sent once from each. (4) Where a member
failed, the buckets of one hub are a family: its members outside of the family's largest component are compared with
all its members, block against block - so no link between components is lost, and no pairs become rows. (5)
Components by alternating large and small stars.

Copies in one block are one set from the start; a set that is in several blocks is counted in each, which only makes
its shingles look more frequent, and is one again from the signatures on.

Shingles that more than `frequent` sets of one block share, and signatures with many members in one block, are handled
where they are found. The number from which that is so falls with the number of blocks, so that what all blocks
together send for one key stays within `range`, whether a key is common in some blocks or a little in all.
Verification intersects the shingles that are in two sets or more (others can't be shared), as hashes of 40 bits
plus the number of the range; set ids are 64-bit hashes of the shingles' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, table, tidy_batches, tidy_group, written

WORD_CACHE = 200_000


@dataclass(frozen=True)
class Tuning:
    """Sizes that change the work, never the result."""

    #: sets that a class-1 shingle is in at most, a power of two; subclasses of class 2; members from which a signature is hot
    frequent: int = 256
    groups: int = 16
    hot: int = 512
    #: sets of one block from which a shingle is handled there, `frequent` at most
    heavy: int = 256
    #: shingles in a block of documents, and in a range of hashes; for large inputs both grow, up to `largest`
    block: int = 500_000
    range: int = 1_500_000
    largest: int = 8_000_000
    #: members of a family that are compared at once
    compared: int = 1024

    @property
    def level(self) -> int:
        """The order of the last shingles of class 1: sets, rounded up to a power of two, as its exponent."""
        return (self.frequent - 1).bit_length()

    def fitted(self, total: int) -> Tuning:
        """For `total` shingles: a block should have a hundred or so in each range, and all blocks' postings of one key are to be fewer than a range has."""
        side = min(self.largest, int((100 * total) ** 0.5))
        block, range_ = max(self.block, side), max(self.range, side)
        share = max(2, range_ // (total // block + 1))
        return replace(self, block=block, range=range_, heavy=min(self.frequent, share), hot=min(self.hot, share))


#: The order of shingles that are frequent in one block already.
LAST = 255


U = np.uint64
MULTIPLIER, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
LOW40 = U((1 << 40) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> U(30))) * MIX1
    h = (h ^ (h >> U(27))) * MIX2
    return h ^ (h >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; null has none."""
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all `size` words in a row; of fewer words, one hash of all."""
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(known.__getitem__, words), U, len(words))
    k = min(size, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h *= MULTIPLIER
        h += w[i : len(w) - k + 1 + i]
    return np.unique(mix(h + U(k)))


def set_id(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), U).astype(np.int64))


def squeeze(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def expand(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def planes(at: np.ndarray) -> bytes:
    """Ascending numbers under 2**16 as steps, the low bytes before the high ones, which are mostly 0."""
    steps = np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)
    return steps[:, 0].tobytes() + steps[:, 1].tobytes()


def from_planes(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, np.uint8).astype(np.int64).reshape(2, -1)
    return np.cumsum(low + (high << 8))


#: Sets in a block, documents in a block.
MOST_SETS, MOST_DOCS = (1 << 16) - 1, 1 << 18
#: key: a range, or -1 - block. base: the range, or what else the row holds.
POSTINGS = "key long, block long, base long, at binary, tokens binary, classes binary, ids binary, of binary"
NAMES = [c.split()[0] for c in POSTINGS.split(", ")]
#: In place of a range: postings of heavy shingles of a block, its sets and documents; in place of a block: heavy shingles.
HEAVY, ABOUT, MARK = -1, -2, -1


def _arrow(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=NAMES)


def _index_blocks(docs: DataFrame, size: int, ranges: int, tuning: Tuning) -> DataFrame:
    """Postings of all shingles by range. With keys under 0, on to the blocks: what sets and documents a block has, and its postings of heavy shingles."""

    def flush(block: int, sets: dict[int, int], hashes: list[np.ndarray], ids: list[int | None], of: list[int]) -> pa.RecordBatch:
        counts = np.array([len(h) for h in hashes], np.int64)
        about = [np.array(list(sets), np.int64).tobytes(), counts.astype(np.int32).tobytes(), np.array([i is None for i in ids]).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array(of, np.int32).tobytes()]
        rows: list[list] = [[-1 - block, block, ABOUT, *about]]
        if len(hashes):
            t = np.concatenate(hashes)
            which = ((t >> U(40)) * U(ranges)) >> U(24)
            token = (which << U(40)) | (t & LOW40)
            at = np.repeat(np.arange(len(counts)), counts)
            ordered = np.sort(token)
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            heavy = ordered[first[np.diff(np.append(first, len(ordered))) > tuning.heavy]]
            if len(heavy):
                is_heavy = np.isin(token, heavy)
                rows.append([-1 - block, block, HEAVY, planes(at[is_heavy]), squeeze(token[is_heavy], 8), b"", b"", b""])
                token, which, at = token[~is_heavy], which[~is_heavy], at[~is_heavy]
                for r in np.unique(heavy >> U(40)).tolist():
                    rows.append([r, MARK, r, b"", heavy[heavy >> U(40) == U(r)].tobytes(), b"", b"", b""])
            order = np.argsort(which.astype(np.int32), kind="stable")
            token, which, at = token[order], which[order], at[order]
            starts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else np.empty(0, np.int64)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(which)], strict=True) if len(which) else ():
                r = int(which[lo])
                rows.append([r, block, r, planes(at[lo:hi]), squeeze(token[lo:hi], 5), b"", b"", b""])
        return _arrow(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets, hashes, ids, of, n = WordHashes(), {}, [], [], [], 0
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingles(words_of(text.as_py()), size, known)
                at = -1
                if len(h):
                    at = sets.setdefault(set_id(h), len(hashes))
                    if at == len(hashes):
                        hashes.append(h)
                        n += len(h)
                ids.append(doc_id)
                of.append(at)
                if n >= tuning.block or len(hashes) >= MOST_SETS or len(ids) >= MOST_DOCS:
                    yield flush(block, sets, hashes, ids, of)
                    sets, hashes, ids, of, n, block = {}, [], [], [], 0, block + 1
        if ids:
            yield flush(block, sets, hashes, ids, of)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy_batches(run), POSTINGS)


def _rows(group: pa.Table) -> list[dict]:
    return group.to_pylist()


def _open(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row's place in `rows`, number of the set in its block, token, order and holders of each posting."""
    owner, at, tokens, classes, holders = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, U)], [np.empty(0, np.uint8)], [np.empty(0, U)]
    for i, r in enumerate(rows):
        if r["base"] == ABOUT or r["block"] == MARK:
            continue
        mine = from_planes(r["at"])
        owner.append(np.full(len(mine), i))
        at.append(mine)
        tokens.append(expand(r["tokens"], 8) if r["base"] == HEAVY else expand(r["tokens"], 5) | (U(r["base"]) << U(40)))
        classes.append(np.frombuffer(r["classes"], np.uint8) if r["classes"] else np.full(len(mine), LAST, np.uint8))
        holders.append(expand(r["ids"], 5) if r["ids"] else tokens[-1] & LOW40)
    return tuple(np.concatenate(a) for a in (owner, at, tokens, classes, holders))


def _bucket(sets: np.ndarray, buckets: int) -> np.ndarray:
    return (((sets.astype(U) >> U(40)) * U(buckets)) >> U(24)).astype(np.int64)


def _classify(postings: DataFrame) -> DataFrame:
    """Postings of shingles that have two or more, with their class and holders (as ids), by block. Holders: 20 bits of the least hash of a set that holds the shingle,
    20 bits of all those sets' hashes; a heavy shingle's are not known, it stands for them itself. Shingles of more than TOGETHER sets differ in the former too."""

    def run(group: pa.Table) -> pa.Table:
        rows = _rows(group)
        key = rows[0]["key"]
        if key < 0:
            return group
        marks = [np.frombuffer(r["tokens"], U) for r in rows if r["block"] == MARK]
        heavy = np.unique(np.concatenate(marks)) if marks else np.empty(0, U)
        owner, at, tokens, _, _ = _open(rows)
        order = np.argsort(tokens)
        t = tokens[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.empty(0, np.int64)
        runs = np.diff(np.append(first, len(t)))
        is_heavy = np.isin(t[first], heavy)
        keep = np.repeat((runs > 1) | is_heavy, runs)
        kinds = np.repeat(np.where(is_heavy, LAST, np.ceil(np.log2(np.maximum(runs, 1)))).astype(np.uint8), runs)[keep]
        place = mix(mix(np.array([r["block"] for r in rows], np.int64).astype(U))[owner] + at.astype(U))
        every, least = (f.reduceat(place[order], first) if len(first) else place for f in (np.add, np.minimum))
        apart = every % np.maximum(runs[: len(first)] // TOGETHER, 1).astype(U)
        held = (mix(least + apart) >> U(44) << U(20)) | (mix(every) >> U(44))
        holders = np.repeat(np.where(is_heavy, t[first] & LOW40, held), runs)[keep]
        chosen = order[keep]
        back = np.lexsort((at[chosen], owner[chosen]))
        chosen, kinds, holders = chosen[back], kinds[back], holders[back]
        who = owner[chosen]
        starts = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.empty(0, np.int64)
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(who)], strict=True) if len(who) else ():
            block, mine = rows[int(who[lo])]["block"], chosen[lo:hi]
            out.append([-1 - block, block, key, planes(at[mine]), squeeze(tokens[mine], 5), kinds[lo:hi].tobytes(), squeeze(holders[lo:hi], 5), b""])
        return pa.Table.from_batches([_arrow(out)])

    return postings.groupBy("key").applyInArrow(tidy_group(run), POSTINGS)


#: Sets with a shingle up to which its signatures go where those of the same least holder go (with more sets to some places), and places of pairs.
TOGETHER, PLACES = 1024, 4


def _dealt(least: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Signatures with the 20 bits of `least` as the high ones, by which they are dealt to ranges."""
    return (least << U(44)) | (signatures >> U(20))


def prefix_signatures(n: int, tokens: np.ndarray, n_rare: int, share: int, groups: int, holders: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set of n shingles; `tokens`: those in two sets or more in global order, the first `n_rare` of class 1; `holders`: what signatures are made of, if not tokens."""
    least = -(-share * n // 100)
    need = n - least + 1 - (n - len(tokens))  # losses that the listed shingles must stand, class 0 has taken the rest
    if need <= 0:
        return np.empty(0, U)
    small = -(-groups * 100 // share)  # sets up to this size have least <= groups
    holders = tokens if holders is None else holders
    rare = holders[: min(need, n_rare)]
    singles = [_dealt(rare >> U(20), mix(rare))]
    pairs = []
    if need > n_rare:
        frequent, missing = tokens[n_rare:], need - n_rare
        if n <= -(-small * 100 // share):
            singles.append(mix(holders[n_rare:][:missing]))
        if least > groups:
            group = (frequent % U(groups)).astype(np.int64)
            firsts = np.zeros(len(frequent), bool)
            _, at = np.unique(group, return_index=True)
            firsts[at] = True
            stands = np.cumsum(~firsts)
            end = int(np.searchsorted(stands, missing)) + 1
            for g in range(groups):
                mine = holders[n_rare:][:end][group[:end] == g]
                i, j = np.triu_indices(len(mine), 1)
                pairs.append(_dealt(mix((mine[i] >> U(20)) + U(g % PLACES)), mix(mix(mine[i]) * MULTIPLIER + mine[j])))
    return np.unique(np.concatenate([*singles, *pairs]))


SETS = "kind int, key long, sets binary, sizes binary, counts binary, tokens binary, set_id long, n long"
KINDS = [pa.int32(), pa.int64()] + [pa.binary()] * 4 + [pa.int64()] * 2


def _sign(postings: DataFrame, buckets: int, width: int, share: int, tuning: Tuning) -> DataFrame:
    """kind 0: a set with its shingles; 1: signatures, packed by range; 2: the members of a hot signature (key), packed; 3: documents with their number
    of shingles and set, packed (ids as sets, sizes, null ids as counts, sets as tokens)."""

    def run(group: pa.Table) -> pa.Table:
        rows = _rows(group)
        about = next(r for r in rows if r["base"] == ABOUT)
        set_ids, set_sizes, of = np.frombuffer(about["at"], np.int64), np.frombuffer(about["tokens"], np.int32), np.frombuffer(about["of"], np.int32)
        some = of >= 0
        sets_of, sizes_of = np.zeros(len(of), np.int64), np.zeros(len(of), np.int32)
        sets_of[some], sizes_of[some] = set_ids[of[some]], set_sizes[of[some]]
        _, at, tokens, classes, holders = _open(rows)
        order = np.lexsort((tokens, holders, classes, at))
        at, tokens, classes, holders = at[order], tokens[order], classes[order], holders[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(at)) if len(at) else first
        rare = np.add.reduceat((classes <= tuning.level).astype(np.int64), first) if len(first) else first
        sets, n = set_ids[at[first]], set_sizes[at[first]].astype(np.int64)
        able = (n - (ends - first)) < n + (-share * n // 100) + 1  # fewer shingles of its own than the losses it can have, and one
        out: list[list] = [[3, 0, about["ids"], sizes_of.tobytes(), about["classes"], sets_of.tobytes(), 0, 0]]
        sig_sets, sig_sizes, sigs = [], [], []
        for lo, hi, r, size, sid in zip(first[able].tolist(), ends[able].tolist(), rare[able].tolist(), n[able].tolist(), sets[able].tolist(), strict=True):
            found = prefix_signatures(size, tokens[lo:hi], r, share, tuning.groups, holders[lo:hi])
            if len(found):
                out.append([0, 0, b"", b"", b"", squeeze(np.sort(tokens[lo:hi]), width), sid, size])
                sig_sets.append(np.full(len(found), sid))
                sig_sizes.append(np.full(len(found), size))
                sigs.append(found)
        if sigs:
            s, z, g = np.concatenate(sig_sets), np.concatenate(sig_sizes), np.concatenate(sigs)
            order = np.lexsort((s, g))
            s, z, g = s[order], z[order], g[order]
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            runs = np.diff(np.append(starts, len(g)))
            hot = np.repeat(runs > tuning.hot, runs)
            head = np.zeros(len(g), bool)
            head[starts] = True
            flag = hot.astype(np.uint8)
            for lo, m in zip(starts[runs > tuning.hot].tolist(), runs[runs > tuning.hot].tolist(), strict=True):
                out.append([2, int(g[lo].astype(np.int64)), s[lo : lo + m].tobytes(), z[lo : lo + m].astype(np.int32).tobytes(), b"", b"", 0, 0])
            keep = ~hot | head
            s, z, g, flag = s[keep], z[keep], g[keep], flag[keep]
            where = _bucket(g.astype(np.int64), buckets)
            order = np.lexsort((s, where))
            s, z, g, flag, where = s[order], z[order], g[order], flag[order], where[order]
            cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True):
                mine = s[lo:hi]
                heads = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                counts = np.diff(np.append(heads, hi - lo)).astype(np.int32)
                out.append([1, int(where[lo]), mine[heads].tobytes(), z[lo:hi][heads].astype(np.int32).tobytes(), counts.tobytes(), g[lo:hi].tobytes() + flag[lo:hi].tobytes(), 0, 0])
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(KINDS)], names=[c.split()[0] for c in SETS.split(", ")])

    return postings.groupBy("key").applyInArrow(tidy_group(run), SETS)


def _documents(signed: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (null if empty) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, nulls, sets in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                n = np.frombuffer(sizes, np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(nulls, bool)), pa.array(n), pa.array(np.frombuffer(sets, np.int64), mask=n == 0)], names=["doc_id", "n_shingles", "set_id"])

    return signed.where("kind = 3").select("sets", "sizes", "counts", "tokens").mapInArrow(tidy_batches(run), "doc_id long, n_shingles long, set_id long")


#: Pairs of rows up to which a shingle's are counted one by one; pairs that are counted at once, about.
FEW_PAIRS, PAIRS_AT_ONCE = 2_000, 4 << 20
EDGES = "family long, hub long, hub_n long, member long, member_n long"


def _star(bucket: np.ndarray, hot: np.ndarray, sets: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Distinct edges from the first member of each run to the others. Buckets of one hub are a family; a hot bucket has several hubs, and is a family of its own."""
    runs = np.diff(np.append(starts, len(sets)))
    head = np.zeros(len(sets), bool)
    head[starts] = True
    hub = np.repeat(starts, runs)
    family = np.where(hot, mix(bucket.astype(U) ^ MIX1), mix(sets[starts].astype(U))).astype(np.int64)
    edges = [a[~head] for a in (np.repeat(family, runs), sets[hub], sizes[hub], sets, sizes)]
    order = np.lexsort((edges[3], edges[1], edges[0]))
    f, h, m = (edges[i][order] for i in (0, 1, 3))
    once = order[np.append(True, (f[1:] != f[:-1]) | (h[1:] != h[:-1]) | (m[1:] != m[:-1]))[: len(m)]]
    return [e[once] for e in edges]


def _buckets(signed: DataFrame) -> DataFrame:
    """Star edges of the buckets; of one range, each edge of a family once."""
    names = [c.split()[0] for c in EDGES.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        sets, sizes, sigs, flags = [], [], [], []
        for r in _rows(group):
            counts = np.frombuffer(r["counts"], np.int32)
            n = int(counts.sum())
            sets.append(np.repeat(np.frombuffer(r["sets"], np.int64), counts))
            sizes.append(np.repeat(np.frombuffer(r["sizes"], np.int32), counts))
            sigs.append(np.frombuffer(r["tokens"][: 8 * n], U))
            flags.append(np.frombuffer(r["tokens"][8 * n :], np.uint8))
        sets, sizes, sigs, flags = (np.concatenate(a) for a in (sets, sizes, sigs, flags))
        order = np.lexsort((sets, sigs))
        sets, sizes, sigs, flags = sets[order], sizes[order].astype(np.int64), sigs[order], flags[order]
        starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
        hot = np.maximum.reduceat(flags, starts) > 0
        # a set that is in several blocks has come from each
        new = np.append(True, (sigs[1:] != sigs[:-1]) | (sets[1:] != sets[:-1]))
        sets, sizes, sigs = sets[new], sizes[new], sigs[new]
        starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
        runs = np.diff(np.append(starts, len(sigs)))
        chosen = runs > 1
        rows = np.repeat(chosen, runs)
        begin = np.append(0, np.cumsum(runs[chosen]))[:-1]
        edges = _star(sigs[starts][chosen], hot[chosen], sets[rows], sizes[rows], begin) if len(begin) else [np.empty(0, np.int64)] * len(names)
        return pa.Table.from_arrays([pa.array(e, pa.int64()) for e in edges], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, s, z in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sets, sizes = np.frombuffer(s, np.int64), np.frombuffer(z, np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in _star(np.array([key]), np.array([True]), sets, sizes, np.array([0]))], names=names)

    return signed.where("kind = 1").select("key", "sets", "sizes", "counts", "tokens").groupBy("key").applyInArrow(tidy_group(run), EDGES).unionAll(signed.where("kind = 2").select("key", "sets", "sizes").mapInArrow(tidy_batches(local), EDGES))


def _verified(pairs: DataFrame, sets: DataFrame, width: int, share: int) -> DataFrame:
    """Of distinct pairs (a, a_n, b, b_n) those that link: (a, b). sets: set_id, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, an, bn, ta, tb = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(a)):
                both = len(np.intersect1d(expand(ta[i], width), expand(tb[i], width), assume_unique=True))
                if 100 * both >= share * (an[i] + bn[i] - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    fit = pairs.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * share)
    left = fit.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb")), "b")
    both = left.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), "a")
    return both.select("a", "b", "a_n", "b_n", "ta", "tb").mapInArrow(tidy_batches(run), "a long, b long")


def _across(members: DataFrame, sets: DataFrame, width: int, share: int, tuning: Tuning) -> DataFrame:
    """Links (a, b) that join different components of a family (family, node, n, root, main, size): a spanning part of all there are.

    The members that are not in the family's main component are compared with all members, block against block;
    what is held at once has `compared` rows on either side and a few thousand shingles.
    """

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["side"] == 1] if key[1] != key[2] else pdf[pdf["root"] != pdf["main"]]
        right = pdf[pdf["side"] == 0]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        both = pd.concat([left, right])
        tokens = [expand(t, width) for t in both["tokens"]]
        rows = np.repeat(np.arange(len(both)), [len(t) for t in tokens])
        _, column = np.unique(np.concatenate(tokens), return_inverse=True)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        is_left, n_columns, n_right = rows < len(left), column[-1] + 1, len(right)
        n_pairs = np.bincount(column[is_left], minlength=n_columns) * np.bincount(column[~is_left], minlength=n_columns)
        shared = np.zeros((len(left), n_right), np.float32)
        # shingles of few rows: their pairs are counted one by one, some at once
        few = (n_pairs[column] > 0) & (n_pairs[column] <= FEW_PAIRS)
        lrows, lcolumn, rrows, rcolumn = rows[few & is_left], column[few & is_left], rows[few & ~is_left] - len(left), column[few & ~is_left]
        begin, end = np.searchsorted(rcolumn, lcolumn), np.searchsorted(rcolumn, lcolumn, side="right")
        done = np.append(0, np.cumsum(end - begin))
        for at in range(0, int(done[-1]), PAIRS_AT_ONCE):
            part = slice(*np.searchsorted(done, [at, at + PAIRS_AT_ONCE]).tolist())
            n = (end - begin)[part]
            mine = np.arange(n.sum()) + np.repeat(begin[part] - np.cumsum(n) + n, n)
            shared += np.bincount(np.repeat(lrows[part], n) * n_right + rrows[mine], minlength=shared.size).reshape(shared.shape)
        # shingles of many rows: products of matrices
        many = n_pairs > FEW_PAIRS
        kept = many[column]
        rows, column = rows[kept], (np.cumsum(many) - 1)[column[kept]]
        step = 4096
        for lo in range(0, int(many.sum()), step):
            part = slice(*np.searchsorted(column, [lo, lo + step]))
            m = np.zeros((len(both), step), np.float32)
            m[rows[part], column[part] - lo] = 1
            shared += m[: len(left)] @ m[len(left) :].T
        sizes = both["n"].to_numpy(np.float64)
        linked = 100.0 * shared >= share * (sizes[: len(left), None] + sizes[None, len(left) :] - shared)
        la, ra, lr, rr = left["node"].to_numpy(), right["node"].to_numpy(), left["root"].to_numpy(), right["root"].to_numpy()
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := top.get(x, x)) != x:
                top[x] = x = top.get(y, y)
            return x

        out = []
        for i in range(len(left)):
            at = np.flatnonzero(linked[i])
            _, once = np.unique(rr[at], return_index=True)
            for j in at[once].tolist():
                p, q = find(int(lr[i])), find(int(rr[j]))
                if p != q:
                    top[p] = q
                    out.append((int(la[i]), int(ra[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    n = F.ceil(F.col("size") / tuning.compared).cast("int")
    rows = members.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, F.col("node") == F.col("set_id"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_right = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(0).alias("side")))
    as_left = F.transform(F.filter(every, lambda j: j != F.col("block")), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(1).alias("side")))
    places = F.when(F.col("root") != F.col("main"), F.concat(as_right, as_left)).otherwise(as_right)
    placed = rows.select("family", "node", "n", "root", "main", "tokens", F.explode(places).alias("p")).select("family", "p.i", "p.j", "p.side", "node", "n", "root", "main", "tokens")
    return placed.groupBy("family", "i", "j").applyInPandas(tidy_group(compare), "a long, b long").distinct()


def _generated(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) for each of the pairs of columns in each row."""
    made = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return rows.select(F.explode(made).alias("e")).select("e.*")


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """node, root (the least node of its component) of all nodes in `links` (a, b) but the roots themselves.

    Alternating stars: each node's neighbours are linked to the least of them, first the larger ones, then the
    smaller ones, until nothing changes; rounds grow with the logarithm of a component's size, and it is an error if
    `max_rounds` aren't enough. Each round is written, so a lost executor costs no earlier round.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        every = _generated(edges, ("u", "v"), ("v", "u"))
        least = every.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = every.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        edges = written(_generated(small, ("v", "m"), ("u", "m")).where("u <> v").distinct(), "star")
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


def jaccard_components(docs: DataFrame, size: int = 5, share: int = 75, tuning: Tuning | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, its own included) of each row of `docs` (doc_id, text).

    share: links need 100 * intersection >= share * union. Null texts and texts without words have no shingles and
    link with nothing, not with each other either: component_id is their own doc_id. Repeated rows stay and are one
    component. A row with a null doc_id has the component of its set; if no row of the component has an id, null.
    An empty table has no rows; more columns are not looked at. `docs` is a table, or has the same rows in the same
    partitions and order if a lost one is made again.
    """
    # five letters and a blank to a word: this decides sizes only
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    tuning = (tuning or Tuning()).fitted(total)
    ranges = max(1, -(-total // tuning.range))
    width = 5 + max(1, (max(1, ranges - 1).bit_length() + 7) // 8)
    signed = written(_sign(_classify(_index_blocks(docs, size, ranges, tuning)), ranges, width, share, tuning), "signed", ["kind"])
    info = _documents(signed)
    # a set that is in several blocks has come from each
    sets = written(signed.where("kind = 0").groupBy("set_id").agg(F.first("tokens").alias("tokens")), "sets")
    stars = written(_buckets(signed), "stars")
    tried = stars.groupBy("hub", "member").agg(F.max("hub_n").alias("a_n"), F.max("member_n").alias("b_n")).withColumnsRenamed({"hub": "a", "member": "b"})
    links = written(_verified(tried, sets, width, share), "verified")
    roots = components(links)
    # the buckets of one hub are a family, as they have mostly the same members; of interest are those with a member that didn't link to the hub
    failed = stars.join(links, (F.col("hub") == F.col("a")) & (F.col("member") == F.col("b")), "left_anti").select("family").distinct()
    pair = F.explode(F.array(F.struct(F.col("member").alias("node"), F.col("member_n").alias("n")), F.struct(F.col("hub").alias("node"), F.col("hub_n").alias("n"))))
    members = stars.join(failed, "family", "left_semi").select("family", pair.alias("m")).select("family", "m.*").distinct()
    members = written(members.join(roots, "node", "left").select("family", "node", "n", F.coalesce("root", "node").alias("root")), "members")
    main = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most")).where("most < size")
    # a row for each family: in a table of its own, so that a large family's members needn't come to where these were made
    main = written(main.select("family", "main", "size"), "families")
    more = written(_across(members.join(maybe_broadcast(main, 48 * main.count()), "family"), sets, width, share, tuning), "verified")
    if more.limit(1).count():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    # one row for each set first, so that a set that a third of all rows have is one row in what follows
    of_set = written(info.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least")).join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root")), "of-sets")
    # in a table of its own, so that the sets of a large component needn't come to where its least id was found
    of_root = written(of_set.groupBy("root").agg(F.min("least").alias("component_id")), "of-roots")
    named = of_set.join(of_root, "root").select("set_id", "component_id")
    return info.join(named, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
