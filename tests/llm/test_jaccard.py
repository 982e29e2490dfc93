import random

import numpy as np
import pytest

from tabulon.llm import jaccard
from tabulon.llm.common import written
from tabulon.llm.jaccard import Tuning, WordHashes, components, from_planes, jaccard_components, planes, prefix_signatures, shingles, words_of


def brute(rows, size=5, share=75):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    common = [rng.choices(vocabulary, k=40) for _ in range(2)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randrange(12))]
        elif kind < 0.75:
            w = rng.choice(common) + rng.choices(vocabulary, k=rng.randrange(20))
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 12, 30, 60, 120]))
        texts.append(" ".join(w))
    return [(i + 10, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "tuning"), [(1, Tuning()), (2, Tuning(frequent=1, groups=2, hot=3, block=500, range=900, compared=5)), (3, Tuning(frequent=4, groups=4, hot=5, block=2000, range=4000, compared=20))])
def test_against_all_pairs(spark, seed, tuning):
    rows = corpus(seed, 220)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tuning=tuning).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("few", [0, 3])
def test_families_by_matrices(spark, monkeypatch, few):
    """Shingles of more rows than that are counted by products of matrices, with the same result."""
    monkeypatch.setattr(jaccard, "FEW_PAIRS", few)
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 7)
    rows = corpus(7, 150)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tuning=Tuning(frequent=1, groups=2, hot=3, block=500, range=900, compared=8)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_edges_of_the_contract(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (5, "a  B"), (6, "a b c"), (8, long), (7, long + " end"), (9, "a\x0bb"), (12, " a b")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, set_id string")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_id_takes_its_component(spark):
    t = "one two three four five six"
    got = jaccard_components(spark.createDataFrame([(None, t), (3, t), (None, "seven")], "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(1, None), (2, 3)]


def test_common_in_every_block_but_rare_in_each(spark):
    """A passage that is in all blocks, in few sets of each, is handled where it is found, so it never meets in one task."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(160):
        own = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(4, 30)))
        rows.append((i, f"{own} {passage}" if i % 4 == 0 else own))
    tuning = Tuning(frequent=64, groups=2, hot=64, block=150, range=300, compared=10, largest=150)
    total = sum(len(t) for _, t in rows) // 6
    fitted = tuning.fitted(total)
    blocks = total // fitted.block + 1
    assert blocks >= 20 and fitted.heavy * blocks <= max(fitted.range, 2 * blocks) and fitted.hot == fitted.heavy < 64
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), tuning=tuning).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_edges_do_not_grow_with_the_ranges(spark, monkeypatch):
    """Near copies share many signatures; hub and member are a row or a few, however many ranges the signatures are dealt to."""
    rng = random.Random(4)
    rows = []

    def near(n):
        w = [f"w{rng.randrange(9000)}" for _ in range(120)]
        for _ in range(n):
            own = list(w)
            own[rng.randrange(120)] = "other"
            rows.append((len(rows), " ".join(own)))

    for _ in range(40):
        near(2)
    near(30)
    stars = {}

    def kept(df, name, *more):
        out = written(df, name, *more)
        if name == "stars":
            stars[ranges] = out.select("hub", "member").collect()
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for ranges, tuning in [("one", Tuning(frequent=8, groups=2)), ("many", Tuning(frequent=8, groups=2, range=250, largest=250))]:
        got = jaccard_components(df, tuning=tuning).collect()
        assert sorted(tuple(r) for r in got) == brute(rows)
    one, many = stars["one"], stars["many"]
    assert len(many) <= 4 * len(set(many)) and len(many) <= 4 * len(one)


def test_columns_named_like_internal_ones(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]
    names = ["key", "block", "base", "at", "tokens", "set_id", "n", "hub", "member", "family", "root", "node", "kind", "component_id", "n_shingles"]
    df = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_components_settle_or_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(1, 201)}
    with pytest.raises(RuntimeError):
        components(chain, max_rounds=2)


def test_planes():
    at = np.sort(np.random.default_rng(1).integers(0, 65535, 500))
    assert (from_planes(planes(at)) == at).all() and len(from_planes(planes(at[:0]))) == 0


def test_prefixes_of_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        lose = int(rng.integers(0, len(x) // 4 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[lose:], rng.integers(0, 1 << 60, int(rng.integers(0, 3)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        rare = lambda t: t % np.uint64(3) == 0
        signed = [prefix_signatures(len(s), np.concatenate([s[rare(s)], s[~rare(s)]]), int(rare(s).sum()), 75, 4) for s in (x, y)]
        assert len(np.intersect1d(*signed))


def test_short_texts_are_one_shingle():
    known = WordHashes()
    assert len(shingles(words_of("a b"), 5, known)) == 1
    assert len(shingles(words_of("a b c d e f"), 5, known)) == 2
