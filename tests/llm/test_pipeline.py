import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import decontaminate, jaccard, language, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [d.toPandas() for d in out]


def test_columns_and_order(stages):
    for kept in stages[1:-1]:
        assert list(kept.columns) == list(stages[0].columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]


def test_language_keeps_prose(stages):
    gone = set(stages[0].doc_id) - set(stages[1].doc_id)
    texts = stages[0].set_index("doc_id").text
    assert all(texts[i] is None or len(re.findall(r"[^\W\d_]{3,}", texts[i])) < 5 for i in gone)


def test_one_of_each_group_stays(stages):
    known = jaccard.WordHashes()
    sets = {i: set(jaccard.shingles(jaccard.words_of(t), 5, known).tolist()) for i, t in zip(stages[2].doc_id, stages[2].text, strict=True)}
    ids = sorted(sets)
    kept = set(stages[3].doc_id)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    assert kept == {i for i in ids if find(i) == i}


def test_no_passage_of_the_benchmark_is_left(stages, spark):
    p = decontaminate.Phrases.of([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()], 10)
    names = {n: w for w, n in p.terms.items()}
    windows = [b" ".join(names[t] for t in w) for w in p.windows]

    def leaks(text):
        flat = b" " + b" ".join(decontaminate.words_of(text)) + b" "
        return any(b" " + w + b" " in flat for w in windows)

    before = stages[3].set_index("doc_id").text
    assert set(stages[4].doc_id) == {i for i, t in before.items() if not leaks(t)}


def test_packed_whole(stages):
    encoder = tokens.ByteBpe(tokens.default_vocabulary())
    want = {i: encoder.count(t or "") + 1 for i, t in zip(stages[4].doc_id, stages[4].text, strict=True)}
    assert stages[5].groupby("doc_id").length.sum().to_dict() == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"


def brute_language(texts, langs):
    """For each text whether the language stage rejects it, from its trigrams counted one by one."""
    counts = {lang: Counter(x for t, l in zip(texts, langs, strict=True) if l == lang and t is not None for x in language.trigrams(t).tolist()) for lang in {*langs} - {None, ""}}
    totals = {lang: sum(c.values()) + language.BUCKETS for lang, c in counts.items()}
    out = []
    for t in texts:
        x = language.trigrams(t).tolist()
        gain = max((sum(math.log((c[i] + 1) / totals[lang]) for i in x) / len(x) + math.log(language.BUCKETS) for lang, c in counts.items()), default=0) if x else 0
        out.append(not x or (gain < 0 and len(x) >= corpus_pipeline.LEAST_TRIGRAMS))
    return out


def test_odd_documents(spark):
    """Null, empty and very long texts, null and repeated ids and repeated rows: which rows each stage keeps."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["ba", "ko", "li", "mer", "tun", "sa"], k=rng.randrange(1, 4)))
    text = lambda n=30: " ".join(word() for _ in range(n))
    clean = [text() for _ in range(6)]
    rows = [(1, None, None), (2, "", "en"), (2, "", "en"), (None, clean[0], "en"), (3, clean[1], "en"), (3, clean[1], "en"), (None, clean[2], ""), (4, "x" * 50_000, "en"), (5, text(20_000), "en"), (6, "1234 !!", "en"), (3, clean[3], None), (7, "zzqq xxvv wwjj qqzz vvxx jjww zqxv wjzq xvwj qzxj wvzx", None)]
    df = spark.createDataFrame([(i, t, lang, "s", 5, 0.5, "r") for i, t, lang in rows], ODD).repartition(2)
    of = lambda d: sorted((str(r.doc_id), str(r.text)) for r in d.collect())
    every = sorted((str(i), str(t)) for i, t, _ in rows)
    bad = brute_language([t for _, t, _ in rows], [lang for *_, lang in rows])
    out = corpus_pipeline.known_language(spark, df, SF)
    assert out.columns == df.columns and of(out) == sorted((str(i), str(t)) for (i, t, _), b in zip(rows, bad, strict=True) if not b)
    assert [t for (_, t, _), b in zip(rows, bad, strict=True) if b and t] == ["1234 !!", rows[-1][1]]
    out = corpus_pipeline.one_of_each_group(spark, df, SF)
    assert out.columns == df.columns
    assert Counter(of(out)) == Counter(every) - Counter([("3", clean[1])])
    out = corpus_pipeline.without_benchmark(spark, df, SF)
    assert out.columns == df.columns and of(out) == every
    pieces = corpus_pipeline.packed(spark, df, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    encoder = tokens.ByteBpe(tokens.default_vocabulary())
    want = Counter()
    for i, t, _ in rows:
        want[i] += encoder.count(t or "") + 1
    assert {r.doc_id: r.n for r in pieces} == dict(want)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).collect() == []


def test_toxicity_stage(spark, tmp_path):
    """What is kept is what the operator's own scores leave, by rows, with null and repeated ids; labels that are held out teach nothing."""
    rng = random.Random(4)
    prose = lambda: " ".join(f"word{rng.randrange(300)}" for _ in range(30))
    rows = [(i, prose() + (" nasty vileness" if i % 4 == 0 else "")) for i in range(300)]
    rows += [(None, prose()), (None, prose() + " nasty vileness nasty"), (5, prose() + " vileness nasty"), (5, rows[5][1]), (900, None), (901, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 5, 0.5, "r") for i, t in rows], ODD).repartition(3)
    taught = [(i, int(i % 4 == 0) if zlib.crc32(str(i).encode()) % 5 else 1 - int(i % 4 == 0)) for i in range(300)]
    spark.createDataFrame(taught, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.not_toxic(spark, df, str(tmp_path))
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter((i, t) for i, t in rows if "vileness" not in (t or ""))


def test_near_copies_with_null_and_repeated_ids(spark):
    base = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    near = lambda k, n: base[k] + f" tail{n}"
    rows = [(1, base[0]), (None, near(0, 1)), (None, base[1]), (None, "a clean text of its own"), (7, base[0]), (7, base[2]), (7, "another text that stands alone")]
    rows += [(None, near(3, i)) for i in range(3)] + [(9, near(4, 1)), (9, near(4, 2)), (5, base[5]), (5, base[5]), (None, base[1]), (None, None), (None, None), (8, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]

    distinct = sorted(rows, key=str)
    known = jaccard.WordHashes()
    sets = [set(jaccard.shingles(jaccard.words_of(t), 5, known).tolist()) for _, t in distinct]
    group = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 4 * both >= 3 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    order = lambda i: (i is None, i or 0)
    left = Counter(kept)
    for g in set(group):
        members = [r for r, x in zip(distinct, group, strict=True) if x == g]
        mine = [r for r in members if left[r] and order(r[0]) == min(order(i) for i, _ in members)]
        assert mine
        left[mine[0]] -= 1
    assert not +left and len(kept) == len(set(group))
