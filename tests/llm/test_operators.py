"""Each operator against a brute-force form on small fixtures, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import chat, decontaminate, language, licenses, packing, rollup, tokens, topk, toxicity, url_filter
from tabulon.llm.common import shared_dir

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def prose(rng, n, words=300):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(words)) for _ in range(n))


# url filter


def test_url_filter(spark):
    urls = ["http://A.example.NET/en/x?y", "https://example.net/fr/", "http://m.example.com/de/1#t", "http://example.com/de", "http://x.org/fr/", "http://notexample.net.au/", "ftp://net/", "net/", None, "", "http://", "http://example.net", "http://a://net/en/", "http://EXAMPLE.com:80/de/", "x://net?/", "http://badnet/"]
    rows = [(i, u, "h") for i, u in enumerate([*urls, urls[0], "http://deep." * 50 + "net/" + "p" * 5000])]
    got = url_filter.judge_urls(frame(spark, rows, "page_id long, url string, host string"), spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string"))
    assert got.columns.count("host") == 1

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == sorted((i, *[x or "" for x in brute(u)]) for i, u, _ in rows)
    assert url_filter.judge_urls(frame(spark, rows[:2], "page_id long, url string, host string"), spark.createDataFrame([], "host string, path string, verdict string")).where("verdict = 'allow'").count() == 2


def test_url_filter_beside_columns_of_its_names(spark):
    """Extra columns named like what the operator makes itself, and a list of many shapes."""
    names = ["best", "rule_host", "rule_path", "rule_verdict", "block", "c", "w0", "nl", "n", "verdict", "a.b"]
    pages = spark.createDataFrame([(1, "http://x.net/a/b", *names), (2, None, *names), (2, None, *names)], "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names))
    listed = spark.createDataFrame([("net", "/", "block"), *[("a." * i + "net", "/" + "p" * j, "allow") for i in range(6) for j in range(40)]], "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, listed)
    assert [c for c in got.columns if c not in ("host", "path", "rule", "verdict")] == ["page_id", "url", *[n for n in names if n != "verdict"]]
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r["a.b"]) for r in got.collect()) == [(1, "x.net", "/a/b", "net/", "block", "a.b")] + [(2, "", "", None, "allow", "a.b")] * 2


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit("/a").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit("/abc")).alias("url"))
    got = url_filter.judge_urls(pages, listed)
    assert got.where("verdict = 'block'").agg(F.count("*"), F.max("page_id")).first()[:] == (3000, 2999)


# packing and tokens


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = ["", " ", "  two  spaces ", "a\n b\t c\r\n", "x" * 5000, "tail ", " lead", "a\u00a0 b  c", "<|endoftext|> mid <|endoftext|>", "don't we'll\n\n\n  it", "\u4f60\u597d \U0001f600 \u00e9t\u00e9", "1,234.5 6", "a \n \n b"]
    return odd + [prose(rng, rng.choice([1, 5, 40, 300, 1500])) for _ in range(60)]


def test_ids_are_those_of_the_tokenizers_file(texts):
    from tokenizers import Tokenizer

    vocabulary = tokens.default_vocabulary()
    whole, mine = Tokenizer.from_file(vocabulary.json_path), tokens.ByteBpe(vocabulary)
    for t in texts:
        assert np.frombuffer(mine.encode_bytes(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:50]


def test_packing(spark, texts):
    rows = [(i, t) for i, t in enumerate([*texts, None, texts[20], texts[20]])]
    got = packing.pack(frame(spark, rows)).toPandas()
    encoder = tokens.ByteBpe(tokens.default_vocabulary())
    for i, t in rows:
        ids = encoder.encode_bytes(t or "") + bytes(4)
        mine = got[got.doc_id == i].sort_values("start")
        assert (mine.doc_tokens == len(ids) // 4).all() and mine.start.tolist() == np.append(0, mine.length.cumsum()[:-1]).tolist() and mine.length.sum() == len(ids) // 4
        assert [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 1024 and sorted(fill.index) == list(range(len(fill)))
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_plan_packs():
    rng = random.Random(1)
    for size in (1, 8, 64, 1024):
        for _ in range(30):
            counts = {rng.randint(1, size): rng.randint(1, 10**rng.randint(0, 6)) for _ in range(rng.randint(0, 60))}
            packs = packing.plan_packs(counts, size)
            used = Counter()
            for pattern, n in packs:
                assert n > 0 and sum(pattern) <= size
                for length in pattern:
                    used[length] += n
            assert used == Counter(counts)
            # no sequence but one can be half empty while another could have taken its pieces
            if counts:
                assert sum(n for p, n in packs if 2 * sum(p) <= size) <= 1


# decontamination


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 30]), 20)) for i in range(30)] + [(90, None), (91, ""), (92, "..."), (5, prose(rng, 12, 20)), (93, "\u00e9l\u00c9 X1")]
    rows = []
    for i in range(80):
        t = prose(rng, rng.choice([0, 1, 9, 40, 200]), 20)
        if rng.random() < 0.5:
            t += ", " + items[rng.randrange(30)][1].upper().replace(" ", ";\n") + "! " + prose(rng, 3, 20)
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (202, rows[3][1]), (203, prose(rng, 50_000, 20)), (204, "\u00e9l\u00c9 x1")]
    windows = {}
    for i, t in items:
        w = decontaminate.words_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}

    def brute(t):
        w, hit, found = decontaminate.words_of(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if (x := tuple(w[k : k + n])) in windows and len(x) == n:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *brute(t)) for i, t in rows)
    assert sorted(tuple(r) for r in decontaminate.summary(decontaminate.find_leaks(frame(spark, rows), bench)).collect()) == want
    assert decontaminate.find_leaks(spark.createDataFrame([], DOCS), bench).count() == 0
    assert not decontaminate.summary(decontaminate.find_leaks(frame(spark, rows[:5]), bench.limit(0))).where("contaminated").count()
    assert decontaminate.words_of("A-b\x80C") == [b"a", b"b\xc2\x80c"]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_decontamination_in_blocks(spark, monkeypatch, parts):
    """Several blocks of the benchmark, with repeated rows, null and repeated ids, and segments of one row each."""
    items = [(i, f"w{i} x{i} y{i}") for i in range(20)] + [(None, "n0 n1"), (3, "z0 z1"), (3, "z0 z1"), (3, "w5 x5 y5")]
    rows = [(i, f"a w{i} x{i} y{i} b w{i + 1} x{i + 1} y{i + 1}") for i in range(10)]
    rows += [rows[2]] * 3 + [(None, rows[4][1]), (None, "w9 x9 y9 a a a a"), (None, ""), (None, None), (None, ""), (7, "c c c c c c c c"), (7, "w1 x1 y1 c c c c c"), (30, "n0 n1"), (31, "n0 n1 z0 z1"), (32, "z0")]

    def brute(text):
        w, hit, found = (text or "").split(), set(), set()
        for item, t in items:
            x = t.split()
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(item)
        names = sorted(str(i) for i in found - {None})
        return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)

    order = lambda r: (r[0] is None, *map(str, r))
    want = sorted(((i, *brute(t)) for i, t in rows), key=order)
    schema = "item_id long, text string, row string"
    bench = spark.createDataFrame([(i, t, "r") for i, t in items], schema)
    docs = frame(spark, [(i, t, "r", "s") for i, t in rows], "doc_id long, text string, row string, segment string", parts)
    for size in (8 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        leaks = decontaminate.find_leaks(docs, bench)
        assert sorted((tuple(r) for r in decontaminate.summary(leaks).collect()), key=order) == want
        assert leaks.select("row").distinct().count() == len(rows)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = [(1, "red green blue"), (2, "blue x red y green"), (3, "red green"), (4, "red a b c d e f g green blue")]
    got = {r.doc_id: r for r in decontaminate.find_leaks(frame(spark, rows), bench, slack=2).collect()}
    assert [bool(got[i].items) for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert [bool(got[i].near_items) for i in (1, 2, 3, 4)] == [True, True, False, False]


# top-k


def brute_topk(rows, queries, k):
    vectors = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in vectors:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, []), (2040, [None] * 6), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (2100, [1.0, 2.0]), (2120, [2.0, 1.0]), (2140, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_topk(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert sorted(tuple(r) for r in topk.topk(df, df.where("vec_id % 20 = 0")).collect()) == want
    # small parts, pages and blocks: deep trees and many pairs of part and block
    vectors = topk.integer_vectors(df, "vec_id", "embedding", 64.0)
    asked = topk.integer_vectors(df.where("vec_id % 20 = 0"), "vec_id", "embedding", 64.0)
    found = topk.search_index(topk.build_index(vectors, len(rows), part=100, page=4), asked, 25, 20, block=5)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert topk.topk(df.limit(0), df.limit(0)).count() == 0


def test_parts_of_clusters_are_passed_over(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 5)) * 40
    rows = [(i, [float(x) for x in np.round(centres[i % 11] + rng.normal(size=5), 2)]) for i in range(900)] + [(2000 + i, [1.5, 2.5, -3.0, 4.0, 40.0]) for i in range(300)]
    names = ["part", "block", "dim", "cell", "least", "rank", "score", "id", "v"]
    df = spark.createDataFrame([(i, v, *names) for i, v in rows], "vec_id long, embedding array<float>, " + ", ".join(f"{n} string" for n in names))
    queries = {i for i, _ in rows if i % 20 == 0}
    vectors = topk.integer_vectors(df, "vec_id", "embedding", 64.0)
    asked = vectors.where("id % 20 = 0")
    index = topk.written(topk.build_index(vectors, len(rows), part=60, page=8), "test-index")
    parts = index.where("parent = -1").count()
    got = sorted(tuple(r) for r in topk.search_index(index, asked, len(queries), 10, block=30).collect())
    assert got == brute_topk(rows, queries, 10)
    bounds = spark.createDataFrame([(q, float(s)) for q, r, _, s in got if r == 10], "id long, least double")
    visited = topk._routed(index, asked, bounds, topk.FIRST).count()
    assert parts >= 20 and visited < 0.6 * len(queries) * (parts - topk.FIRST)


def test_mtree_bounds_hold_and_save_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 300
    v = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 5).astype(np.int64)
    norm2 = float((v.astype(float) ** 2).sum(1).max())
    nodes = {n["node"]: n for n in topk.build_pages(np.arange(4000), v, norm2, 32)}
    for n in nodes.values():
        if n["level"]:
            n["radii"] = np.array([nodes[i]["radius"] for i in n["ids"].tolist()])
        if n["parent"] >= 0:
            assert nodes[n["parent"]]["radius"] >= n["to_parent"] + n["radius"] - 1e-6
    root = next(i for i, n in nodes.items() if n["parent"] < 0)
    for q in range(0, 4000, 400):
        got, computed = topk.search_pages(nodes, root, norm2, q, v[q].astype(float), 5)
        s = v @ v[q]
        s[q] = np.iinfo(np.int64).min
        assert [(int(a), b) for a, b in got] == sorted(((int(s[i]), i) for i in range(4000) if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert computed < 4000


# toxicity


def toxic_corpus(n=600, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        w = [f"word{rng.randrange(2000)}" for _ in range(rng.randrange(20, 80))]
        if bad:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vileness", "gruesome", f"hatef{rng.randrange(500)}"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    rows += [(9000, None), (9001, ""), (9002, "x " * 30_000), (9003, rows[0][1]), (9003, rows[0][1])]
    df = spark.createDataFrame([(i, t, 7.0) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5], "doc_id long, toxic int"))
    got = toxicity.classify(df, model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    truth = dict(labels)
    held = got[[int(i) in truth and zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in got.doc_id]]
    assert (held.predicted == [truth[int(i)] for i in held.doc_id]).mean() > 0.95
    empty = got[got.doc_id.isin([9000, 9001])]
    assert empty.score.nunique() == 1 and (empty.predicted == 0).all()
    held_col = df.select(toxicity.held_out(F.col("doc_id")).alias("h"), "doc_id").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held_col)


@pytest.mark.parametrize("share", [0.0, 0.05, 2.0])
def test_block_max_search_is_exact(share):
    rng = np.random.default_rng(8)
    vocabulary = toxicity.Vocabulary(np.sort(toxicity.hashed(" ".join(f"t{i}" for i in range(200)))[0]), np.empty(0, np.uint64), rng.uniform(1, 6, 200), 1.0)
    common = rng.permutation(200) ** 2 // 200
    make = lambda: vocabulary.unit(toxicity.hashed(" ".join(f"t{t}" for t in [900, *common[rng.integers(0, 200, rng.integers(0, 8))]][rng.integers(0, 2) :])))
    examples = [(i, int(rng.integers(0, 2)), i // 3, *make()) for i in range(700)]
    index = toxicity.BlockMaxIndex.of(examples, 200, share)
    dense = np.zeros((700, 200))
    for p, i in enumerate(index.ids.tolist()):
        dense[p, examples[i][3]] = examples[i][4]
    queries = [make() for _ in range(60)]
    for left_out in (False, True):
        for i, got in enumerate(index.nearest(queries, 15, list(range(60)) if left_out else None)):
            t, w = queries[i]
            q = np.zeros(200)
            q[t] = w
            s = np.round(dense @ q, 10)
            if left_out:
                s[index.family == i] = -1
            want = np.array([i for i in np.lexsort((np.arange(700), -s))[:15] if s[i] > 0], int)
            assert np.allclose([c for c, _ in got], s[want]) and (not got or {p for c, p in got if c > s[want[-1]] + 1e-8} == {int(p) for p in want if s[p] > s[want[-1]] + 1e-8})
    few = toxicity.BlockMaxIndex.of(examples[:9], 200, share)
    assert all(len(got) <= 9 for got in few.nearest(queries, 15)) and few.nearest([], 15) == [] and toxicity.BlockMaxIndex.of([], 200).nearest(queries[:1], 15) == [[]]


def test_hashed_words(monkeypatch):
    texts = ["", "a", " Ünder_score été, naïve Straße abcde abcdef ab-cd 12345 x", "wörter und wörter, réeuxan réeuxlo", None, "日本語テキスト mixed日本", "y" * 3000 + " z"]
    seen: dict = {}
    for piece in (1 << 20, 16):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for text in texts:
            words = toxicity.words_of(text)
            assert words == re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())
            h, heads = toxicity.hashed(text)
            assert [seen.setdefault(w, x) for w, x in zip(words, h.tolist(), strict=True)] == h.tolist()
            for n, (x, at) in zip(toxicity.PREFIXES, heads, strict=True):
                assert at.tolist() == [i for i, w in enumerate(words) if len(w) > n]
                assert [seen.setdefault("^" + words[i][:n], y) for i, y in zip(at.tolist(), x.tolist(), strict=True)] == x.tolist()
    assert len(set(seen.values())) == len(seen)


def test_rare_toxic_words_go_with_the_label(spark):
    """A word in 5 of 113 toxic and in no clean example of 1000 (chi-square 31) does, one in 3 (14) does not; all words are terms."""
    rows = [(i, f"common word{i} " + ("rareone " if i < 5 else "") + ("raretwo" if 5 <= i < 8 else "")) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i < 113)) for i in range(1000)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    assert len(model.vocabulary.words) == len({w for _, t in rows for w in t.split()})
    strong = set(model.strong.values())
    assert "rareone" in strong and "raretwo" not in strong


def test_toxicity_against_brute_force(spark):
    rows, labels = toxic_corpus(400, 5)
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40, 3)] + [(2000, None), (2001, "entirely other words nowhere seen"), (2002, "nasty")]
    known = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(list(known.items()), "doc_id long, toxic int"), max_calibration=10_000)
    got = {r.doc_id: r for r in toxicity.classify(frame(spark, rows), model).collect()}

    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in rows}
    heads = lambda w: ["^" + w[:n] for n in (4, 5) if len(w) > n]
    every = {i: {t for w in ws for t in (w, *heads(w))} for i, ws in words.items()}
    n = [sum(y == k for y in known.values()) for k in (0, 1)]
    strong = set()
    for t in set().union(*(every[i] for i in known)):
        a, b = (sum(t in every[i] for i, y in known.items() if y == k) for k in (1, 0))
        below = (a + b) * (sum(n) - a - b) * n[0] * n[1]
        if a + b >= 3 and below and max(abs(a * (n[0] - b) - b * (n[1] - a)) - sum(n) / 2, 0) ** 2 * sum(n) / below >= 24:
            strong.add(t)
    assert strong and strong == set(model.strong.values())
    held = {w for i in known for w in words[i]}
    idf = lambda t: math.log((len(rows) + 1) / (sum(t in e for e in every.values()) + 1)) + 1
    weight = {t: idf(t) * (1 if t in strong else 0.1) for t in held | strong}
    unknown = 0.1 * (math.log(len(rows) + 1) + 1)

    def vector(i):
        counts = Counter(words[i]) + Counter(h for w in words[i] for h in heads(w) if h in strong)
        v = {t: (1 + math.log(c)) * weight.get(t, unknown) for t, c in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    vectors = {i: vector(i) for i in every}
    for i, r in got.items():
        cosines = sorted((sum(x * vectors[j].get(t, 0.0) for t, x in vectors[i].items()) for j in known), reverse=True)[:15]
        cosines = [c for c in cosines if c > 1e-9]
        assert len(cosines) == len(r.near_cosines) and np.allclose(cosines, r.near_cosines, atol=1e-8)
        near = dict(zip(r.near_ids, r.near_cosines, strict=True))
        votes = [(1 / (2 - 2 * min(1, c) + 0.05), known[j]) for j, c in near.items()]
        vote = sum(v * y for v, y in votes) / sum(v for v, _ in votes) if votes else sum(known.values()) / len(known)
        assert r.near_labels == [known[j] for j in r.near_ids] and math.isclose(r.score, model.score(vote), abs_tol=1e-9)


def test_toxicity_without_examples_or_rows(spark):
    df = spark.createDataFrame([(1, "a b")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(df, none)
    assert toxicity.classify(df, model).first().predicted == 0
    assert toxicity.classify(spark.createDataFrame([], DOCS), model).count() == 0


# language


LANGS = {"xx": ["kar", "lom", "tis", "ner"], "yy": ["ube", "oji", "aqu", "eza"]}


def lang_text(rng, lang, n):
    return " ".join("".join(rng.choices(LANGS[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(6)
    docs = [(i, lang_text(rng, lang, 60), lang) for i, lang in enumerate(["xx", "yy"] * 40)] + [(200, None, "xx"), (201, "abc", None), (202, "", "")]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3))
    assert model.languages == ["xx", "yy"]
    pages, truth = [], {}
    for i in range(60):
        lang = "xx" if i % 3 else "yy"
        truth[i] = lang
        body = "" if i % 10 == 0 else f"<script>{lang_text(rng, 'yy', 9)}</script><p>{lang_text(rng, lang, 30)}</p><!-- {lang_text(rng, 'xx', 9)} -->"
        pages.append((i, f"a.{lang}.example", lang, lang if i % 4 else None, f"<html>{body}</html>"))
    pages += [(900, None, None, None, None), (901, "new.host", "zz", "??", "<p>1 2 3</p>"), (902, *pages[1][1:]), (902, *pages[1][1:])]
    df = spark.createDataFrame(pages, "page_id long, host string, suffix string, declared string, html string").repartition(3)
    got = language.identify(df, model, ["page_id"], "html", "declared", "suffix", "host", is_markup=True).toPandas()
    assert len(got) == len(pages) and got.confidence.between(0, 1.0000001).all()
    for r in got.itertuples():
        if r.page_id in truth:
            # without text the page is told by its host, suffix and declaration
            assert r.lang == truth[r.page_id], r
    assert got[got.page_id == 900].text_lang.isna().all() and got[got.page_id == 900].n_trigrams.tolist() == [0]
    assert language.identify(df.limit(0), model, ["page_id"], "html", "declared", "suffix", "host").count() == 0
    assert model.log_likelihood("qqq www zzz xxx jjj kkk vvv")[1] < 0 < model.log_likelihood(lang_text(rng, "xx", 9))[1]


def test_every_language_is_known(spark, monkeypatch):
    """205 languages, the last five of one text each; scored as a full matrix would."""
    rng = random.Random(4)
    words = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(205)}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(lang for k, lang in enumerate(words) for _ in range(2 if k < 200 else 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = language.train(docs)
    assert model.languages == sorted(words) and model.sparse is not None
    monkeypatch.setattr(language, "DENSE", 300)
    full = language.train(docs)
    for _, text, lang in rows[::7] + rows[-5:]:
        a, b = model.log_likelihood(text), full.log_likelihood(text)
        assert np.allclose(a[0], b[0]) and abs(a[1] - b[1]) < 1e-9 and a[2] == b[2]
    got = language.identify(docs.withColumn("host", F.lit("a.example.org")), model, ["doc_id"], "text", declared="lang", host="host").collect()
    assert {r.doc_id: r.lang for r in got} == {i: lang for i, _, lang in rows}


def test_visible_text():
    assert language.visible_text("<style>a</style>x<b>y</b>&amp;<!-- z --><SCRIPT>q</SCRIPT >").split() == ["x", "y", "&"]
    assert language.visible_text(None) == ""


# chat


def test_chat(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    logs = {}
    for c in range(60):
        base = list(logs[rng.choice(list(logs))]) if logs and rng.random() < 0.6 else []
        base = base[: rng.randrange(1, len(base) + 1)] if base else []
        for _ in range(rng.randrange(0 if base else 1, 4)):
            base.append((rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, f"t{rng.randrange(50)}"])))
        logs[c] = base
        rows += [(c, i * 3, r, t, "x") for i, (r, t) in enumerate(base)]
    rows += [rows[0], (None, 0, "user", "lost", "x"), (500, None, "user", "no turn", "x"), (500, 1, "user", "then", "x")]
    rows += [(600, i, "user", f"m{i}", "x") for i in range(40)] + [(601, i, "user", f"m{i}", "x") for i in range(39)]
    logs[500], logs[600], logs[601] = [("user", "no turn"), ("user", "then")], [("user", f"m{i}") for i in range(40)], [("user", f"m{i}") for i in range(39)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string").repartition(4)
    monkeypatch.setattr(chat, "BLOCK", 8)
    got = {}
    for r in chat.format_chats(df).collect():
        got.setdefault(r.conv_id, {})[r.position] = (r.n_turns, r.rendered)
    keep = {c for c, log in logs.items() if not any((other[: len(log)] == log and len(other) > len(log)) or (other == log and d < c) for d, other in logs.items())}
    assert set(got) == keep
    for c in keep:
        want = {i + 1: (len(logs[c]), f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n") for i, (r, t) in enumerate(logs[c])}
        assert got[c] == want
    assert chat.format_chats(df.limit(0)).count() == 0


# rollup


def test_rollup(spark):
    r = rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-test-{random.random()}")
    state: Counter = Counter()
    rng = random.Random(5)
    schema = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long"
    for batch in range(6):
        rows = []
        for _ in range(30):
            op = rng.choice(["insert", "delete", "revise"])
            key, old = ((rng.choice(["s", "t", None]), rng.choice(["en", None]), "v1") for _ in range(2))
            n, m = rng.choice([0, 5, None, 9]), rng.choice([0, 3, None])
            rows.append((op, *key, n, *old, m))
            sign = -1 if op == "delete" else 1
            state[(*key, "d")] += sign
            state[(*key, "t")] += sign * (n or 0)
            if op == "revise":
                state[(*old, "d")] -= 1
                state[(*old, "t")] -= m or 0
        df = spark.createDataFrame(rows, schema)
        assert r.apply(f"b{batch}", df) and not r.apply(f"b{batch}", df)
        if batch == 3:
            r.compact()
            assert not r.apply("b1", df)
    got = {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    want = {k[:3]: (state[(*k[:3], "d")], state[(*k[:3], "t")]) for k in state}
    assert got == {k: v for k, v in want.items() if v != (0, 0)}
    with pytest.raises(Exception, match="unknown op"):
        r.apply("bad", spark.createDataFrame([("upsert", "s", "en", "v", 1)], "op string, source string, lang string, version string, tokens long"))
    assert r.apply("none", spark.createDataFrame([], schema)) and "bad" not in r.committed()
    with pytest.raises(ValueError):
        r.apply("../x", spark.createDataFrame([], schema))


def test_op4_against_plain_counts(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.op4_token_counts(spark, sf).collect()}
    one, many = tokens.ByteBpe(tokens.default_vocabulary()), tokens.ByteBpe(rollup.multilingual())
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    want: dict = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.doc_id not in toxic:
            v, e = ("byte_bpe_50k", one) if r.lang == "en" else ("byte_bpe_multi_50k", many)
            d, t = want.get((r.source, r.lang, v), (0, 0))
            want[(r.source, r.lang, v)] = (d + 1, t + e.count(r.text or ""))
    assert got == want


# licenses


def test_licenses(spark):
    rng = random.Random(4)
    apache = licenses.TEMPLATES["Apache-2.0-header"]
    words = apache.split()
    changed = " ".join(w if i % 12 else "CHANGED" for i, w in enumerate(words))
    dropped = " ".join(w for i, w in enumerate(words) if i % 15)
    rows = [(1, prose(rng, 50) + " " + apache + " " + prose(rng, 20)), (2, changed), (3, dropped), (4, prose(rng, 400)), (5, None), (6, ""), (7, "All rights reserved. x All RIGHTS reserved!"), (8, prose(rng, 30_000) + " Released under the MIT License."), (9, "all"), (9, "İ all rights reserved")]
    got = licenses.scan(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    text = dict(rows)
    (a,) = [r for r in by[1] if r.license == "Apache-2.0-header"]
    assert a.coverage == 1.0 and text[1][a.start_char : a.end_char] == apache.rstrip(".")
    for i in (2, 3):
        (m,) = [r for r in by[i] if r.license == "Apache-2.0-header"]
        assert 0.8 < m.coverage < 1 and m.end_word - m.start_word > 0.8 * len(words)
    assert 4 not in by and 5 not in by and 6 not in by
    assert [r.license for r in by[7]] == ["all-rights-reserved"] * 2 and [text[7][r.start_char : r.end_char] for r in by[7]] == ["All rights reserved", "All RIGHTS reserved"]
    assert [r.license for r in by[8]] == ["MIT"]
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, rows), {"short": "one"})


def whole_alignment(text, template):
    """Equal words of the best local alignment of a template, without a band."""
    score = np.zeros((len(text) + 1, 2), int)
    best = (0, 0)
    for w in template:
        new = np.zeros_like(score)
        for i, x in enumerate(text, 1):
            new[i] = max((score[i - 1, 0] + (2 if x == w else -1), score[i - 1, 1] + (x == w)), (score[i, 0] - 1, score[i, 1]), (new[i - 1, 0] - 1, new[i - 1, 1]), (0, 0))
        score = new
        best = max(best, tuple(score[score[:, 0].argmax()].tolist()))
    return best[1]


def test_license_recall(spark):
    """Of edited templates that an alignment without a band covers to 0.75 or more, 0.95 at least are found."""
    rng = random.Random(12)
    rows, of = [], []
    for name, text in sorted(licenses.TEMPLATES.items()):
        words = licenses.words_of(text)
        for rate in (0.0, 0.04, 0.08, 0.12, 0.16):
            edited = []
            for w in words:
                x = rng.random()
                edited += [] if x < rate / 3 else ["changed"] if x < 2 * rate / 3 else [w, "added"] if x < rate else [w]
            rows.append((len(rows), prose(rng, 8) + " " + " ".join(edited) + " " + prose(rng, 8)))
            of.append(name)
    found = {(r.doc_id, r.license) for r in licenses.scan(frame(spark, rows)).collect()}
    due = [(i, n) for (i, t), n in zip(rows, of, strict=True) if whole_alignment(licenses.words_of(t), w := licenses.words_of(licenses.TEMPLATES[n])) >= 0.75 * len(w)]
    assert len(due) >= 60 and len([x for x in due if x in found]) >= 0.95 * len(due)


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(100):
        t = rng.integers(0, 1 << 60, 30).astype(np.uint64)
        part = t[5 : 5 + licenses.GRAM + licenses.WINDOW - 1]
        text = np.concatenate([rng.integers(0, 1 << 60, 20).astype(np.uint64), part, rng.integers(0, 1 << 60, 20).astype(np.uint64)])
        assert np.intersect1d(licenses.fingerprints(t)[0], licenses.fingerprints(text)[0]).size


def test_long_templates_that_repeat_their_words(spark):
    """Stray anchors on many diagonals neither hide nor split a match, whole or with words changed and put in."""
    rng = np.random.default_rng(5)
    pairs = [f"p{i} q{i}" for i in range(30)]
    long = {n: " ".join(pairs[rng.integers(30)] if rng.random() < 0.7 else f"{n}{i}" for i in range(m)) for n, m in (("one", 700), ("two", 1500))}
    for n in ("Apache-2.0", "MPL-2.0", "GPL-3", "LGPL-2.1"):
        if os.path.exists(path := f"/usr/share/common-licenses/{n}"):
            long[n] = open(path, encoding="utf-8").read()
    names = sorted(long)
    changed = lambda words: " ".join(w if i % 20 else f"z{i} z{i}y" for i, w in enumerate(words))
    rows = [(i, "Before it. " + long[n] + " and after") for i, n in enumerate(names)]
    rows += [(100 + i, "Before it. " + changed(licenses.words_of(long[n])) + " " + long[n]) for i, n in enumerate(names)]
    by = {}
    for r in licenses.scan(frame(spark, rows), long).collect():
        by.setdefault((r.doc_id, r.license), []).append(r)
    for i, n in enumerate(names):
        words = len(licenses.words_of(long[n]))
        (m,) = by[i, n]
        assert (m.coverage, m.start_word, m.end_word) == (1.0, 2, 2 + words)
        assert sorted((r.coverage > 0.99, r.coverage >= 0.94) for r in by[100 + i, n]) == [(False, True), (True, True)]
