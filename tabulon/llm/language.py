"""Language by Bayesian evidence fusion.

log P(language | row) = text + declared + address suffix + host prior, up to a constant:

* text: likelihood of the letters' byte trigrams, hashed into BUCKETS, in a model trained on texts of known language.
  Trigrams overlap and repeat, so the mean log-likelihood counts as that of at most EVIDENCE independent ones.
* declared language (the markup's lang, or a column) and address suffix (a two-letter first path segment, else the
  top-level domain): P(value | language) from grouped counts of value against the text's language, smoothed.
* host prior: hierarchically smoothed counts of the text's language: host towards its domain, that towards its
  top-level domain, that towards all rows. A row's own text is taken out of its host's counts.

Counts come from grouped aggregation over all rows; the tables of values are joined, and broadcast only if small. Every
known language is in the model: it has languages * BUCKETS numbers, and of more than DENSE languages only those of the
buckets that a language has.
"""

from __future__ import annotations

import html as html_
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, table, tidy_batches
from .url_filter import url_parts

BUCKETS, EVIDENCE, SMOOTHING = 1 << 15, 40.0, 5.0
#: Languages up to which a model is a full matrix; and that a worker counts before it passes the counts on.
DENSE, AT_ONCE = 200, 64
#: Trigrams that are held before they are counted.
COUNTED = 1 << 20
#: Letters stay, all else is a space. Bytes from 0x80 are parts of letters.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
HIDDEN = re.compile(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>")


def visible_text(page: str | None) -> str:
    """The text of markup: no scripts, styles, comments or tags."""
    return html_.unescape(HIDDEN.sub(" ", page)) if page else ""


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each byte trigram with at least two letters."""
    if not text:
        return np.empty(0, np.uint16)
    b = np.frombuffer(b" " + text.lower().encode().translate(LETTERS) + b" ", np.uint8)
    letter = b != 32
    keep = letter[:-2].view(np.uint8) + letter[1:-1] + letter[2:] >= 2
    w = b.astype(np.uint32)
    code = (w[:-2] * np.uint32(0x9E3779B1) + w[1:-1] * np.uint32(0x85EBCA77) + w[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    return code[keep].astype(np.uint16)


@dataclass
class LanguageModel:
    languages: list[str]
    #: buckets x languages; of more than DENSE languages none
    log_p: np.ndarray | None
    #: of more than DENSE languages: each one's log-probability of a bucket it hasn't; where the buckets' entries begin, the entries' languages and what they add
    sparse: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    def log_likelihood(self, text: str | None) -> tuple[np.ndarray, float, int]:
        """Tempered log-likelihoods; the best language's mean gain over even odds, per trigram; the number of trigrams."""
        codes = trigrams(text)
        if not len(codes) or not self.languages:
            return np.zeros(len(self.languages)), 0.0, 0
        mean = self.log_p[codes].mean(axis=0) if self.sparse is None else self._sparse_mean(codes)
        return mean * min(float(len(codes)), EVIDENCE), float(mean.max() + np.log(BUCKETS)), len(codes)


    def _sparse_mean(self, codes: np.ndarray) -> np.ndarray:
        base, starts, langs, adds = self.sparse
        buckets, times = np.unique(codes, return_counts=True)
        first = starts[buckets]
        n = starts[buckets.astype(np.int64) + 1] - first
        at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        return base + np.bincount(langs[at], adds[at] * np.repeat(times, n), minlength=len(base)) / len(codes)


def train(docs: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """Trigram counts of all texts of known language; each language is smoothed by one count in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        parts: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def add() -> None:
            for lang, found in parts.items():
                counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(found), minlength=BUCKETS)
                rows[lang] = rows.get(lang, 0) + len(found)
            parts.clear()

        def counted() -> Iterator[pa.RecordBatch]:
            add()
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(c[at], rows[lang]))], names=["lang", "bucket", "n"])
            counts.clear()
            rows.clear()

        for batch in batches:
            for body, lang in zip(batch.column(0), batch.column(1), strict=True):
                codes = trigrams(body.as_py())
                parts.setdefault(lang.as_py(), []).append(codes)
                waiting += len(codes)
                if waiting >= COUNTED:
                    add()
                    waiting = 0
                if len(counts.keys() | parts.keys()) >= AT_ONCE:
                    yield from counted()
                    waiting = 0
        yield from counted()

    found = docs.select(F.col(text).alias("body"), F.col(language).alias("lang")).where("body is not null and lang is not null and lang <> ''").mapInArrow(tidy_batches(count), "lang string, bucket long, n long")
    sums = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in sums.where("bucket = -1").collect())
    at = {lang: i for i, lang in enumerate(languages)}
    counts = sums.where(F.col("bucket") >= 0).toLocalIterator()
    if len(languages) <= DENSE:
        matrix = np.ones((BUCKETS, len(languages)))
        for r in counts:
            matrix[r.bucket, at[r.lang]] += r.n
        return LanguageModel(languages, np.log(matrix / matrix.sum(axis=0)) if languages else matrix)
    buckets, langs, n = array("H"), array("i"), array("d")
    for r in counts:
        buckets.append(r.bucket)
        langs.append(at[r.lang])
        n.append(r.n)
    buckets, langs, n = np.frombuffer(buckets, np.uint16), np.frombuffer(langs, np.int32), np.frombuffer(n)
    order = np.lexsort((langs, buckets))
    base = -np.log(BUCKETS + np.bincount(langs, n, minlength=len(languages)))
    starts = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
    return LanguageModel(languages, None, (base, starts, langs[order], np.log1p(n[order])))


def _scored(rows: DataFrame, model: LanguageModel, is_markup: bool) -> DataFrame:
    """`rows` (key columns, then body last) with body replaced by ll, gain, n_trigrams and text_lang (an index; null without text)."""
    known = rows.sparkSession.sparkContext.broadcast(model)
    keys = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            ll, gain, n, best = [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                body = value.as_py()
                a, g, k = m.log_likelihood(visible_text(body) if is_markup else body)
                ll.append(a.tolist())
                gain.append(g)
                n.append(k)
                best.append(int(a.argmax()) if k else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(ll, pa.list_(pa.float64())), pa.array(gain, pa.float64()), pa.array(n, pa.int64()), pa.array(best, pa.int32())], names=[*keys, "ll", "gain", "n_trigrams", "text_lang"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy_batches(run), f"{schema}, ll array<double>, gain double, n_trigrams long, text_lang int")


def _by_language(per: DataFrame, by: list[str], n: int) -> DataFrame:
    """`by` and counts, an array with a place for each language; per: `by`, text_lang, n."""
    summed = per.groupBy(*by, "text_lang").agg(F.sum("n").alias("n"))
    held = summed.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "n"))).alias("m"))
    place = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))
    return held.select(*by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), place).alias("counts"))


def _per(rows: DataFrame, by: str) -> DataFrame:
    """For each value of `by` and each text language, how many rows there are."""
    return rows.where(F.col(by).isNotNull() & F.col("text_lang").isNotNull()).groupBy(by, "text_lang").agg(F.count(F.lit(1)).alias("n"))


def _counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """For each value of `by`, how many rows have each text language."""
    return _by_language(_per(rows, by), [by], n)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(rows: DataFrame, model: LanguageModel, keys: list[str], body: str, declared: str | None = None, suffix: str | None = None, host: str | None = None, is_markup: bool = False) -> DataFrame:
    """Fuse all evidence that is there; a row for each row, in columns `keys`, lang, confidence, text_lang, gain, n_trigrams.

    lang is the likeliest language (ties: the first in order of the alphabet) and confidence its posterior; gain is how much more
    likely, in nats a trigram, the text is in its best language than if all trigrams were alike - under 0 the text
    is in no language that the model knows. Null or empty texts have no text evidence (text_lang null, n_trigrams 0)
    and are judged by the rest; null or unknown evidence is left out. Without languages in the model lang is null.
    Keys are not looked at, so repeated rows are judged alike. An empty table has no rows; more columns are not looked
    at, and no name of a key clashes with a column of the operator's own.
    """
    names = model.languages
    n = len(names)
    spark = rows.sparkSession
    part = [F.col(k) for k in keys]
    evidence = [(F.lit(None).cast("string") if c is None else F.lower(F.col(c)) if c == declared else F.col(c)).alias(a) for c, a in ((declared, "__declared"), (suffix, "__suffix"), (host, "__host"))]
    flat = rows.select(*[p.alias(f"__k{i}") for i, p in enumerate(part)], *evidence, F.col(body).alias("__body"))
    scored = _scored(flat, model, is_markup)
    out = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]
    if not n:
        return scored.select(*out, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "gain", "n_trigrams")
    from .common import written

    scored = written(scored, "evidence")
    totals = [0] * n
    for r in scored.where("text_lang is not null").groupBy("text_lang").count().collect():
        totals[r["text_lang"]] = r["count"]
    all_rows = sum(totals)
    base = [(t + 1.0) / (all_rows + n) for t in totals]
    score = F.col("ll")
    joined = scored
    for c, of in (("__declared", declared), ("__suffix", suffix)):
        if of is None:
            continue
        counts = _counts(scored, c, n)
        n_values = counts.count()
        # P(value | language), towards one share for each value
        logs = F.transform("counts", lambda x, i: F.log((x + F.lit(SMOOTHING / max(1, n_values))) / (F.element_at(F.lit(totals), i + 1) + F.lit(SMOOTHING))))
        values = counts.select(c, logs.alias(f"{c}_log"))
        joined = joined.join(maybe_broadcast(values, n_values * (64 + 8 * n)), c, "left")
        score = F.when(F.col(f"{c}_log").isNotNull(), _add(score, F.col(f"{c}_log"))).otherwise(score)
    prior = F.lit(base)
    if host is not None:
        labels = F.split("__host", r"\.")
        per = _per(scored, "__host").withColumn("tld", F.element_at(labels, -1)).withColumn("domain", F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.col("__host")))
        hosts = _by_language(per, ["__host", "domain"], n)
        size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        toward = lambda counts, parent: F.zip_with(counts, parent, lambda x, p: x + p * SMOOTHING)
        shares = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, y: a + y))
        domains = _by_language(per, ["domain", "tld"], n)
        tlds = _by_language(per, ["tld"], n).select("tld", shares(toward(F.col("counts"), F.lit(base))).alias("tld_p"))
        domains = domains.join(tlds, "tld").select("domain", shares(toward(F.col("counts"), F.col("tld_p"))).alias("domain_p"))
        priors = hosts.join(domains, "domain").select("__host", "counts", "domain_p")
        n_hosts = hosts.count()
        joined = joined.join(maybe_broadcast(priors, n_hosts * (64 + 16 * n)), "__host", "left")
        own = F.transform("counts", lambda x, i: x - F.when(i == F.col("text_lang"), 1).otherwise(0))
        mine = F.zip_with(own, "domain_p", lambda x, p: (x + p * SMOOTHING) / (size(own) + F.lit(SMOOTHING)))
        prior = F.when(F.col("counts").isNotNull(), mine).otherwise(F.lit(base))
    joined = joined.withColumn("__s", _add(score, F.transform(prior, lambda p: F.log(p))))
    joined = joined.withColumn("__m", F.array_max("__s"))
    best = F.array_position("__s", F.col("__m"))
    confidence = 1.0 / F.aggregate("__s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__m")))
    return joined.select(*out, F.element_at(F.lit(names), best.cast("int")).alias("lang"), confidence.alias("confidence"), F.when(F.col("text_lang").isNotNull(), F.element_at(F.lit(names), F.coalesce("text_lang", F.lit(0)) + 1)).alias("text_lang"), "gain", "n_trigrams")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents"))
    host, path = url_parts(F.col("url"))
    segment = F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2})(/|$)", 1))
    tld = F.element_at(F.split(host, r"\."), -1)
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(host == "", None).otherwise(host).alias("host"),
        F.when(segment != "", segment).when(host != "", tld).alias("suffix"),
        F.nullif(F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1), F.lit("")).alias("declared"),
        "html",
    )
    return identify(pages, model, ["page_id"], "html", "declared", "suffix", "host", is_markup=True)
