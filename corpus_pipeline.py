"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Each row is judged by itself, by its place: rows are
numbered by their file and their place in it, so null or repeated ids don't matter. Toxicity filters rows where they
stand; of the other stages, the numbers of what they reject are taken out by an anti-join, which is broadcast if it
is small, so texts are not shuffled then.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, jaccard, language, packing, toxicity
from tabulon.llm.common import maybe_broadcast, ship, table, written

#: Trigrams from which a text without any likeness to a known language is rejected.
LEAST_TRIGRAMS = 20
#: Bits of a row's number for its place in its file.
PLACE_BITS = 40


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with __row: the number of its file, then its place there. What isn't read from files is written first."""
    try:
        placed = docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:
        return _numbered(written(docs, "docs"))
    files = sorted(r[0] for r in docs.select(F.xxhash64("_metadata.file_path")).distinct().collect())
    if len(files) != docs.select("_metadata.file_path").distinct().count():
        raise ValueError("two files have the same hash of their path")
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "__file long, __number long")
    row = F.shiftleft(F.col("__number"), PLACE_BITS) + F.col("__place")
    return placed.join(maybe_broadcast(numbers, 32 * len(files)), "__file").withColumn("__row", row).drop("__file", "__place", "__number")


def _keyed(numbered: DataFrame) -> DataFrame:
    """Rows as the operators take them, with the row's number in place of doc_id."""
    return numbered.select(F.col("__row").alias("doc_id"), "text")


def _without(numbered: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose number is not in `rejected` (doc_id), without numbers."""
    keys = written(rejected.select(F.col("doc_id").alias("__row")), "rejected")
    return numbered.join(maybe_broadcast(keys, 32 * keys.count()), "__row", "left_anti").drop("__row")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and those of LEAST_TRIGRAMS or more that are less likely in every known language than at random.

    Null and empty texts have no letters; an empty table stays empty; repeated rows fare alike.
    """
    ship(spark)
    rows = _numbered(docs)
    model = language.train(docs)
    found = language.identify(rows.select("__row", "text", "lang", "source"), model, ["__row"], "text", declared="lang", host="source")
    return _without(rows, found.where(f"n_trigrams = 0 or (gain < 0 and n_trigrams >= {LEAST_TRIGRAMS})").select(F.col("__row").alias("doc_id")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is predicted to be toxic; learned from the labels that are not held out.

    Null and empty texts are judged like those without any known word, by the share of toxic examples; without
    examples nothing is rejected; repeated rows fare alike; an empty table stays empty.
    """
    ship(spark)
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.classify(docs, model, into="__found").where("__found.predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays: that of the least id (null last), then the first in order of files and places.

    Texts without words are in no component and all stay, repeated ones too.
    """
    ship(spark)
    rows = _numbered(docs)
    found = written(jaccard.jaccard_components(_keyed(rows)), "components").where("n_shingles > 0").select("doc_id", "component_id")
    ids = rows.select(F.col("__row").alias("doc_id"), F.col("doc_id").alias("id"))
    first = found.join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("one")).select(F.col("one.doc_id").alias("doc_id"))
    return _without(rows, found.join(first, "doc_id", "left_anti"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of the benchmark; null and empty texts hold none, repeated rows fare alike."""
    ship(spark)
    rows = _numbered(docs)
    leaks = decontaminate.find_leaks(_keyed(rows), table(spark, sf_dir, "benchmark"))
    return _without(rows, leaks.where(F.size("spans") > 0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 1024 tokens; null and empty texts are one token each, repeated rows are packed each, an empty table has no pieces."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: No stage but the language of the rules can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
