"""Token counts as delta-maintained rollups.

The rollup holds, by source, language and tokenizer version, how many documents and tokens there are. A batch of
changes becomes signed deltas: an insert adds, a delete subtracts, a revised count subtracts what was and adds what
is. Deltas are summed in the batch and committed once under the batch's id: they are written aside and the finished
folder is renamed into place, so a batch that fails leaves nothing, and a batch that comes again changes nothing.
Totals are the sums of all committed deltas; `compact` replaces the deltas of many batches by one of their sums.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, tidy_batches, written
from .tokens import ByteBpe, Vocabulary, default_vocabulary

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


class TokenRollup:
    """A rollup in a folder that driver and executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def _folders(self, kind: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)) if s.getPath().getName().startswith(f"{kind}-"))

    def _commit(self, rows: DataFrame, name: str) -> bool:
        """Write `rows` as the folder `name`; False, and nothing is done, if it is there."""
        if self._fs.exists(self._at(f"{self.path}/{name}")):
            return False
        aside = f"{self.path}/_{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        if self._fs.exists(self._at(f"{self.path}/{name}")) or not self._fs.rename(self._at(aside), self._at(f"{self.path}/{name}")):
            self._fs.delete(self._at(aside), True)
            return False
        return True

    @staticmethod
    def signed(changes: DataFrame) -> DataFrame:
        """Deltas of `changes`: op (insert, delete or revise), source, lang, version, tokens, and for revise old_source,
        old_lang, old_version, old_tokens. A null count is 0 tokens; null keys are a key of their own; other ops are an error."""
        known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(F.col("op"), F.lit("null")))))
        tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long"))
        sign = F.when(known == "delete", -1).otherwise(1)
        new = F.struct(*[F.col(k) for k in KEYS], sign.cast("long").alias("n_docs"), (sign * tokens).alias("n_tokens"))
        if "old_tokens" in changes.columns:
            old = F.struct(*[F.col(f"old_{k}").alias(k) for k in KEYS], F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce(F.col("old_tokens").cast("long"), F.lit(0).cast("long"))).alias("n_tokens"))
            both = F.when(F.col("op") == "revise", F.array(new, old)).otherwise(F.array(new))
        else:
            both = F.array(new)
        rows = changes.select(F.explode(both).alias("d")).select("d.*")
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False, and no change, if a batch of this id was committed before."""
        if not re.fullmatch(r"[\w.]+", batch_id):
            raise ValueError(f"a batch id is letters, digits, _ and dots: {batch_id!r}")
        if batch_id in self.committed():
            return False
        return self._commit(self.signed(changes), f"batch-{batch_id}")

    def _base(self) -> str | None:
        """The newest base that is whole: its list of batches is written after it."""
        bases, lists = self._folders("base"), {x.removeprefix("covers-") for x in self._folders("covers")}
        return max((b for b in bases if b.removeprefix("base-") in lists), default=None)

    def _covered(self) -> set[str]:
        base = self._base()
        if base is None:
            return set()
        return {r.batch for r in self.spark.read.parquet(f"{self.path}/covers-{base.removeprefix('base-')}").collect()}

    def committed(self) -> set[str]:
        return {x.removeprefix("batch-") for x in self._folders("batch")} | self._covered()

    def _sums(self) -> DataFrame:
        covered, base = self._covered(), self._base()
        paths = [f"{self.path}/{x}" for x in self._folders("batch") if x.removeprefix("batch-") not in covered] + ([f"{self.path}/{base}"] if base else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; keys of which nothing is left are left out."""
        return self._sums().where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Sum all committed batches into one base, then remove what it covers. May be cut off anywhere: a base counts only with its list."""
        batches = sorted(self.committed())
        old = self._folders("base") + self._folders("covers")
        number = f"{len(self._folders('base')) and int(max(self._folders('base')).removeprefix('base-')) + 1:06d}"
        self._commit(self._sums(), f"base-{number}")
        self._commit(self.spark.createDataFrame([(b,) for b in batches], "batch string"), f"covers-{number}")
        for x in old + [f"batch-{b}" for b in batches]:
            self._fs.delete(self._at(f"{self.path}/{x}"), True)


def count_tokens(docs: DataFrame, vocabularies: dict[str, Vocabulary]) -> DataFrame:
    """`docs` (any columns, text) without text and with a column tokens_<version> for each vocabulary; null and empty texts
    have no tokens, repeated rows are counted each, an empty table has no rows. Columns of the new names are replaced."""
    versions = list(vocabularies)
    keys = [c for c in docs.columns if c != "text" and c not in {f"tokens_{v}" for v in versions}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [ByteBpe(vocabularies[v]) for v in versions]
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *(pa.array([e.count(t) if t else 0 for t in texts], pa.int64()) for e in encoders)], names=[*keys, *(f"tokens_{v}" for v in versions)])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema.fields] + [f"tokens_{v} long" for v in versions])
    return docs.select(*keys, "text").mapInArrow(tidy_batches(run), schema)


def insert(version: str, tokens: str | Column) -> list[Column]:
    return [F.lit("insert").alias("op"), F.col("source"), F.col("lang"), F.lit(version).alias("version"), (F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens")]


def multilingual() -> Vocabulary:
    import public_tokenizers as P

    return Vocabulary("", P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: every document is loaded; those in other languages than English are recounted
    with the vocabulary for many languages; those that are labelled toxic are taken out, as they are then. The load
    comes twice, and counts once."""
    one, many = "byte_bpe_50k", "byte_bpe_multi_50k"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = written(count_tokens(docs, {one: default_vocabulary(), many: multilingual()}), "token-counts")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/tabulon/rollup-{uuid.uuid4().hex}")
    load = counted.select(*insert(one, f"tokens_{one}"))
    rollup.apply("load", load)
    other = counted.where(~english)
    rollup.apply("recount", other.select(F.lit("revise").alias("op"), "source", "lang", F.lit(many).alias("version"), F.col(f"tokens_{many}").alias("tokens"), F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(one).alias("old_version"), F.col(f"tokens_{one}").alias("old_tokens")))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = counted.join(toxic, "doc_id", "left_semi")
    rollup.apply("retract", gone.select(F.lit("delete").alias("op"), "source", "lang", F.when(english, one).otherwise(many).alias("version"), F.when(english, F.col(f"tokens_{one}")).otherwise(F.col(f"tokens_{many}")).alias("tokens")))
    rollup.apply("load", load)
    return rollup.totals()
