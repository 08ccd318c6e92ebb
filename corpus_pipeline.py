"""Corpus pipeline: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import free_name, full_text, same
from tracewright.llm.exact import digest_of, exact_dedup
from tracewright.llm.langid import UNKNOWN, identify, learn
from tracewright.llm.packing import pack, pieces
from tracewright.llm.pii import replace_personal_data
from tracewright.llm.queries import vocabulary
from tracewright.llm.similar import similar_texts
from tracewright.scale import checkpoint

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIN_SCORE = 0.5  # mean certainty of a text's windows, each of its own best language
KEY = "corpus key 1"  # of the surrogates
BATCH = 512  # rows that Spark hands to Python at once; with Spark's 10,000 a batch of documents takes 30 MB and more


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python: their batches are held several times over, in the executor and in its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def _keep(docs: DataFrame, keys: dict[str, Column], kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose keys are in ``kept``, one for each key; null equals null.

    Rows with one key are equal in id and text; they are reduced to one before the
    shuffle, so a row that is repeated very often does no harm.
    """
    rows = docs.select(F.struct("*").alias("doc"), *[c.alias(k) for k, c in keys.items()])
    one = rows.groupBy(*keys).agg(F.first("doc").alias("doc"))
    return one.join(kept, same(one, kept, list(keys)), "left_semi").select("doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: a letter at least, and windows that are likely in some language.

    Each window counts by its own best language, so a text in several languages stays.
    If no document has a ``lang``, nothing can be learned and all with a letter stay.
    Null and empty texts go. Repeated rows stay as they are.
    """
    _small_batches(spark)
    net = learn(docs, key="doc_id")
    if not net.labels:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    label, score, certain = (free_name(docs, x) for x in ("lang_pred", "lang_score", "lang_certain"))
    told = identify(docs, net, *docs.columns, label_col=label, score_col=score, certain_col=certain)
    return told.where((F.col(label) != UNKNOWN) & (F.col(certain) >= MIN_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the winner of each group of equal texts; of repeated rows one stays."""
    seen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    kept = exact_dedup(docs, seen).where("kept").select("id", "digest")
    return _keep(docs, {"id": docs["doc_id"], "digest": digest_of(docs["text"])}, kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the least id, null last, then least text hash.

    Near duplicates share 0.8 or more of their five-word shingles (Jaccard).
    """
    _small_batches(spark)
    key = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), F.md5(full_text(docs["text"])).alias("h"))
    groups = similar_texts(docs.select(key.alias("id"), docs["text"].alias("text")), id_col="id")
    kept = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select("id.*")
    keys: Sequence[str] = kept.columns
    return _keep(docs, {k: key[k] for k in keys}, kept)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data; n_chars follows the text.

    Null texts stay null, empty ones empty. Repeated rows stay as they are, other columns too.
    """
    out = replace_personal_data(docs, KEY, count_col=free_name(docs, "n_replaced")).docs
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in token pieces, each with its sequence and its place there.

    A null or empty text is one piece, the end id. Repeated rows are packed as often as
    they stand there. Only doc_id stays of the other columns.
    """
    _small_batches(spark)
    return pack(pieces(docs, vocabulary())).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("pii", pii), ("packing", packing),
]

# No SQL: the network, fingerprints, surrogates and packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
