"""A corpus pipeline of five stages, each an operator of ``refmill.llm`` applied to all documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refmill.llm import minhash, mixing, pieces, pii, toxicity
from refmill.llm.common import counted, importable, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the model learns from the labels of rows that aren't held out.

    Null and empty texts have no hit and stay; equal rows and equal scores are treated alike; without labels the seed
    lexicon decides; an empty table stays empty; only the columns of documents are kept.
    """
    importable(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), model, keep=COLUMNS)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that with the smallest id (of several texts, the smallest hash).

    Rows are told apart by id and text, so an id that repeats with another text loses nothing; of rows that repeat
    both, one stays (the least by all columns). Rows without words or without an id stay as they are, all of them.
    """
    importable(spark)
    docs = docs.select(*COLUMNS)
    rows = stored(minhash.grouped(docs).filter("least is not null"), "grouped")
    key = F.struct("doc_id", "text_hash")
    per = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first(F.col("least") == key).alias("first"))
    gone, n = counted(per.filter("not first or n > 1"), "gone")
    gone = minhash.few(gone, n)
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    kept = hashed.join(gone, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)
    again = hashed.join(gone.filter("first"), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return kept.unionByName(again.select("row.*")) if n else kept


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; n_chars follows the text.

    Null texts stay null with their n_chars; every row stays, repeated ones too.
    """
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, none where it takes it 0 times; rows without words are not taken.

    Rows that repeat an id, and null ids and sources, are rows of their own.
    """
    taken = mixing.mixed(docs.select(*COLUMNS))
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sampled pieces, seeded by doc_id: equal rows get equal pieces, a null text none."""
    importable(spark)
    return pieces.tokenize(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The trained model, MinHash and sampled pieces are beyond SQL; tests compare near-duplicates with all pairs,
#: redaction with the spans found, mixing with the operator and decoded pieces with the texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
