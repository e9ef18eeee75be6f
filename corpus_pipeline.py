"""The corpus pipeline: five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet to the shared folder and reads it again for the next one. All but the last
return the columns of documents. Rows with a null doc_id pass every stage that
decides by doc_id; rows with the same doc_id are one document where documents are
dropped, and each keeps its own text where texts are cut. Null and empty texts are
scored like any other, have no near duplicates and lose nothing. Tables without rows
give none; further columns of documents are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, ngram_join, quality, sentencepiece_codec, suffix_dedup
from tidelog.llm.common import by_ids, save, shrink
from tidelog.llm.queries import SENTENCEPIECE_MODEL, held_out, table


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: learns from the labels that aren't held out; documents that it rejects go."""
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = _free(docs, "quality_score")
    return quality.score_texts(docs, model, score=score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the document with the smallest doc_id stays."""
    classes = ngram_join.similar_documents(docs, k=5, percent=75)
    gone = save(classes.where("doc_id <> component_id").select("doc_id").distinct(), "near")
    return by_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: strings of 50 bytes that an earlier document has are cut out of the text; n_chars follows."""
    shrink(spark)  # the stage before has run some hundred short queries
    counts = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    row = "doc_id"
    if counts["n"] != counts["ids"]:  # rows that share a doc_id are told apart by a number that is written down
        row = _free(docs, "row")
        docs = save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    kept, cut = _free(docs, "kept"), suffix_dedup.remove_repeats(docs, length=50, texts=True, row=row).where("n_removed > 0")
    out = docs.join(cut.select(F.col("row").alias(row), F.col("kept").alias(kept)), row, "left").withColumn("text", F.coalesce(kept, "text"))
    out = out.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length(kept).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if c == "doc_id" or c != row])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item of the benchmark go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the ids of every text, how many, and whether they decode to the text and are those of the other library."""
    shrink(spark)
    out = sentencepiece_codec.encode_texts(docs, SENTENCEPIECE_MODEL)
    return out.withColumn("round_trip", F.col("decoded") == F.col("text")).select("doc_id", "lang", "source", "ids", "n_tokens", "parity", "round_trip")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first),
    ("repeats", cut_repeats),
    ("contamination", drop_leaks),
    ("tokens", to_tokens),
]
#: SQL expresses neither the classifier nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
