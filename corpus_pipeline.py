"""A training-corpus pipeline: five stages over the table `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. Stages 1 to 4
return the columns of documents, the last one the encoded corpus.

Decisions per row rest on (doc_id, text), so repeated ids do no harm. Null and
empty texts are one group of copies; an empty table stays empty; texts of any
length are read whole. Of exact copies the row with the largest id stays, of
near copies the one with the least, and of repeats of that row (same id, same
text) one. Other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, dedup, pieces, quality, simhash
from docloom.llm.common import cut, join_hot, scratch, table, text_of, unused, without, without_old_shuffles
from docloom.llm.queries import vocabulary

#: Near copies have this Jaccard similarity of their shingles of so many words at least, or fingerprints within two bits.
WORDS, SHARE = 5, 0.8
#: The text of a row, as a key.
MARK = F.xxhash64


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, good = unused(docs, "score"), unused(docs, "predicted")
    return quality.score_quality(docs, model, into=score, predicted=good).where(F.col(good) == 1).select(*docs.columns)


def keep_one_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of its repeats, one."""
    found = dedup.exact_duplicates(docs)
    sha = F.sha2(dedup.normalised("text"), 256)
    out = without(docs, found.where("NOT kept"), {"doc_id": F.col("doc_id"), "text_sha256": sha}, 112)
    if found.where("kept AND group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").head(1):
        own = unused(docs, "sha")
        out = out.withColumn(own, sha).dropDuplicates(["doc_id", own]).select(*docs.columns)
    return out


def keep_one_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document that names it."""
    mark = MARK(text_of())
    with without_old_shuffles(spark):
        rows = cut(simhash.near_duplicates(docs, words=WORDS, carry=(mark.alias("mark"),), share=SHARE))
        first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1")
        removed = join_hot(rows, first, "root", F.col("n"), rows.count()).where(~F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark").eqNullSafe(F.col("first")))
        return without(docs, removed, {"doc_id": F.col("doc_id"), "mark": mark})


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    mark = MARK(text_of())
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), carry=(mark.alias("mark"),))
    return without(docs, found.where("contaminated"), {"doc_id": F.col("doc_id"), "mark": mark})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as piece ids, each text checked to decode to itself."""
    coded = pieces.round_trip(docs, vocabulary("piece_bpe_32k.model"), ids=True)
    return coded.select("doc_id", "lang", "source", "n_pieces", "piece_ids", "pieces_sha256", "lossless")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_one_exact),
    ("SimHash near-dedup", keep_one_near),
    ("benchmark decontamination", keep_uncontaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the classifier, the fingerprints or the encoding; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
