"""Continuous ingest: new rows or files are analysed as they arrive.

Only row-wise operators are applied, so the stream keeps no state and any
micro-batch can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import extract as X
from ..functions.text import words_in


def incoming(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they appear; a path of one file is that file in its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))
    return reader.parquet(path)


def analysed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.select(F.col(doc_id).alias("doc_id"), X.document_type(t).alias("document_type"), words_in(t).alias("word_count"), X.information(t).alias("information"))


def run(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; start again with the same checkpoint to go on."""
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
