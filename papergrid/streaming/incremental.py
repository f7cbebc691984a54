"""Notes, records and citations as they arrive: the batch operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papergrid.operators import chunks as C
from papergrid.plans import pipeline as P
from papergrid.workspace import is_there


def note_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """(path, stem, content) of notes as their files appear, most_files in a batch."""
    path = F.col("_metadata.file_path")
    reader = spark.readStream.option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", most_files)
    return reader.text(folder, wholetext=True).select(path.alias("path"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "").alias("stem"), F.col("value").alias("content"))


def chunk_stream(articles: DataFrame) -> DataFrame:
    """Chunks of a stream of articles: no state, the same plan as in batch."""
    return C.chunks(articles)


def first_arrivals(stream: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Each key once, at its first arrival; what comes later than the watermark allows is dropped with its state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def arrivals_by_window(stream: DataFrame, at: str, by: str, length: str = "1 day", late: str = "30 days") -> DataFrame:
    """(start, by, n): how many rows of each kind fall into each window; a window is given out when the watermark passes it."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), by, "n")


def grow_index(chunks: DataFrame, index_path: str, checkpoint: str, embedder: Callable = P.hashed_vector, dim: int = 64) -> StreamingQuery:
    """Embed chunks that the index doesn't hold and append them, batch by batch; a batch run again adds nothing."""
    key = ["article_id", "section_no", "subsection_no", "paragraph_index"]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = is_there(spark, index_path)
        new = P.embed_new(batch, spark.read.parquet(index_path), key, dim, embedder) if known else P.embed(batch, dim, embedder)
        new.write.mode("append").parquet(index_path)

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
