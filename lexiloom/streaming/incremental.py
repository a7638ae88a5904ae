"""A running document vocabulary over a stream of files: an addition, the batch engine's incremental form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lexical
from ..operators import vocabulary


def term_counts(files: DataFrame) -> DataFrame:
    """(term, uses) of a streaming ``files(path, text)``; state is one row a term."""
    files = lexical.normalize_text(files.select("text"), "text", form="FOLD")
    return files.select(F.explode(lexical.doc_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("uses"))


def windowed_terms(files: DataFrame, time_col: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, term, uses) by event time; windows close when the watermark passes."""
    folded = lexical.normalize_text(files.withWatermark(time_col, late).select(time_col, "text"), "text", form="FOLD")
    words = folded.select(time_col, F.explode(lexical.doc_words(F.col("text"))).alias("term"))
    return words.groupBy(F.window(time_col, window), "term").agg(F.count("*").alias("uses"))


def append_occurrences(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's doc_occ under its batch id, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        vocabulary.doc_occurrences(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
