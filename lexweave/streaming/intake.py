"""An extension: lexicon files taken in as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalized
from ..sources.files import parse_lines


def lexicon_stream(spark: SparkSession, folder: str, delimiter: str = "\t") -> DataFrame:
    """(gloss, form, ipaform) of the lines of files in a folder, new files as they come."""
    from pyspark.sql import functions as F

    return parse_lines(spark.readStream.text(folder), delimiter).withColumn("ipaform", normalized(F.col("form")))


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
