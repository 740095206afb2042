"""A store of blobs that is fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cairn.functions.urn import sha1_urn

SCHEMA = "urn string, size long, content binary, batch long"


def store_stream(stream: DataFrame, path: str, checkpoint: str, text_col: str = "text") -> DataStreamWriter:
    """Writes each blob of the stream that path does not hold yet, once, as Parquet by batch; start() starts it.

    A batch is compared with all earlier ones by a join, so the stream keeps no state; a
    batch that runs again, after a failure, replaces its own folder. Null texts are no blobs.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, content = batch.sparkSession, batch[text_col]
        blobs = batch.where(content.isNotNull()).select(sha1_urn(content).alias("urn"), F.octet_length(content).cast("long").alias("size"), content.cast("binary").alias("content"))
        new = blobs.dropDuplicates(["urn"])
        if number:
            known = spark.read.schema(SCHEMA).parquet(path).where(F.col("batch") < number)
            new = new.join(known.select("urn"), "urn", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
