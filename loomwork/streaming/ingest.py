"""Incremental ingest: new files become new rows, rows that are stored already don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomwork.operators.store import insert_absent


def stream_table(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_absent(rows: DataFrame, target: str, keys: list[str], tie: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Starts a query that appends to the Parquet table at `target` what its keys don't hold yet, batch by batch. A batch
    that is run again after a failure finds its own rows and adds none, so each row arrives once.

    The table is laid out in folders by a hash of the keys (key_bucket), and a batch reads the key columns of the folders its
    own keys fall into and nothing else; at most `buckets` numbers reach the driver.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("key_bucket", bucket).persist()
        try:
            touched = [r[0] for r in batch.select("key_bucket").distinct().collect()]
            try:
                stored = spark.read.schema(batch.schema).parquet(target).where(F.col("key_bucket").isin(touched))
            except Exception as error:  # the first batch meets no table
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                stored = batch.limit(0)
            fresh = insert_absent(stored.select("key_bucket", *keys), batch, ["key_bucket", *keys], tie)
            fresh.select(*batch.columns).repartition("key_bucket").write.mode("append").partitionBy("key_bucket").parquet(target)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
