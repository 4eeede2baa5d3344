"""The stateless derivations and exact dedup over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from textloom.operators import features, ingest, manifest


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 64) -> DataFrame:
    """A stream of parquet files; ``path`` may be a glob that picks a split's files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def normalized(stream: DataFrame) -> DataFrame:
    """Records of a raw stream; no state."""
    return ingest.normalize(stream)


def featured(stream: DataFrame, text: str = "text") -> DataFrame:
    """Statistical features of a stream; no state."""
    return features.statistical(stream, text)


def first_seen(records: DataFrame) -> DataFrame:
    """The first record of each text. State holds one key for each text seen; a contradiction that comes later can't take
    back what was given, so quarantine needs ``manifest.kept`` on what has arrived."""
    return records.dropDuplicates(["text_hash"])


def quarantine(records: DataFrame, path: str, checkpoint: str):
    """Exact dedup with quarantine over a stream: each micro-batch goes to ``path``/records by batch, so a batch that is
    tried again replaces itself; ``kept_so_far`` then gives what the manifest keeps of all that has arrived."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/records/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_so_far(spark: SparkSession, path: str, order: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """The rows that the quarantine keeps of all batches so far: a later contradiction takes back what came before it."""
    return manifest.kept(spark.read.option("basePath", f"{path}/records").parquet(f"{path}/records/batch=*").drop("batch"), order)


def write_available(stream: DataFrame, path: str, checkpoint: str):
    """Work off what is there, then stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
