"""Graph memory as streaming appends (G1/G2 incremental, §2.9 optional extra).

New node / edge records arrive as JSON files; each micro-batch is appended to
the node or edge table.  Ids are a hash of the record's identity, so a batch
replayed after a failure yields the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_INPUT = "type string, content string, metadata string"
EDGE_INPUT = "source_id bigint, target_id bigint, relation string, metadata string"


def node_stream(spark: SparkSession, path: str) -> DataFrame:
    s = spark.readStream.schema(NODE_INPUT).json(path)
    return s.select(F.xxhash64("type", "content").alias("id"), "type", "content",
                    F.coalesce("metadata", F.lit("{}")).alias("metadata"),
                    F.localtimestamp().cast("timestamp_ntz").alias("created_at"))


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    s = spark.readStream.schema(EDGE_INPUT).json(path)
    return s.select(F.xxhash64("source_id", "relation", "target_id").alias("id"), "source_id", "target_id", "relation",
                    F.coalesce("metadata", F.lit("{}")).alias("metadata"),
                    F.localtimestamp().cast("timestamp_ntz").alias("created_at"))
