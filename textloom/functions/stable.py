"""Deterministic hashes, ranks and shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    """Lower-case hex of the digest of the UTF-8 text."""
    return F.sha2(text, 256)


def stable_rank(record_id: Column, seed: int) -> Column:
    """A rank that depends on seed and id only: the hex digest of ``seed:id``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), record_id), 256)


def shard(text_hash: Column, shards: int) -> Column:
    """The first eight hex digits as a number, modulo the number of shards."""
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    return F.pmod(F.conv(F.substring(text_hash, 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def hash_bucket(record_id: Column, seed: int, buckets: int = 100) -> Column:
    """A number below ``buckets`` from the stable rank."""
    return F.pmod(F.conv(F.substring(stable_rank(record_id, seed), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
