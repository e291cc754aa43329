"""From downloaded archives to publishable shards."""

from __future__ import annotations

from pyspark.sql import DataFrame

from captionforge.operators.filters import filter_status
from captionforge.sinks.writers import save_sharded
from captionforge.sources.archives import join_sidecar, read_archives

SIDECAR = "key string, caption string, url string, status string, punsafe double, pwatermark double, similarity double"


def successful_pairs(pairs: DataFrame) -> DataFrame:
    return filter_status(pairs).drop("archive", "stem", "status")


def shard_archives(spark, archive_dir: str, out: str, max_shard_size: int | str = "500MB") -> DataFrame:
    """Unpack every archive, pair images with metadata, keep the successes, save shards; the manifest."""
    pairs = join_sidecar(read_archives(spark, archive_dir), SIDECAR)
    return save_sharded(successful_pairs(pairs), ["key"], out, max_shard_size=max_shard_size)
