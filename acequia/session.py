"""Session settings sized from the data."""

from __future__ import annotations

# A partition of this size is scanned, sorted and aggregated in executor memory.
PARTITION_BYTES = 128 * 1024 * 1024


def session_settings(
    input_bytes: int, cores: int, shuffle_bytes: int | None = None, partition_bytes: int = PARTITION_BYTES
) -> dict[str, str]:
    """Settings for a session that scans ``input_bytes``.

    ``shuffle_bytes`` is what its largest shuffle moves after column pruning and
    map-side aggregation; without it the input size stands in. Partitions have
    ``partition_bytes`` at every size; a caller with a driver too small for so many
    tasks may name larger ones. The partition count is a starting point: adaptive
    execution merges small partitions after each shuffle and splits skewed ones, in
    joins and in the rebalancing before a write. At least one partition per core
    keeps a small input parallel.
    """
    moved = input_bytes if shuffle_bytes is None else shuffle_bytes
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(max(cores, -(-moved // partition_bytes))),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.session.timeZone": "UTC",
    }
