"""Session settings the library is tuned for.

The operators never change session settings themselves: on a cluster the
session is given to them. `build_session` is for stand-alone jobs, tests and
the benchmark.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: merge small shuffle partitions, split skewed ones,
    # turn a join into a broadcast only once the side's real size is known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Where every partition of one side turns out this small, hashing it replaces the sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Checkpoint files go once no DataFrame refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app_name: str = "coratia",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above.

    `shuffle_partitions` should be about two to three times the number of
    executor cores on a cluster (AQE merges what is too small) and the number
    of cores on a single machine.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
