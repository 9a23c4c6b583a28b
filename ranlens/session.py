"""Session settings that the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Partition counts and memory belong to the cluster and are not set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # The virtual machine never compiles a method above 8000 bytes of bytecode, and a wide
    # projection fused with its neighbours exceeds that; split code is then the faster one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Percentile sketches are objects, and beyond this number of groups a task sorts its whole input.
    # The values that a task's sketches hold are at most those of its input, and a group costs about
    # 1 KB more, so this many groups take some 64 MB; the default of 128 sorts always.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # Recording the call site of every column expression slows the building of wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Texts may be long, and both the virtual machine and a Python worker hold whole batches of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Window state lives off the heap, so that many open keys do not press on memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "ranlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` adds to or overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_settings(spark: SparkSession) -> None:
    """Give a session that was built elsewhere the settings that fix results and generated code."""
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.codegen.hugeMethodLimit",
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold",
    ):
        spark.conf.set(key, SETTINGS[key])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: as the cluster names it in ``spark.checkpoint.dir``, else in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
