"""Session settings the library is tuned for. All but the master can be set at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.sources.tables import TEXT_PARTITIONS

SETTINGS = {
    # days and months are UTC
    "spark.sql.session.timeZone": "UTC",
    # re-plan from real sizes: broadcast small sides, split skewed join partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # long regular-expression chains make methods the JVM refuses to compile (over 8000
    # bytes); above this limit Spark splits the stage into small methods, twice as fast
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# set when the session starts: noting the Python line of every column call takes longer than
# building the long expressions of the HTML functions
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", memory: str = "8g", partitions: str = "8") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config(map=STATIC)
        .getOrCreate()
    )
    # the test tables are one file of one row group each
    spark.conf.set(TEXT_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    spark.sparkContext.setLogLevel("ERROR")
    return spark
