"""Session helpers: session settings the results depend on, and the shared work folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Dates and times are UTC throughout; everything else stays as the cluster set it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or one in the warehouse when unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = sc._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder so that a lost executor costs no recomputation."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)
