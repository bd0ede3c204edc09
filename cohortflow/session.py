"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants: a fixed time zone, runtime re-planning and skewed-join
# splitting even where it costs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a row sent to Python may be a whole block of points: bound batches by bytes, too
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortflow-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and go on from that table.

    Unlike a local checkpoint it survives lost executors; unlike a plain one the rows are computed
    once, stored by column, and the new plan starts without the constraints of the old one, which
    grow quickly in loops.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that `cut_lineage` returned; the frame must not be used after it."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it as the driver does: by PYTHONPATH or the working folder."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(context, "_cohortflow_shipped", False) or any(os.path.realpath(p) == os.path.realpath(root) for p in known if p):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "cohortflow"), "zip", root, os.path.basename(os.path.dirname(os.path.abspath(__file__))))
    context.addPyFile(archive)
    context._cohortflow_shipped = True
