"""Reading and writing panel tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a declared schema: types are never inferred by an extra pass."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first path that exists, e.g. the reduced table before the merely scaled one."""
    for path in paths:
        if path_exists(spark, path):
            return read_parquet(spark, path)
    raise FileNotFoundError(", ".join(paths))


def union_datasets(frames: dict[str, DataFrame]) -> DataFrame:
    """One table with a `dataset` column instead of a loop over named tables."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def save_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def save_json_row(spark: SparkSession, values: dict, folder: str, name: str) -> str:
    """Best parameters or scores as one JSON record."""
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return save_table(row.coalesce(1), folder, name, fmt="json")


def drop_index_columns(df: DataFrame, pattern: str = r"^Unnamed") -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if not re.search(pattern, c)])
