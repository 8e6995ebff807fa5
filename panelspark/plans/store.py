"""Tables kept in the shared folder: small results of a pass over the fact table, written once in an application and read by every query after."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[tuple, tuple] = {}


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own where it is unset, which is an error on a cluster."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.panelspark.shared", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.panelspark.shared", where)
    return f"{where.rstrip('/')}/panelspark/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back: what several later steps read is worked out once, and lost executors don't repeat it."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    return tuple(sorted(map(tuple, files.collect())))


def stored(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows, written at first use and read back; written anew if the files of the tables it comes from are others, or are longer or later."""
    key = (spark.sparkContext.applicationId, shared(spark), name, sf_dir)
    state = tuple(_state(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    if key not in _written or _written[key][0] != state:
        df, path = build(), fresh(spark, name)
        df.write.parquet(path)
        _written[key] = state, path, df.schema
    _, path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)
