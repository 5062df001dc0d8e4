"""Sources and sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cohortweave.session import ensure_checkpoint_dir


def load(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None,
         schema: StructType | str | None = None) -> DataFrame:
    """Read ``folder/name.parquet``; only the named columns reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df if columns is None else df.select(*columns)


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a stage table, replacing an earlier one."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def stage_by(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write a stage table laid out by ``keys`` and read it back.

    The table is bucketed by the keys (as many buckets as shuffle partitions, one file each) in the checkpoint folder, so what
    follows by these keys, joins, windows and groups by the keys and more, needs no exchange of its rows.
    """
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stage_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.format("parquet").option("path", f"{folder}/{name}")
     .bucketBy(buckets, *keys).saveAsTable(name))
    return spark.table(name)


def save_tsv(df: DataFrame, path: str, day: date | None = None) -> str:
    """Tab-separated text without a header row; with a ``day``, its ISO form follows the name.  Returns the path."""
    if day is not None:
        stem, ext = os.path.splitext(path)
        path = f"{stem}_{day.isoformat()}{ext}"
    df.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)
    return path


def expect(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows by named row checks into (valid, rejected).

    As for a CHECK constraint an unknown result passes; a rejected row lists the
    checks it failed in ``failed_checks``.
    """
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in checks.items()
    ]))
    ok = reduce(lambda a, b: a & b, [F.coalesce(test, F.lit(True)) for test in checks.values()])
    return df.where(ok), df.where(~ok).withColumn("failed_checks", failed)


def harmonise(frames: Sequence[DataFrame], columns: Sequence[Mapping[str, Column | str]],
              distinct: bool = True) -> DataFrame:
    """Bring exports of one feed to one schema and stack them.

    ``columns[i]`` maps target names to a source column name or expression of
    ``frames[i]``; duplicates over all columns fall away.
    """
    parts = [
        frame.select(*[(F.col(e) if isinstance(e, str) else e).alias(t) for t, e in mapping.items()])
        for frame, mapping in zip(frames, columns, strict=True)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.distinct() if distinct else stacked
