"""Masks and bursts as folders of Parquet with a JSON header beside the rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..meta import ObsHeader


def save(table: DataFrame, header: ObsHeader, path: str, **more) -> None:
    table.write.parquet(f"{path}/rows")
    spark = table.sparkSession
    spark.createDataFrame([(json.dumps({"header": header.to_dict(), **more}),)], "value string").coalesce(1).write.text(f"{path}/header")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, ObsHeader, dict]:
    values = json.loads(spark.read.text(f"{path}/header").first()[0])
    return spark.read.parquet(f"{path}/rows"), ObsHeader(**values.pop("header")), values


def file_type(path: str) -> str:
    """``sigproc``, ``pfits`` or ``fbh5`` by a file's name."""
    kinds = {".fil": "sigproc", ".tim": "sigproc", ".fits": "pfits", ".sf": "pfits", ".h5": "fbh5", ".hdf5": "fbh5"}
    for end, kind in kinds.items():
        if path.endswith(end):
            return kind
    raise ValueError(f"unknown file type: {path}")
