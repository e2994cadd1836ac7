"""Readers and writers of tables."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import no_nan, q
from tessera.functions.tables import new_path
from tessera.sources.json_arrays import read_arrays


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header, every column as text: types come from ``infer_types``."""
    return spark.read.csv(path, header=True, inferSchema=False)


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())])


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of records or one object, or (``lines``) a record a line; nested structs flattened. Either is read by many tasks."""
    return flattened(spark.read.json(path) if lines else read_arrays(spark, path))


def json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A text column of JSON parsed by ``schema`` and flattened beside the others."""
    return flattened(df.withColumn(column, F.from_json(q(column), schema)))


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A posted list of records: columns in the order they first occur, what a record lacks is null, NaN and infinities too; nested records flattened."""
    path = new_path(spark, "posted")
    spark.createDataFrame([(json.dumps(_finite(r), default=str),) for r in rows], "value string").write.text(path)
    df = spark.read.json(path)
    order = list(dict.fromkeys(k for r in rows for k in r))
    return flattened(df.select(*[q(c) for c in order if c in df.columns]))


def _finite(x: object) -> object:
    """NaN and infinities, for which JSON has no words, as null, however deep."""
    if isinstance(x, dict):
        return {k: _finite(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_finite(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def head(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(key).limit(n)


def tail(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n)


def sink(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a result; NaN and infinities become null, as JSON and most readers expect."""
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    df.select(*[no_nan(q(c)).alias(c) if c in doubles else q(c) for c in df.columns]).write.format(form).save(path)
