"""Writers: versioned rewrites, retention, removal by key, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import micros


def rewrite(df: DataFrame, folder: str, version: str, fmt: str = "parquet") -> str:
    """Write a whole store to a new version next to the others; readers of older ones are not disturbed."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def retained(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    """Rows newer than the retention."""
    return df.where(micros(column) > micros(F.lit(as_of)) - days * 86_400_000_000)


def newest(df: DataFrame, order: str, limit: int, only_above: int) -> DataFrame:
    """The newest ``limit`` rows once there are more than ``only_above``."""
    return df.orderBy(F.desc(order)).limit(limit) if df.count() > only_above else df


def without(df: DataFrame, column: str, value) -> DataFrame:
    """All rows but those of a value; rows without a value stay."""
    return df.where(~F.coalesce(F.col(column) == value, F.lit(False)))


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def cascade(children: DataFrame, removed: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children that stay when the parents in ``removed`` go."""
    return children.join(removed.select(F.col(key).alias(foreign)), foreign, "left_anti")


def short_title(c: str, limit: int = 60):
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(F.coalesce(F.col(c), F.lit("")))


def export_csv(df: DataFrame, path: str) -> None:
    """One header per file, quoted, empty text for null."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
