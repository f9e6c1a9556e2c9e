"""Reading the stored tables and collections."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "struct<pattern_id:string,pattern_type:string,pattern_value:string,description:string,success_count:int,failure_count:int,confidence_score:double,last_used:string,last_successful:string,applies_to:array<string>,created_date:string,avg_extraction_time:double,avg_items_found:double>"
SOURCE = f"struct<source_id:string,source_name:string,base_url:string,jurisdiction:string,extraction_patterns:map<string,{PATTERN}>,date_formats:array<string>,content_indicators:array<string>,overall_success_rate:double,avg_items_per_session:double,avg_extraction_time:double,learning_sessions:int>"
PROFILE = f"struct<jurisdiction_name:string,jurisdiction_code:string,source_profiles:map<string,{SOURCE}>,common_date_formats:array<string>,total_sources:int,avg_success_rate:double,total_learning_sessions:int>"
SESSIONS = "session_id string, timestamp string, source_id string, jurisdiction string, extraction_method string, patterns_used array<string>, success boolean, items_found int, extraction_time double, error_message string, new_patterns_discovered array<string>, patterns_reinforced array<string>, patterns_weakened array<string>, notes array<string>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A folder that driver and executors share, for what is stored between steps: spark.checkpoint.dir, or, in local
    mode alone, a temporary folder."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "docketlake-checkpoints")


def timestamp(c: Column) -> Column:
    """ISO or RFC-822 text (weekday or not) to a timestamp; null where neither fits."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy")))


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored profile: jurisdiction, profile. A file that can't be parsed gives none."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{PROFILE}>")).alias("jurisdiction", "profile"))


def sources_of(profiles: DataFrame) -> DataFrame:
    return profiles.select("jurisdiction", F.explode("profile.source_profiles").alias("source_id", "source"))


def patterns_of(profiles: DataFrame) -> DataFrame:
    return sources_of(profiles).select("jurisdiction", "source_id", F.explode("source.extraction_patterns").alias("pattern_id", "p")).select("jurisdiction", "source_id", "pattern_id", *(F.col(f"p.{x}").alias(x) for x in ("pattern_type", "pattern_value", "success_count", "failure_count", "confidence_score", "avg_items_found", "avg_extraction_time")))


def learning_sessions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SESSIONS).option("multiLine", True).json(path)
    return rows.withColumn("timestamp", timestamp(F.col("timestamp")))
