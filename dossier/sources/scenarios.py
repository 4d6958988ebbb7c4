"""Labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {"item_no": "int", "text": "string", "expected": "string", "table": "string", "section": "string", "chunk_id": "string"}


def label_scenarios(rows: DataFrame) -> DataFrame:
    """Gold label (chunk, else table) and group (section, else table) of each scenario."""
    given = lambda c: F.when(F.length(F.coalesce(F.col(c), F.lit(""))) > 0, F.col(c))
    return rows.withColumns({
        "label": F.coalesce(given("chunk_id"), F.col("table"), F.lit("?")),
        "grp": F.coalesce(given("section"), F.col("table"), F.lit("?")),
    })


def read_scenario_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, reason, scenarios of every file below `path`: a JSON array of scenarios, whose fields may have drifted.

    reason is null for a good file; else `not JSON`, `no list of scenarios` or `scenario without fields`. Numbers written as
    text are read; an item number that is none is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(
        F.col("path").alias("file"), F.try_parse_json(F.try_validate_utf8(F.col("content").cast("string"))).alias("v")
    )
    found = files.withColumn("list", F.try_variant_get("v", "$", "array<variant>"))
    odd = F.exists("list", lambda x: F.schema_of_variant(x).startswith("OBJECT") == F.lit(False))
    reason = (
        F.when(F.col("v").isNull(), "not JSON").when(F.col("list").isNull(), "no list of scenarios")
        .when(F.coalesce(odd, F.lit(False)), "scenario without fields")
    )
    read = F.transform("list", lambda x: F.struct(*[F.try_variant_get(x, f"$.{n}", t).alias(n) for n, t in FIELDS.items()]))
    return found.withColumn("reason", reason).select("file", "reason", F.when(F.col("reason").isNull(), read).alias("scenarios"))


def read_scenarios(spark: SparkSession, path: str, pattern: str = "*", on_bad: str = "fail") -> DataFrame:
    """Labelled scenarios of all files. A bad file ends the job with its name (`fail`), or is left out (`leave_out`)."""
    if on_bad not in ("fail", "leave_out"):
        raise ValueError(f"on_bad is fail or leave_out, not {on_bad}")
    files = read_scenario_files(spark, path, pattern)
    stop = F.raise_error(F.concat(F.lit("scenarios "), F.col("file"), F.lit(": "), F.col("reason")))
    if on_bad == "fail":
        files = files.withColumn("scenarios", F.when(F.col("reason").isNotNull(), stop.cast(files.schema["scenarios"].dataType)).otherwise(F.col("scenarios")))
    return label_scenarios(files.select(F.explode_outer("scenarios").alias("s")).filter(F.col("s").isNotNull()).select("s.*"))
