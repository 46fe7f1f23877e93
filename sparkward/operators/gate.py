"""Statuses, gates and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status words and what they mean to a gate.
TRUSTED = ["ok", "not-applicable", "disabled"]
NOT_BROKEN = [*TRUSTED, "unavailable"]
MEASURED = ["ok"]
MARKS = {"ok": "[ran]", "not-applicable": "[n/a]", "disabled": "[off]", "unavailable": "[BLIND]", "error": "[error]"}


def _named(status: DataFrame) -> DataFrame:
    word = F.coalesce("status", F.lit(""))
    return status.select("engine", word.alias("status"), F.coalesce("detail", F.lit("")).alias("detail"))


def _without(status: DataFrame, words: list[str]) -> DataFrame:
    rows = _named(status).where(~F.col("status").isin(words))
    return rows.withColumn("status", F.when(F.col("status") == "", "?").otherwise(F.col("status"))).orderBy("engine")


def blind_spots(status: DataFrame) -> DataFrame:
    """Engines whose silence a gate may not trust."""
    return _without(status, TRUSTED)


def malfunctions(status: DataFrame) -> DataFrame:
    """Engines that broke, whether or not anything is gated."""
    return _without(status, NOT_BROKEN)


def measured(status: DataFrame) -> DataFrame:
    return _named(status).where(F.col("status").isin(MEASURED)).orderBy("engine")


def mark(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), status), F.lit("[BLIND]"))


def shown(findings: DataFrame, min_severity: int) -> DataFrame:
    """What a report shows; the gate still reads all."""
    return findings.where(F.col("filtered") | (F.col("severity") >= min_severity))


def exit_code(findings: DataFrame, status: DataFrame, file_count: int, fail_on: int | None, allow_degraded: bool = False) -> DataFrame:
    """One row, exit_code: 1 a finding at the threshold, 3 not (fully) measured, 0 otherwise."""
    words = _named(status).agg(
        F.count_if(~F.col("status").isin(TRUSTED)).alias("blind"), F.count_if(~F.col("status").isin(NOT_BROKEN)).alias("broken"), F.count_if(F.col("status").isin(MEASURED)).alias("measured")
    )
    if fail_on is None:
        return words.select(F.when((F.col("broken") > 0) & F.lit(not allow_degraded), 3).otherwise(0).alias("exit_code"))
    hit = findings.agg(F.coalesce(F.bool_or(~F.col("filtered") & (F.col("severity") >= fail_on)), F.lit(False)).alias("hit"))
    weak = (F.col("blind") > 0) | F.lit(file_count == 0) | (F.col("measured") == 0)
    one_each = hit.join(F.broadcast(words))  # one row on either side
    return one_each.select(F.when(F.col("hit"), 1).when(weak & F.lit(not allow_degraded), 3).otherwise(0).alias("exit_code"))
