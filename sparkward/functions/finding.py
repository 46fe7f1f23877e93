"""The schema of a finding, and how detectors build one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "engine string, rule_id string, title string, severity int, confidence int, file string, line int, end_line int, category string, description string, "
    "snippet string, fix string, cwe string, owasp string, `references` array<string>, corroborated_by array<string>, specificity int, filtered boolean, "
    "filter_reason string, dedup_key string, seq struct<engine: int, detector: int, line: int, rule: int, at: int>"
)
COLUMNS = [f.split()[0].strip("`") for f in SCHEMA.split(", seq")[0].split(", ")] + ["seq"]
#: The order in which engines emit.
ENGINES = ["secrets", "aisec", "sast", "sca"]


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(engine: str, detector: int, rule: int | Column = 0, at: int | Column = 0, **given) -> Column:
    """A finding as a struct; what is not given is empty, 0, MEDIUM confidence or false."""
    default = {
        "title": "", "severity": 0, "confidence": 1, "file": "", "line": 0, "end_line": 0, "category": "", "description": "", "snippet": "", "fix": "",
        "cwe": "", "owasp": "", "references": F.array().cast("array<string>"), "corroborated_by": F.array().cast("array<string>"), "specificity": 0,
        "filtered": False, "filter_reason": "", "dedup_key": "",
    }
    values = {"engine": engine, "rule_id": "", **default, **given}
    seq = F.struct(
        F.lit(ENGINES.index(engine)).alias("engine"), F.lit(detector).alias("detector"), as_column(values["line"]).cast("int").alias("line"),
        as_column(rule).cast("int").alias("rule"), as_column(at).cast("int").alias("at"),
    )
    ints = {"severity", "confidence", "line", "end_line", "specificity"}
    cells = []
    for name in COLUMNS[:-1]:
        c = as_column(values[name])
        cells.append((c.cast("int") if name in ints else c).alias(name))
    return F.struct(*cells, seq.alias("seq"))


def unfolded(rows: DataFrame, structs: Column) -> DataFrame:
    """A row for each finding in an array of them."""
    return rows.select(F.explode(structs).alias("f")).select("f.*")


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
