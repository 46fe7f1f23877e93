"""Baseline triage: the first structural reason that explains a finding away, from what stands before its line in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.shared import broadcast_if_small, written

# Predicates and what each means.
PREDICATES = {
    "P1-DETECTOR-SELF-MATCH": "SUPPRESS", "P2-COMMENT": "SUPPRESS", "P3-DOCSTRING": "SUPPRESS", "P4-FIXTURE-CORPUS": "SUPPRESS",
    "P5-DOC-PROSE": "SUPPRESS", "P6-TAXONOMY-LABEL": "SUPPRESS", "P7-REVIEW": "KEEP",
}
TAXONOMY = r"(?:CWE-\d+|LLM\d{2}|A\d{2}:\d{4})"


def line_facts(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(file, line, __line, depth, in_triple) of the lines asked for: brackets open before a line, and whether triple quotes before it are odd.

    ``asked`` has a row for each file, with ``lines``. Facts come from the text before the line, inside the file's row.
    """
    held = files.select(F.col("path").alias("file"), "text").join(broadcast_if_small(asked), "file")
    rows = held.select("file", "text", F.explode("lines").alias("line"))
    rows = rows.select(
        "file", "line", F.when(F.col("line") > 1, F.expr("substring_index(text, '\n', line - 1)")).otherwise("").alias("before"),
        F.regexp_replace(F.expr("substring_index(substring_index(text, '\n', line), '\n', -1)"), r"\r\z", "").alias("__line"),
    )
    count = lambda chars: F.length("before") - F.length(F.translate("before", chars, ""))
    triple = lambda q: (F.length("before") - F.length(F.replace("before", F.lit(q), F.lit("")))) / 3
    return rows.select("file", "line", "__line", (count("([{") - count(")]}")).alias("depth"), ((triple('"""') + triple("'''")).cast("int") % 2 == 1).alias("in_triple"))


def classify(findings: DataFrame, files: DataFrame, fixture_dir: str = "fixtures/", detector_dir: str = "detectors/") -> DataFrame:
    """Findings with ``predicate`` and ``disposition``; only files with findings are read."""
    findings = written(findings)
    asked = written(findings.where("line > 0").groupBy("file").agg(F.collect_set("line").alias("lines")))
    rows = findings.join(line_facts(files, asked), ["file", "line"], "left")
    text = strip(F.coalesce("__line", F.lit("")))
    found = (
        F.when(F.col("file").startswith(fixture_dir), "P4-FIXTURE-CORPUS").when(F.col("file").endswith(".md"), "P5-DOC-PROSE").when(text.startswith("#"), "P2-COMMENT")
        .when(text.rlike(TAXONOMY), "P6-TAXONOMY-LABEL")
        .when(F.col("file").startswith(detector_dir) & F.col("engine").isin("aisec", "secrets") & F.coalesce(F.col("depth") > 0, F.lit(False)), "P1-DETECTOR-SELF-MATCH")
        .when(F.coalesce("in_triple", F.lit(False)), "P3-DOCSTRING").otherwise("P7-REVIEW")
    )
    table = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    rows = rows.withColumn("predicate", found).withColumn("disposition", F.element_at(table, F.col("predicate")))
    return rows.select(*findings.columns, "predicate", "disposition")


def counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("predicate", "disposition").agg(F.count("*").alias("n"))
