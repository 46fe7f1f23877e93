"""Findings of an external code matcher, from its JSON, and a guard on what it opened. It is never run from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.finding import finding, unfolded
from ..functions.text import cut, severity, split_lines, strip

REPORT = "results array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: variant>>, paths variant, errors array<variant>"
NO_FIX = "See rule message and references for remediation."


def _text(v: str, path: str) -> Column:
    """A member of a variant if it is a string; null otherwise."""
    found = F.expr(f"try_variant_get({v}, '{path}')")
    return F.when(F.schema_of_variant(found) == "STRING", F.expr(f"try_variant_get({v}, '{path}', 'string')"))


def _first(v: str, path: str) -> Column:
    """A member that is a string, or the first of a list of them; empty otherwise."""
    return F.coalesce(_text(v, path), _text(v, path + "[0]"), F.lit(""))


def semgrep_findings(reports: DataFrame, files: DataFrame | None = None, root: str = "") -> DataFrame:
    """(json) rows -> findings; a snippet that the matcher withholds is read from ``files`` by an equi-join."""
    rows = reports.select(F.posexplode(F.from_json("json", REPORT)["results"]).alias("at", "r")).select("at", "r.*")
    path = F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/"))
    rows = rows.withColumns({
        "file": F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 20)).otherwise(path) if root else path,
        "rid": F.coalesce("check_id", F.lit("semgrep-rule")), "line_no": F.coalesce("start.line", F.lit(0)), "end_no": F.coalesce("end.line", F.lit(0)),
        "given": strip(F.coalesce(_text("extra", "$.lines"), F.lit(""))),
    })
    withheld = (F.col("given") == "") | (F.lower("given") == "requires login")
    if files is not None:
        wanted = rows.where(withheld).select("file").distinct()
        sources = files.select(F.col("path").alias("file"), split_lines("text").alias("source")).join(wanted, "file", "left_semi")
        rows = rows.join(sources, "file", "left")
        own = F.when(F.col("line_no") > 0, F.try_element_at("source", F.greatest("line_no", F.lit(1))))
        rows = rows.withColumn("given", F.when(withheld, strip(F.coalesce(own, F.lit("")))).otherwise(F.col("given")))
    else:
        rows = rows.withColumn("given", F.when(withheld, "").otherwise(F.col("given")))
    short = F.element_at(F.split("rid", r"\."), -1)
    impact, sure = F.upper(_first("extra", "$.metadata.impact")), F.upper(_first("extra", "$.metadata.confidence"))
    cwe, title, category = _first("extra", "$.metadata.cwe"), _text("extra", "$.metadata.shortDescription"), _first("extra", "$.metadata.category")
    filled = lambda c: F.when(strip(c) != "", c)
    refs = F.coalesce(F.expr("try_variant_get(extra, '$.metadata.references', 'array<string>')"), F.array().cast("array<string>"))
    made = finding(
        "sast", 0, at=F.col("at"), rule_id=short, title=F.coalesce(F.when(title != "", title), F.replace(short, F.lit("-"), F.lit(" "))),
        severity=F.when(impact == "CRITICAL", 4).when(impact == "HIGH", 3).otherwise(severity(F.coalesce(_text("extra", "$.severity"), F.lit("WARNING")))),
        confidence=F.when(sure == "HIGH", 2).when(sure == "LOW", 0).otherwise(1), file=F.col("file"), line=F.col("line_no"), end_line=F.col("end_no"),
        category=F.upper(F.when(category != "", category).otherwise("SAST")), description=cut(strip(F.coalesce(_text("extra", "$.message"), F.lit(""))), 600), snippet=cut(F.col("given"), 200),
        fix=cut(F.coalesce(filled(_text("extra", "$.fix")), filled(_text("extra", "$.metadata.fix")), F.lit(NO_FIX)), 400),
        cwe=F.when(F.upper(cwe).startswith("CWE"), cwe).otherwise(""), owasp=_first("extra", "$.metadata.owasp"), references=F.concat(F.slice(refs, 1, 5), F.array(F.concat(F.lit("semgrep:"), "rid"))),
    )
    return unfolded(rows, F.array(made))


def opened_files(reports: DataFrame) -> DataFrame:
    """One column, opened: how many files the matcher says it read; -1 where it does not say."""
    paths = F.from_json("json", REPORT)["paths"]
    listed = F.try_variant_get(paths, "$.scanned", "array<string>")
    return reports.select(F.when(listed.isNotNull(), F.size(listed)).otherwise(-1).alias("opened"))


def scope_status(enumerated: int, opened: int) -> tuple[str, str]:
    """Two independent counts must agree that something was read."""
    if opened == 0 and enumerated > 0:
        return "error", f"{enumerated} code file(s) are in scope here, but the matcher says that it opened none: its silence proves nothing"
    return "ok", ""
