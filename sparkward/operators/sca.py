"""Vulnerable dependencies from the JSON of three audit tools; a package is one row, with all its advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cvss import advisory_severity
from ..functions.finding import finding, unfolded
from ..functions.text import SEVERITIES, basename, label, severity

# Manifests by exact name, and folders that are not searched.
PY_MANIFESTS = ["requirements.txt", "requirements-dev.txt", "requirements.in", "Pipfile.lock", "poetry.lock", "pyproject.toml"]
NODE_MANIFESTS = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml"]
MANIFESTS = PY_MANIFESTS + NODE_MANIFESTS + ["go.mod", "go.sum", "Cargo.lock", "Gemfile.lock", "composer.lock", "pom.xml", "build.gradle", "gradle.lockfile", "mix.lock"]
SKIP = [".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "vendor"]
OWASP = "A06:2021 Vulnerable and Outdated Components"
OSV = (
    "results array<struct<source: struct<path: string>, packages: array<struct<package: struct<name: string, version: string>, vulnerabilities: array<struct<id: string, "
    "summary: string, details: string, severity: array<struct<type: string, score: string>>, database_specific: struct<severity: string, cwe_ids: array<string>>, "
    "affected: array<struct<ranges: array<struct<events: array<struct<introduced: string, fixed: string>>>>>>, `references`: array<struct<url: string>>>>>>>>"
)
PIP_DEPENDENCY = "array<struct<name: string, version: string, vulns: array<struct<id: string, fix_versions: array<string>, severity: string, cvss: string, cvss_vector: string, vector: string>>>>"


def manifests(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return files.where(basename(F.col("path")).isin(MANIFESTS) & ~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(SKIP)))


def _some(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _preview(ids: Column) -> Column:
    more = F.concat(F.lit(" (+"), (F.size(ids) - 8).cast("string"), F.lit(" more)"))
    return F.concat(F.array_join(F.slice(ids, 1, 8), ", "), F.when(F.size(ids) > 8, more).otherwise(""))


def _plural(n: Column, stem: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" known {stem}"), F.when(n == 1, "y").otherwise("ies"))


def _fix(name: Column, fixed: Column) -> Column:
    return F.when(fixed != "", F.concat(F.lit("Upgrade "), name, F.lit(" to "), fixed, F.lit(" (or later)."))).otherwise(F.concat(F.lit("Update "), name, F.lit("; see the advisories.")))


def osv_findings(reports: DataFrame, root: str = "") -> DataFrame:
    """(json) rows of osv-scanner -> findings. Everything about a package happens inside its row."""
    rows = reports.select(F.explode(F.from_json("json", OSV)["results"]).alias("r"))
    rows = rows.select(F.coalesce("r.source.path", F.lit("")).alias("file"), F.posexplode("r.packages").alias("at", "p"))
    vulns = F.col("p.vulnerabilities")
    rows = rows.where(vulns.isNotNull() & (F.size(vulns) > 0))
    rows = rows.withColumns({
        "file": F.expr(f"if(startswith(file, '{root}/'), substring(file, {len(root) + 2}), file)") if root else F.col("file"),
        "name": F.coalesce("p.package.name", F.lit("?")), "ver": F.coalesce("p.package.version", F.lit("?")), "n": F.size(vulns),
        "sevs": F.transform(vulns, lambda v: advisory_severity(v["database_specific"]["severity"], F.transform(v["severity"], lambda s: s["score"]))),
        "ids": F.filter(F.transform(vulns, lambda v: v["id"]), lambda x: F.coalesce(x, F.lit("")) != ""),
    })
    top = F.element_at(vulns, F.array_position("sevs", F.array_max("sevs")).cast("int"))
    said = F.when(F.coalesce(top["summary"], F.lit("")) != "", top["summary"]).otherwise(F.coalesce(top["details"], F.lit("")))

    def fixes(v: Column) -> Column:
        events = F.flatten(F.flatten(F.transform(_some(v["affected"], "array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>"), lambda a: F.transform(a["ranges"], lambda g: g["events"]))))
        return F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(_some(events, "array<struct<introduced:string,fixed:string>>"), lambda e: e["fixed"]), lambda x: x.isNotNull()))), 1, 3)

    urls = F.flatten(F.transform(vulns, lambda v: F.filter(F.transform(F.slice(_some(v["references"], "array<struct<url:string>>"), 1, 2), lambda r: r["url"]), lambda u: u.isNotNull())))
    cwes = F.flatten(F.transform(vulns, lambda v: _some(v["database_specific"]["cwe_ids"], "array<string>")))
    rows = rows.withColumns({
        "sev": F.array_max("sevs"), "said": F.substring(said, 1, 200), "fixed": F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform(vulns, fixes)))), 1, 5), ", "),
        "cwes": F.array_join(F.slice(F.array_sort(F.array_distinct(cwes)), 1, 4), ", "), "urls": F.slice(urls, 1, 4),
    })
    first = F.try_element_at("ids", F.lit(1))
    link = F.when(first.isNotNull(), F.array(F.concat(F.lit("https://osv.dev/vulnerability/"), first))).otherwise(F.array().cast("array<string>"))
    made = finding(
        "sca", 0, at=F.col("at"), rule_id=F.coalesce(first, F.concat(F.lit("OSV-"), "name")), title=F.concat("name", F.lit(" "), "ver", F.lit(": "), _plural(F.col("n"), "vulnerabilit")),
        severity=F.col("sev"), confidence=2, file=F.col("file"), category="VULNERABLE_DEPENDENCY", snippet=F.concat("name", F.lit("@"), "ver"), fix=_fix(F.col("name"), F.col("fixed")),
        description=F.concat(
            "name", F.lit(" "), "ver", F.lit(" has "), _plural(F.col("n"), "advisor"), F.lit(" (highest severity "), label(F.col("sev"), SEVERITIES), F.lit("). "),
            F.when(F.col("said") != "", F.concat(F.lit("Most severe: "), "said", F.lit(". "))).otherwise(""), F.lit("IDs: "), _preview(F.col("ids")), F.lit(".")),
        cwe=F.col("cwes"), owasp=OWASP, references=F.concat("urls", link),
    )
    return unfolded(rows, F.array(made))


def pip_findings(reports: DataFrame) -> DataFrame:
    """(file, json) rows of pip-audit, in either of its shapes -> findings; unrated advisories count as MEDIUM at least."""
    deps = F.coalesce(F.from_json("json", f"dependencies {PIP_DEPENDENCY}")["dependencies"], F.from_json("json", PIP_DEPENDENCY))
    rows = reports.select("file", F.posexplode(deps).alias("at", "d")).where(F.size("d.vulns") > 0)
    vectors = lambda v: F.filter(F.array(v["cvss"], v["cvss_vector"], v["vector"]), lambda x: x.isNotNull())
    rows = rows.withColumns({
        "name": F.coalesce("d.name", F.lit("?")), "ver": F.coalesce("d.version", F.lit("?")), "n": F.size("d.vulns"),
        "ids": F.filter(F.transform("d.vulns", lambda v: v["id"]), lambda x: F.coalesce(x, F.lit("")) != ""),
        "sev": F.greatest(F.lit(2), F.array_max(F.transform("d.vulns", lambda v: advisory_severity(v["severity"], vectors(v))))),
        "fixed": F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform("d.vulns", lambda v: _some(v["fix_versions"], "array<string>"))))), 1, 5), ", "),
    })
    first = F.try_element_at("ids", F.lit(1))
    link = F.when(first.isNotNull(), F.array(F.concat(F.lit("https://osv.dev/vulnerability/"), first))).otherwise(F.array().cast("array<string>"))
    made = finding(
        "sca", 1, at=F.col("at"), rule_id=F.coalesce(first, F.lit("PYSEC")), title=F.concat("name", F.lit(" "), "ver", F.lit(": "), _plural(F.col("n"), "vulnerabilit")),
        severity=F.col("sev"), confidence=2, file=F.col("file"), category="VULNERABLE_DEPENDENCY", snippet=F.concat("name", F.lit("=="), "ver"), fix=_fix(F.col("name"), F.col("fixed")),
        description=F.concat("name", F.lit(" "), "ver", F.lit(" has "), F.col("n").cast("string"), F.lit(" known advisory record(s). IDs: "), _preview(F.col("ids")), F.lit(".")),
        owasp=OWASP, references=link,
    )
    return unfolded(rows, F.array(made))


def npm_findings(reports: DataFrame) -> DataFrame:
    """(file, json) rows of npm audit -> findings; ``via`` mixes names and objects, and only objects tell."""
    rows = reports.select("file", F.posexplode(F.from_json("json", "vulnerabilities map<string, string>")["vulnerabilities"]).alias("at", "name", "raw"))
    rows = rows.withColumn("v", F.from_json("raw", "severity string, via array<string>, fixAvailable string"))
    via = F.transform(F.filter(_some(F.col("v.via"), "array<string>"), lambda x: x.rlike(r"\A\s*\{")), lambda x: F.from_json(x, "title string, url string"))
    given = lambda f: F.filter(F.transform("via", lambda x: x[f]), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = rows.withColumn("via", via).withColumns({"titles": given("title"), "urls": given("url"), "sev": F.coalesce("v.severity", F.lit("moderate"))})
    said = F.substring(F.array_join("titles", "; "), 1, 400)
    made = finding(
        "sca", 2, at=F.col("at"), rule_id="npm-audit", title=F.concat("name", F.lit(": "), F.coalesce(F.try_element_at("titles", F.lit(1)), F.lit("known vulnerability"))),
        severity=severity(F.col("sev")), confidence=2, file=F.col("file"), category="VULNERABLE_DEPENDENCY", snippet=F.concat("name", F.lit(" ("), "sev", F.lit(")")),
        description=F.when(said != "", said).otherwise(F.concat("name", F.lit(" has a known vulnerability ("), "sev", F.lit(")."))),
        fix=F.concat(F.lit("Run `npm audit fix`"), F.when(F.col("v.fixAvailable") == "false", " --force").otherwise(""), F.lit(" to remediate "), "name", F.lit(".")),
        owasp=OWASP, references=F.slice("urls", 1, 4),
    )
    return unfolded(rows, F.array(made))


def report_status(tool: str, exit_status: int | None, output: str | None) -> tuple[str, str]:
    """Status and detail of an audit's output: silence and garbage are errors, never clean results."""
    import json

    if exit_status is None:
        return "unavailable", f"{tool}: not installed"
    if tool == "osv-scanner" and exit_status == 128:
        return "not-applicable", "no packages found to audit"
    if not (output or "").strip():
        return "error", f"{tool}: exit {exit_status}, no output"
    try:
        data = json.loads(output)
    except ValueError:
        return "error", f"{tool}: unparseable output (exit {exit_status})"
    if tool == "npm" and isinstance(data, dict) and "error" in data and "vulnerabilities" not in data:
        return "error", f"npm: {str((data['error'] or {}).get('summary', 'npm audit failed'))[:200]}"
    return "ok", tool


def choose(spark, reports: dict[str, DataFrame | None], statuses: dict[str, tuple[str, str]], has_manifest: bool, backend: str = "auto") -> tuple[DataFrame, str, str]:
    """The first usable of osv-scanner, pip-audit and npm: its findings, status and detail. An error is usable: it ends the chain."""
    from ..functions.finding import empty

    if not has_manifest and backend == "auto":
        return empty(spark), "not-applicable", "no dependency manifests/lockfiles found"
    makers = {"osv-scanner": osv_findings, "pip-audit": pip_findings, "npm": npm_findings}
    order = {"osv": ["osv-scanner"], "pip-audit": ["pip-audit"], "npm": ["npm"]}.get(backend, list(makers))
    tried = []
    for tool in order:
        status, detail = statuses.get(tool, ("unavailable", f"{tool}: not installed"))
        if status == "unavailable":
            tried.append(detail)
            continue
        if tried:
            detail += " | fallbacks: " + "; ".join(tried)
        rows = reports.get(tool)
        return (makers[tool](rows) if rows is not None and status == "ok" else empty(spark)), status, detail
    return empty(spark), "unavailable", "no SCA backend available (" + "; ".join(tried) + ")"
