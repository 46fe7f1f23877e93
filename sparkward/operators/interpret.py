"""From raw findings to a ranked result: dedup, corroboration, false-positive filter, order, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.finding import COLUMNS
from ..functions.text import SEVERITIES, basename

# Which engine leads on a tie, lockfiles, generated assets, and paths that discuss security.
ENGINE_RANK = {"sca": 4, "sast": 3, "secrets": 2, "aisec": 1}
LOCKFILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "poetry.lock", "pdm.lock", "pipfile.lock", "uv.lock", "conda-lock.yml",
    "cargo.lock", "gemfile.lock", "composer.lock", "go.sum", "packages.lock.json", "flake.lock", "mix.lock", "podfile.lock", "package.resolved",
    "gradle.lockfile",
]
GENERATED = (".min.js", ".min.css", ".map", ".snap")
DOC_PATHS = ("readme", "changelog", "docs/", "/doc/", "license", "limits", "architecture")


def dedup_key() -> Column:
    """The first 16 hex digits of the SHA-256 of what makes two findings the same issue."""
    file = F.lower(F.replace("file", F.lit("\\"), F.lit("/")))
    cwe = F.upper(F.trim(F.split("cwe", ":")[0]))
    token = F.lower(F.substring(F.regexp_replace(F.when(F.col("snippet") != "", F.col("snippet")).otherwise(F.col("title")), r"[\s\x1c-\x1f\x85\p{Z}]+", ""), 1, 60))
    rule = F.lower(F.element_at(F.split("rule_id", r"\."), -1))
    basis = (
        F.when(F.col("category") == "VULNERABLE_DEPENDENCY", F.concat_ws("|", file, F.lit("dep"), "snippet", "rule_id"))
        .when(F.col("category") == "SECRET", F.concat_ws("|", file, F.col("line").cast("string"), F.lit("secret"), token))
        .otherwise(F.concat_ws("|", file, F.col("line").cast("string"), F.when(cwe != "", cwe).otherwise(rule)))
    )
    return F.substring(F.sha2(basis, 256), 1, 16)


def rank_columns() -> list[Column]:
    """The order of findings: live before filtered, then the gravest; ``seq`` settles what is left."""
    engine = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ENGINE_RANK.items() for x in kv]), F.col("engine")), F.lit(0))
    return [F.col("filtered"), -F.col("severity"), -F.col("confidence"), -engine, -F.col("specificity"), F.col("file"), F.col("line"), F.col("seq")]


def dedup(findings: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """One finding for each key: the first in rank order, with what corroborates it. One shuffle, by partial aggregation.

    ``columns`` are those of the result: the aggregation sorts whole rows, and no others are made, sorted or shuffled.
    """
    whole = [c for c in COLUMNS if c in {*columns, "engine", "rule_id"} and c != "dedup_key"]
    keyed = findings.withColumn("dedup_key", F.when(F.col("dedup_key") == "", dedup_key()).otherwise(F.col("dedup_key")))
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rank_columns())])
    groups = keyed.groupBy("dedup_key").agg(
        F.min_by(F.struct(*whole), order).alias("f"), F.array_sort(F.collect_set("engine")).alias("engines"), F.array_sort(F.collect_set("rule_id")).alias("rules")
    )
    many, other = F.size("engines") > 1, F.array_remove(F.col("rules"), F.col("f.rule_id"))
    both = F.concat(F.lit("  [Corroborated by "), F.size("engines").cast("string"), F.lit(" engines: "), F.array_join("engines", ", "), F.lit(" ("), F.array_join("rules", ", "), F.lit(")]"))
    also = F.concat(F.lit("  [Also matched by: "), F.array_join(other, ", "), F.lit(" -- reported as "), "f.rule_id", F.lit(" (most specific match)]"))
    note = F.when(many, both).when(F.size("rules") > 1, also).otherwise("")
    changed = {
        "confidence": F.when(many, 2).otherwise(F.col("f.confidence")),
        "corroborated_by": F.when((F.size("engines") > 1) | (F.size("rules") > 1), F.array_remove(F.col("engines"), F.col("f.engine"))).otherwise(F.col("f.corroborated_by")),
        "description": F.concat("f.description", note),
    }
    key = lambda c: F.col("dedup_key") if c == "dedup_key" else F.col(f"f.{c}")
    return groups.select(*[changed.get(c, key(c)).alias(c) for c in COLUMNS if c in columns])


def false_positive_reason() -> Column:
    """The first rule that calls a finding a likely false positive; null if none does."""
    file = F.lower("file")
    asset = basename(file).isin(LOCKFILES)
    for suffix in GENERATED:
        asset = asset | file.endswith(suffix)
    discussed = F.lit(False)
    for part in DOC_PATHS:
        discussed = discussed | F.contains(file, F.lit(part))
    weak = F.contains("description", F.lit("entropy")) & (F.contains("description", F.lit("2.")) | F.contains("description", F.lit("1.")) | F.contains("description", F.lit("0.")))
    return (
        F.when((F.col("rule_id") == "high-entropy-string") & asset, "high-entropy token in a lockfile/minified/generated asset (typically an integrity hash, not a secret)")
        .when((F.col("engine") == "aisec") & (F.col("confidence") == 0) & discussed, "low-confidence AI-security phrasing in documentation (frequently discusses these patterns by nature)")
        .when((F.col("rule_id") == "hardcoded-secret-assignment") & (F.col("confidence") == 0) & (F.col("severity") <= 2) & weak,
              "low-entropy value assigned to a secret-named variable (likely a config key, not a secret)")
    )


def filter_false_positives(findings: DataFrame) -> DataFrame:
    reason = false_positive_reason()
    return findings.withColumns({"filtered": F.col("filtered") | reason.isNotNull(), "filter_reason": F.coalesce(reason, F.col("filter_reason"))})


def interpret(findings: DataFrame) -> DataFrame:
    return filter_false_positives(dedup(findings))


def ranked(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*rank_columns())


def summary(findings: DataFrame) -> DataFrame:
    """One row: live findings by severity, zero where there are none, and both totals."""
    live = ~F.col("filtered")
    counts = [F.count_if(live & (F.col("severity") == i)).alias(s.lower()) for i, s in reversed(list(enumerate(SEVERITIES)))]
    return findings.agg(*counts, F.count_if(live).alias("total_active"), F.count_if(F.col("filtered")).alias("total_filtered"))
