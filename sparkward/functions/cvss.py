"""CVSS version 3 base scores and their severity bands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric weights of the CVSS v3 specification.
ATTACK_VECTOR = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
COMPLEXITY = {"L": 0.77, "H": 0.44}
INTERACTION = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
PRIVILEGES = {"N": 0.85, "L": 0.62, "H": 0.27}
PRIVILEGES_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}


def _weight(metric: Column, table: dict[str, float]) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(metric == key, value) if out is None else out.when(metric == key, value)
    return out


def base_score(vector: Column) -> Column:
    """The base score, rounded up to a tenth; null if a metric is missing or unknown."""
    def part(name: str) -> Column:
        found = F.regexp_extract_all(vector, F.lit(rf"(?:^|/){name}:([^/]*)"), F.lit(1))
        return F.try_element_at(found, F.lit(-1))  # a repeated metric's last value counts

    changed = F.coalesce(part("S") == "C", F.lit(False))
    rights = F.when(changed, _weight(part("PR"), PRIVILEGES_CHANGED)).otherwise(_weight(part("PR"), PRIVILEGES))
    lost = 1 - (1 - _weight(part("C"), IMPACT)) * (1 - _weight(part("I"), IMPACT)) * (1 - _weight(part("A"), IMPACT))
    impact = F.when(changed, 7.52 * (lost - 0.029) - 3.25 * F.pow(lost - 0.02, F.lit(15.0))).otherwise(6.42 * lost)
    ease = 8.22 * _weight(part("AV"), ATTACK_VECTOR) * _weight(part("AC"), COMPLEXITY) * rights * _weight(part("UI"), INTERACTION)
    raw = F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease)
    known = impact.isNotNull() & ease.isNotNull()
    return F.when(known & (impact <= 0), 0.0).when(known, F.ceil(F.least(raw, F.lit(10.0)) * 10).cast("double") / 10)


def band(score: Column) -> Column:
    return F.when(score >= 9, 4).when(score >= 7, 3).when(score >= 4, 2).when(score > 0, 1).when(score.isNotNull(), 0)


#: Advisory labels that decide a severity by themselves.
LABELS = {"CRITICAL": 4, "HIGH": 3, "MODERATE": 2, "MEDIUM": 2, "LOW": 1}


def advisory_severity(word: Column, vectors: Column) -> Column:
    """A label if it is known, else the band of the first CVSS 3 vector that has a score, else MEDIUM."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.upper(F.coalesce(word, F.lit(""))))
    third = F.filter(F.coalesce(vectors, F.array().cast("array<string>")), lambda v: v.startswith("CVSS:3"))
    scored = F.filter(F.transform(third, lambda v: band(base_score(v))), lambda s: s.isNotNull())
    return F.coalesce(named, F.try_element_at(scored, F.lit(1)), F.lit(2))
