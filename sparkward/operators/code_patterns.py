"""Single-line approximations of a structural code matcher's rules, and its one rule that is a regular expression.

A structural matcher reads syntax; these read one line and are named ``*-approx``:
calls that span lines are missed, and a call inside a string is found. They run
where no matcher's report is at hand, and never stand for its status.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finding import finding
from ..functions.text import cut, extension, strip
from .line_rules import LONGEST, lines_of, settled


class CodePattern(NamedTuple):
    rule_id: str
    title: str
    kinds: list[str]
    pattern: str
    severity: int
    cwe: str


PYTHON = [".py", ".pyi"]
SCRIPT = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
#: A call's opening bracket with something else behind it than one whole string literal.
OPEN = r"\((?!\s*(?:\"[^\"]*\"|'[^']*')\s*[,)])(?!\s*\))"
# CWE numbers and ranks of the rules.
PATTERNS = [
    CodePattern("py-os-system-concat-approx", "Shell command that is not a literal", PYTHON, rf"\bos\.system{OPEN}", 3, "CWE-78"),
    CodePattern("py-subprocess-shell-true-approx", "Subprocess through a shell", PYTHON, r"\bsubprocess\.\w+\(.*\bshell\s*=\s*True\b", 3, "CWE-78"),
    CodePattern("py-eval-exec-approx", "Evaluation of what is not a literal", PYTHON, rf"(?<![\w.])(?:eval|exec){OPEN}", 3, "CWE-95"),
    CodePattern("py-yaml-load-unsafe-approx", "YAML loaded without a safe loader", PYTHON, r"\byaml\.load\(\s*[^,()]+(?:\([^()]*\))?\s*\)", 3, "CWE-502"),
    CodePattern("py-pickle-loads-approx", "Pickle loaded", PYTHON, r"\bpickle\.loads?\(", 2, "CWE-502"),
    CodePattern("py-requests-verify-false-approx", "Certificates not verified", PYTHON, r"\brequests\.\w+\(.*\bverify\s*=\s*False\b", 2, "CWE-295"),
    CodePattern("py-flask-debug-true-approx", "Server run in debug mode", PYTHON, r"\w\.run\(.*\bdebug\s*=\s*True\b", 2, "CWE-489"),
    CodePattern("py-sql-fstring-approx", "SQL put together from parts", PYTHON, r"\.execute\(\s*(?:[fF][\"'][^\"']*\{|[\"'][^\"']*[\"']\s*[+%])", 3, "CWE-89"),
    CodePattern("py-weak-hash-approx", "Hash that collides", PYTHON, r"\bhashlib\.(?:md5|sha1)\(", 2, "CWE-327"),
    CodePattern("js-child-process-exec-concat-approx", "Command put together from parts", SCRIPT, r"(?:require\([\"']child_process[\"']\)\)?\.exec\(|(?<![\w.])(?:cp\.)?exec\([^,)]*\+)", 3, "CWE-78"),
    CodePattern("js-eval-approx", "Evaluation of what is not a literal", SCRIPT, rf"(?<![\w.])(?:eval{OPEN}|new\s+Function\()", 3, "CWE-95"),
    CodePattern("js-innerhtml-approx", "HTML set from what is not a literal", SCRIPT, r"\.innerHTML\s*=(?!=)(?!\s*(?:\"[^\"]*\"|'[^']*')\s*;?\s*$)", 2, "CWE-79"),
    CodePattern("ai-llm-output-to-shell-approx", "Model output that is run", PYTHON, r"(?:os\.system|subprocess\.\w+|(?<![\w.])(?:eval|exec))\(.*(?:\.choices\[\d+\]|completion|response\.\w+)", 3, "CWE-78"),
    CodePattern(
        "ai-hardcoded-system-prompt-secret", "Credential inside a prompt", PYTHON + SCRIPT,
        r"(?i)(system|prompt|content)\s*[:=]\s*[\"']?[^\"'\n]*(sk-[A-Za-z0-9]{20}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})", 2, "CWE-522",
    ),
]


def code_pattern_findings(files: DataFrame, patterns: list[CodePattern] = PATTERNS) -> DataFrame:
    """A finding for every pattern that a line of a file of its kind matches; lines of over 6,000 characters are left out."""
    kinds = sorted({k for p in patterns for k in p.kinds})
    lines = lines_of(files.where("in_scope").withColumn("kind", extension(F.col("path"))).where(F.col("kind").isin(kinds)), "kind")
    hits = [F.when(F.col("kind").isin(p.kinds), F.when(F.col("line").rlike(p.pattern), F.lit(i))) for i, p in enumerate(patterns)]
    rows = lines.where(F.length("line") <= LONGEST).withColumn("hits", F.filter(F.array(*hits), lambda x: x.isNotNull()))
    rows = settled(rows, F.size("hits") > 0).select("path", "line_no", "line", F.explode("hits").alias("i"))
    of = lambda field: F.element_at(F.array(*[F.lit(getattr(p, field)) for p in patterns]), F.col("i") + 1)
    made = finding(
        "sast", 1, rule=F.col("i"), rule_id=of("rule_id"), title=of("title"), severity=of("severity"), confidence=0, file=F.col("path"), line=F.col("line_no"), category="SAST",
        description=F.concat(of("title"), F.lit("; read from this line alone.")), snippet=cut(strip(F.col("line")), 200), cwe=of("cwe"),
    )
    return rows.select(made.alias("f")).select("f.*")
