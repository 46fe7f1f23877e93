"""The whole scan: detectors, suppression, interpretation, statuses, gate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.finding import ENGINES, empty
from ..functions.search import lines_held
from ..operators import gate, sast, sca
from ..operators.file_rules import from_mixed_words, from_unicode_hits, mixed_words, named, named_file_findings, odd_held, special, unicode_facts
from ..operators.interpret import interpret
from ..operators.line_rules import RULES, from_rule_hits, rule_hits, with_line_facts, words_held
from ..operators.secrets import from_secret_hits, secret_findings, secret_hits, signs_held
from ..operators.suppress import is_python, suppress
from ..sources.files import code_files
from .shared import written


@dataclass
class Options:
    engines: tuple[str, ...] = ("sast", "secrets", "sca", "aisec")
    min_severity: int = 0
    fail_on: int | None = None
    allow_degraded: bool = False
    sca_backend: str = "auto"
    #: tool -> (status, detail), and tool -> its JSON reports; for sast: one report DataFrame or None.
    sca_reports: dict = field(default_factory=dict)
    sca_statuses: dict = field(default_factory=dict)
    sast_reports: DataFrame | None = None
    root: str = ""


@dataclass
class Result:
    findings: DataFrame
    status: DataFrame
    file_count: int
    secret_file_count: int | None


TEXT_ENGINES = ("secrets", "aisec")


def _tests(engines: tuple[str, ...]) -> list[tuple[str, ...]]:
    return (words_held() + odd_held() if "aisec" in engines else []) + (signs_held() if "secrets" in engines else [])


def _read(files: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """Files with their ``lines`` that may have a hit, and with ``text`` only where a detector or suppression reads the whole of it: the one pass over all texts."""
    files = files.withColumn("lines", lines_held("text", _tests(engines)))
    whole = named() | (is_python(F.col("path")) & (F.size("lines") > 0))
    return files.withColumn("text", F.when(whole, F.col("text")))


def _marked(files: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """Lines with a hit of any line-level detector, of files as they are or as ``_read`` for the same engines."""
    tests = _tests(engines)
    files = files if "lines" in files.columns else _read(files, engines)
    lines = files.select("path", "in_scope", "in_secret_scope", F.col("text").isNotNull().alias("whole"), F.inline("lines"))
    lines = with_line_facts(lines.withColumn("candidates", F.filter("held", lambda x: x < len(RULES)))) if "aisec" in engines else lines
    hits = {}
    if "aisec" in engines:
        mixed, odd = (F.array_contains("held", len(RULES) + k) for k in range(2))
        ours = {"rules": rule_hits(), "mixed": F.when(mixed, mixed_words()), "odd": F.when(odd, unicode_facts())}
        hits |= {n: F.when(F.col("in_scope"), c) for n, c in ours.items()}
    if "secrets" in engines:
        signs = [F.array_contains("held", len(tests) - 3 + k) for k in range(3)]
        hits |= {"secrets": F.when(F.col("in_secret_scope"), secret_hits(signs=signs))}
    # the row number keeps Catalyst from matching every line twice, once in the filter
    marked = lines.select("path", "line_no", "line", "around", "whole", *[c.alias(n) for n, c in hits.items()], F.monotonically_increasing_id().alias("row"))
    some = F.lit(False)
    for n in hits:
        some = some | F.coalesce((F.col("odd.tags") > 0) | F.col("odd.bidi").isNotNull() | F.col("odd.invisible").isNotNull() if n == "odd" else F.size(n) > 0, F.lit(False))
    marked = written(marked.where((F.col("row") >= 0) & some).drop("row"))
    return marked.select("*", "odd.*").drop("odd") if "odd" in hits else marked


def aisec_findings(files: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    marked = _marked(files, ("aisec",)) if marked is None else marked
    few = written(special(files))
    return from_rule_hits(marked).unionByName(from_mixed_words(marked)).unionByName(from_unicode_hits(marked)).unionByName(named_file_findings(few))


def findings_of(files: DataFrame) -> DataFrame:
    """Text engines only, through suppression and interpretation; all texts are read once, and what is found is written."""
    read = written(_read(files, TEXT_ENGINES))
    marked = _marked(read, TEXT_ENGINES)
    found = written(from_secret_hits(marked).unionByName(aisec_findings(read, marked)))
    return interpret(suppress(found, read, marked=marked))


def scan(spark: SparkSession, files: DataFrame, options: Options | None = None) -> Result:
    """Runs the selected engines, each inside its own guard: what fails is an error in its status, never a clean result."""
    o = options or Options()
    unknown = set(o.engines) - set(ENGINES)
    if unknown or not o.engines:
        raise ValueError(f"unknown engines {sorted(unknown)}" if unknown else "no engine selected")
    texts = tuple(e for e in TEXT_ENGINES if e in o.engines)
    reported = o.sast_reports is not None or bool(o.sca_reports)
    # one pass over the texts for both text engines; where it fails, or reports ask about any line, whole files are written
    read = marked = None
    try:
        if texts:
            read = written(_read(files, texts))
            marked = _marked(read, texts)
    except Exception:  # noqa: BLE001
        marked = None  # each engine then reads the texts inside its own guard, and the fault is in its status
    if marked is None or reported:
        files = written(files)
    seen = files if marked is None else read
    counts = seen.agg(F.count_if("in_scope").alias("n"), F.count_if("in_secret_scope").alias("m"), F.count_if(~F.col("valid") & F.col("in_scope")).alias("bad"), F.count_if(~F.col("valid")).alias("all_bad"), code_files(seen).alias("code")).first()
    found, status = {}, []

    def engine(name: str, run) -> None:
        if name not in o.engines:
            status.append((name, "disabled", "not selected"))
            return
        try:
            rows, word, detail = run()
            rows = written(rows)  # forced here, so that a failure is this engine's
            status.append((name, word, f"{detail} ({rows.count()} finding(s))".strip()))
            found[name] = rows
        except Exception as e:  # noqa: BLE001
            status.append((name, "error", str(e).splitlines()[0][:300] if str(e) else type(e).__name__))

    def text_engine(make, bad: int):
        if bad:
            raise ValueError(f"{bad} file(s) are not valid UTF-8 and could not be read")
        return make(), "ok", "built-in rules"

    def matcher():
        if o.sast_reports is None:
            return empty(spark), "unavailable", "no matcher report given"
        opened = sast.opened_files(o.sast_reports).agg(F.sum("opened")).first()[0]
        word, detail = sast.scope_status(counts.code, opened if opened is not None else -1)
        return (sast.semgrep_findings(o.sast_reports, files, o.root) if word == "ok" else empty(spark)), word, detail or "matcher report"

    engine("secrets", lambda: text_engine(lambda: secret_findings(files) if marked is None else from_secret_hits(marked), counts.all_bad))
    engine("aisec", lambda: text_engine(lambda: aisec_findings(seen, marked), counts.bad))
    engine("sast", matcher)
    engine("sca", lambda: sca.choose(spark, o.sca_reports, o.sca_statuses, sca.manifests(seen).limit(1).count() > 0, o.sca_backend))

    def all_of(names: set[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [rows for name, rows in found.items() if name in names], empty(spark))

    if marked is None:
        rows = suppress(all_of(set(found)), files)
    else:
        rows = suppress(all_of(set(texts)), read, marked=marked)
        rows = rows.unionByName(suppress(all_of(set(found) - set(texts)), files)) if reported else rows
    result = written(interpret(rows))
    table = spark.createDataFrame(status, "engine string, status string, detail string")
    return Result(result, table, counts.n, counts.m if "secrets" in o.engines else None)


def exit_code(result: Result, options: Options) -> int:
    return gate.exit_code(result.findings, result.status, result.file_count, options.fail_on, options.allow_degraded).first().exit_code
