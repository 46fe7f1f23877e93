"""Command line: scan a tree, print or write a report, and exit 0, 1, 2 or 3."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession

from . import __version__
from .functions.text import SEVERITIES, SEVERITY_WORDS
from .plans.report import as_json, as_text
from .plans.scan import Options, exit_code, scan
from .plans.shared import cleaned
from .sources.files import MAX_BYTES, from_folder


ENGINES = ("sast", "secrets", "sca", "aisec")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkward", allow_abbrev=False)
    p.add_argument("target", nargs="?", default=".")
    p.add_argument("--version", action="version", version=f"sparkward {__version__}")
    p.add_argument("--engines", default="all", help="all, or some of " + ",".join(ENGINES))
    p.add_argument("--format", choices=["text", "json", "both"], default="text")
    p.add_argument("--out")
    p.add_argument("--min-severity", choices=SEVERITIES, default="INFO")
    p.add_argument("--fail-on", choices=SEVERITIES)
    p.add_argument("--allow-degraded", action="store_true")
    p.add_argument("--sca-backend", choices=["auto", "osv", "pip-audit", "npm"], default="auto")
    p.add_argument("--sast-report", help="JSON that the code matcher wrote")
    p.add_argument("--sca-report", action="append", default=[], metavar="TOOL=FILE", help="JSON that osv-scanner, pip-audit or npm wrote")
    p.add_argument("--sca-exit", action="append", default=[], metavar="TOOL=STATUS", help="the exit status that a tool left with; 0 where it is not given")
    p.add_argument("--max-file-size", type=int, default=MAX_BYTES)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from .operators.sca import report_status

    parser = _parser()
    args = parser.parse_args(argv)
    engines = ENGINES if args.engines.strip() == "all" else tuple(e.strip() for e in args.engines.split(",") if e.strip())
    exits = dict(x.partition("=")[::2] for x in args.sca_exit)
    bad_exit = any(not re.fullmatch(r"-?\d+", n) for n in exits.values())
    if not os.path.exists(args.target) or not engines or set(engines) - set(ENGINES) or "" in args.exclude or bad_exit:
        parser.print_usage(sys.stderr)
        return 2
    given = spark
    spark = given or SparkSession.builder.appName("sparkward").getOrCreate()
    one = lambda path: open(path, encoding="utf-8", errors="replace").read()
    options = Options(engines, SEVERITY_WORDS[args.min_severity], args.fail_on and SEVERITY_WORDS[args.fail_on], args.allow_degraded, args.sca_backend, root=os.path.abspath(args.target))
    if args.sast_report:
        options.sast_reports = spark.createDataFrame([(one(args.sast_report),)], "json string")
    for named in args.sca_report:
        tool, _, path = named.partition("=")
        text = one(path)
        options.sca_statuses[tool] = report_status(tool, int(exits.get(tool, 0)), text)
        options.sca_reports[tool] = spark.createDataFrame([(os.path.basename(path), text)], "file string, json string")
    result = scan(spark, from_folder(spark, args.target, args.exclude, args.max_file_size), options)
    reports = {"txt": as_text(result, args.target, options.min_severity), "json": as_json(result, args.target, options.min_severity)}
    if args.out:
        os.makedirs(args.out, exist_ok=True)
        for kind, text in reports.items():
            with open(os.path.join(args.out, f"sparkward-report.{kind}"), "w", encoding="utf-8") as f:
                f.write(text)
    for kind, names in (("txt", ("text", "both")), ("json", ("json", "both"))):
        if args.format in names:
            print(reports[kind])
    code = exit_code(result, options)
    if given is None:
        cleaned(spark)
    if code == 3 and not args.quiet:
        print("not fully measured; see the engine status", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
