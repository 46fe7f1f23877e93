"""Files as a DataFrame: (path, size, text, in_scope, in_secret_scope), from folders and from tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename

MAX_BYTES = 3_000_000
# Folders that no engine but the secrets engine enters, and those that it skips.
SKIP_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "bower_components", "venv", ".venv", "env", ".env.d", "virtualenv", "__pycache__",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "dist", "build", "out", ".next", ".nuxt", ".svelte-kit",
    "target", "vendor", ".gradle", ".idea", ".vs", ".vscode-test", "site-packages", ".terraform", "coverage", ".coverage",
    ".cache", ".parcel-cache", ".yarn", "Pods", ".dart_tool",
]
SECRETS_SKIP_DIRS = [".git", ".hg", ".svn"]
# Extensions and names of text files, and the hooks that git runs.
TEXT_EXTENSIONS = [
    ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".svelte", ".java", ".kt", ".kts", ".scala", ".groovy", ".go", ".rs", ".rb",
    ".php", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".swift", ".m", ".mm", ".dart", ".sh", ".bash", ".zsh", ".ps1", ".psm1", ".bat", ".cmd", ".pl",
    ".lua", ".r", ".sql", ".graphql", ".proto", ".html", ".htm", ".xml", ".svg", ".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf",
    ".env", ".properties", ".tf", ".tfvars", ".hcl", ".md", ".markdown", ".mdx", ".mdc", ".rst", ".txt", ".text", ".dockerfile", ".gitconfig", ".npmrc",
    ".pem", ".key", ".crt", ".cer", ".pub", ".asc", ".ppk", ".pk8",
]
GIT_HOOKS = [
    "applypatch-msg", "pre-applypatch", "post-applypatch", "pre-commit", "pre-merge-commit", "prepare-commit-msg", "commit-msg", "post-commit",
    "pre-rebase", "post-checkout", "post-merge", "pre-push", "pre-receive", "update", "proc-receive", "post-receive", "post-update",
    "reference-transaction", "push-to-checkout", "pre-auto-gc", "post-rewrite", "sendemail-validate", "fsmonitor-watchman", "post-index-change",
]
TEXT_NAMES = GIT_HOOKS + [
    "dockerfile", "makefile", "procfile", "jenkinsfile", "vagrantfile", ".env", ".env.local", ".env.production", ".env.development", ".env.example",
    ".npmrc", ".netrc", ".pypirc", ".dockercfg", ".gitconfig", "claude.md", "agents.md", "skill.md", "readme", "readme.md", ".cursorrules", ".clinerules",
    ".windsurfrules", ".roorules", ".aiderrules", ".goosehints", ".continuerules", "copilot-instructions.md", "gemini.md", "qwen.md",
    "cline_instructions.md", "gemfile", "rakefile", "berksfile", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa.pub",
]
CODE_EXTENSIONS = [
    ".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".java", ".kt", ".kts", ".go", ".rb", ".php", ".cs", ".c", ".h", ".cc", ".cpp", ".hpp",
    ".cxx", ".rs", ".swift", ".scala", ".sh", ".bash", ".sol", ".ex", ".exs", ".lua", ".dart", ".m", ".mm", ".clj", ".cljs", ".hcl", ".tf", ".vue",
]


def splitext(name: Column) -> Column:
    """The suffix of a name as Python's os.path.splitext has it: leading dots begin no suffix."""
    return F.regexp_extract(name, r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1)


def scannable(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.isin(TEXT_NAMES) | splitext(name).isin(TEXT_EXTENSIONS) | name.startswith(".env")


def outside(path: Column, skip: list[str]) -> Column:
    """Whether none of a path's folders is in ``skip``."""
    parts = F.split(path, "/")
    return ~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(skip))


def excluded(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def probably_binary(content: Column, sniff: int = 4096) -> Column:
    """By the first bytes: a NUL, or over 30 % control characters and bytes that are no UTF-8."""
    head = F.substring(content, 1, sniff)
    text = head.cast("string")
    odd = F.length(F.regexp_replace(text, r"[^\x01-\x08\x0B\x0E-\x1F\x7F\x{FFFD}]+", ""))
    nul = F.hex(head).rlike(r"^(?:..)*?00")
    return F.coalesce(F.length(head) > 0, F.lit(False)) & (nul | (odd / F.greatest(F.lit(1), F.length(text)) > 0.30))


def scoped(files: DataFrame, excludes: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size, content) -> files that are text, with both scopes; metadata is judged before contents."""
    kept = files.where(scannable(F.col("path")) & (F.col("size") <= max_bytes) & ~excluded(F.col("path"), excludes or []))
    kept = kept.withColumn("in_scope", outside(F.col("path"), SKIP_DIRS)).withColumn("in_secret_scope", outside(F.col("path"), SECRETS_SKIP_DIRS))
    kept = kept.where("in_secret_scope").where(~F.when(F.col("size") > 0, probably_binary(F.col("content"))).otherwise(False))
    return kept.select("path", "size", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.col("content").cast("string").alias("text"), "in_scope", "in_secret_scope")


def from_folder(spark: SparkSession, target: str, excludes: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files of a local tree. Spark's folder listing hides names with a leading dot or underscore, so the driver lists."""
    target = os.path.abspath(target)
    if os.path.isfile(target):
        root, found = os.path.dirname(target), [target]
    else:
        root, found = target, []
        for at, dirs, names in os.walk(target, followlinks=False):
            dirs[:] = sorted(d for d in dirs if d not in SECRETS_SKIP_DIRS)
            found += [os.path.join(at, n) for n in sorted(names)]
    found = [p for p in found if os.path.isfile(p) and os.path.getsize(p) <= max_bytes]
    if not found:
        return spark.createDataFrame([], "path string, size long, valid boolean, text string, in_scope boolean, in_secret_scope boolean")
    read = spark.read.format("binaryFile").load(["file://" + p for p in found])
    relative = F.expr(f"substring(regexp_replace(url_decode(replace(path, '+', '%2B')), '^file:/+', '/'), {len(root.rstrip('/')) + 2})")
    return scoped(read.select(relative.alias("path"), F.col("length").alias("size"), "content"), excludes, max_bytes)


def from_table(rows: DataFrame, path: Column, text: Column, excludes: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows that already hold text, under a path made of their columns."""
    text = F.coalesce(text, F.lit(""))
    files = rows.select(path.alias("path"), F.octet_length(text).cast("long").alias("size"), F.lit(True).alias("valid"), text.alias("text"))
    kept = files.where(scannable(F.col("path")) & (F.col("size") <= max_bytes) & ~excluded(F.col("path"), excludes or []))
    kept = kept.withColumn("in_scope", outside(F.col("path"), SKIP_DIRS)).withColumn("in_secret_scope", outside(F.col("path"), SECRETS_SKIP_DIRS))
    return kept.where("in_secret_scope")


def code_files(files: DataFrame) -> Column:
    """How many files an external matcher of code could open; an aggregate."""
    return F.count_if(splitext(F.lower(basename(F.col("path")))).isin(CODE_EXTENSIONS) & F.col("in_scope"))
