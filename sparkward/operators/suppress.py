"""Contextual suppression. A pass only ever sets ``filtered`` and ``filter_reason``; without proof a finding stays live."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, java, split_lines, strip
from ..plans.shared import broadcast_if_small, written
from .line_rules import RULES

# Comment introducers by extension, ignore markers, frames, reasons, sinks.
HASH = [".py", ".pyi", ".pyw", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".yml", ".yaml", ".toml", ".ini", ".cfg", ".conf", ".env", ".rb", ".pl", ".r"]
SLASH = [".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".cs", ".go", ".java", ".js", ".jsx", ".ts", ".tsx", ".kt", ".kts", ".php", ".rs", ".swift"]
MARKUP = [".html", ".htm", ".xml", ".svg", ".md", ".mdx"]
PYTHON = [".py", ".pyi", ".pyw"]
MARKER = r"(?i)(?<![A-Za-z0-9_])(?:nosec|nosemgrep|sparkward[:\-]ignore)(?![A-Za-z0-9_])"
FRAME = (
    r"(?i)(\bare all data\b|\bis all data\b|\bas data\b|\bare data\b|\bis data\b|\bnever a source of instruction|\bnot a source of instruction"
    r"|\bnot a direction to follow\b|\bnot an instruction\b|\bnot instructions\b|\bdo not follow\b|\bnever follow\b|\bmust not follow\b"
    r"|\bmention (it|them|this|that)?\s*in your report\b|\btreat[^.\n]{0,40}\b(as )?(untrusted|data|not instructions)\b|\bobject of study\b|\bnot a command\b)"
)
#: What is in all that the pattern above matches: far quicker to look for, as it asks for no edges of words.
FRAME_WORDS = r"(?i)(?:data|source of instruction|not (?:an )?instruction|follow|report|untrusted|study|command)"
QUOTE = "[\"'`“”‘’]"
IGNORED = "the line's own comment holds an ignore marker"
IN_COMMENT = "the match stands in a comment, and comments do not run"
IN_DOCSTRING = "the match stands in a docstring, and docstrings do not run"
EXEMPLAR = "the phrase is quoted as an example, and the text next to it says that such phrases are to be read as data"
INERT = "every string on the line stays a pattern or a name that no call receives"
SINKS = frozenset(
    [
    "system", "popen", "spawn", "spawnl", "spawnv", "execv", "execve", "execl", "run", "call", "check_call", "check_output", "Popen", "eval", "exec",
    "compile", "__import__", "open", "read_text", "write_text", "unlink", "remove", "rmtree", "urlopen", "get", "post", "put", "delete", "request",
    "connect", "send", "sendall", "loads",
]
)
PATTERN_CALLS = frozenset(["compile", "match", "search", "fullmatch", "findall", "finditer", "sub", "subn"])

#: A string literal as the line lexer sees it: up to a quote of its kind that no backslash precedes, or the line's end.
_STRINGS = r""""(?:[^"\\]++|\\"?)*+"?|'(?:[^'\\]++|\\'?)*+'?"""


def introducer(path: Column) -> Column:
    """What begins a comment in a file of this kind; null where nothing is sure to."""
    ext = extension(path)
    return F.when(ext.isin(HASH), "#").when(ext.isin(SLASH), "//").when(ext.isin(MARKUP), "<!--")


def comment_text(line: Column, path: Column) -> Column:
    """A line's comment without its string literals; empty if there is none."""
    bare = F.regexp_replace(line, _STRINGS, " ")
    begins = {"#": r"(?s)#.*", "//": r"(?s)//.*", "<!--": r"(?s)<!--.*"}
    intro = introducer(path)
    out = F.lit("")
    for word, pattern in begins.items():
        out = F.when(intro == word, F.regexp_extract(bare, pattern, 0)).otherwise(out)
    return out


def _commented(raw: Column, intro: Column) -> Column:
    """Whether a line has what begins a comment, outside of string literals or as its first word."""
    return F.coalesce(F.startswith(strip(raw), intro) | F.contains(F.regexp_replace(raw, _STRINGS, " "), intro), F.lit(False))


def is_python(path: Column) -> Column:
    """Whether what suppression asks of a line can hang on the whole text."""
    return extension(path).isin(PYTHON)


def has_docstrings(text: Column, path: Column) -> Column:
    """Whether a file is Python with a delimiter of docstrings; in any other, a line's label hangs on that line alone."""
    return is_python(path) & (F.contains(text, F.lit('"""')) | F.contains(text, F.lit("'''")))


def line_label(line: Column, path: Column) -> Column:
    """The letter of a line of a file without docstrings."""
    return F.when(_commented(line, introducer(path)), "m").otherwise("c")


def line_labels(lines: Column, path: Column) -> Column:
    """A letter for each line: d in a docstring, m with a comment, c code. Docstrings are a fold over the lines of Python files."""
    empty = F.lit(None).cast("string")
    begin = F.struct(empty.alias("inside"), F.lit("").alias("out"), introducer(path).alias("intro"), extension(path).isin(PYTHON).alias("python"))

    def step(state: Column, raw: Column) -> Column:
        stripped, intro, python = strip(raw), state["intro"], state["python"]  # what the path tells is worked out once a file
        delim = F.when(python & F.contains(raw, F.lit('"""')), '"""').when(python & F.contains(raw, F.lit("'''")), "'''")
        twice = F.length(raw) - F.length(F.replace(raw, delim, F.lit(""))) >= 6
        commented = _commented(raw, intro)
        opened = F.when(F.startswith(stripped, delim), "d").otherwise("c")
        letter = F.when(state["inside"].isNotNull(), "d").when(delim.isNotNull(), opened).when(commented, "m").otherwise("c")
        inside = (
            F.when(state["inside"].isNotNull(), F.when(~F.contains(raw, state["inside"]), state["inside"]))
            .when(delim.isNotNull() & ~twice, delim).otherwise(empty)
        )
        return F.struct(inside.alias("inside"), F.concat(state["out"], letter).alias("out"), intro.alias("intro"), python.alias("python"))

    # where nothing is known to begin a comment, every line is code
    return F.when(introducer(path).isNull(), F.repeat(F.lit("c"), F.size(lines))).otherwise(F.aggregate(lines, begin, step)["out"])


def _exemplar(line: Column, around: Column) -> Column:
    """Whether the rule's first match stands between quotes, and the lines around say that such text is data."""
    quoted = F.lit(False)
    for r in RULES:
        if r.category == "PROMPT_INJECTION":
            parts = F.split(line, java(r.pattern), 2)
            quoted = F.when(F.col("rule_id") == r.rule_id, (F.size(parts) == 2) & parts[0].rlike(QUOTE) & F.try_element_at(parts, F.lit(2)).rlike(QUOTE)).otherwise(quoted)
    # nested, because AND does not promise an order
    return F.coalesce(F.when(around.rlike(java(FRAME_WORDS)), F.when(quoted, around.rlike(java(FRAME)))), F.lit(False))


#: What becomes of a literal: read as a pattern, or held by these names alone; by none of any kind is doubt.
PATTERN, DOUBT = None, frozenset()


def literal_fates(source: str) -> tuple[list[tuple[int, int, frozenset | None]], set[str]]:
    """(first line, last line, fate) of every string literal of a Python file, and the names that are called or handed to a call.

    One walk down the tree. What is known of the things below a node travels with
    it: a call of ``re`` makes their fate a pattern, a sink makes it doubt, an assignment
    gives it the names assigned to, and any other statement begins in doubt; other nodes
    pass on what they were given. Names below an argument of a call that is not one of ``re`` are loose.
    """
    literals, loose = [], set()
    open_: list[tuple[ast.AST, frozenset | None, bool]] = [(ast.parse(source), DOUBT, False)]
    while open_:
        node, fate, handed = open_.pop()
        match node:
            case ast.Constant(value=str()):
                literals.append((node.lineno, node.end_lineno or node.lineno, fate))
            case ast.Name(id=name) if handed:
                loose.add(name)
            case ast.Call(func=ast.Attribute(value=ast.Name(id="re"), attr=verb)) if verb in PATTERN_CALLS:
                open_ += [(x, PATTERN, handed) for x in ast.iter_child_nodes(node)]
                continue
            case ast.Call(func=callee):
                verb = getattr(callee, "attr", getattr(callee, "id", ""))
                below = DOUBT if verb in SINKS else fate
                if isinstance(callee, ast.Name):
                    loose.add(verb)
                open_.append((callee, below, handed))
                open_ += [(x, below, True) for x in [*node.args, *node.keywords]]
                continue
            case ast.Assign(targets=targets):
                fate = frozenset(t.id for t in targets if isinstance(t, ast.Name))
            case ast.stmt():
                fate = DOUBT
        open_ += [(x, fate, handed) for x in ast.iter_child_nodes(node)]
    return literals, loose


def provably_inert(text: str, asked: list[int]) -> list[int]:
    """Of the lines asked for, those that hold literals of which each is a pattern or stays with its names. The source is parsed, never run."""
    try:
        literals, loose = literal_fates(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    safe: dict[int, bool] = {}
    wanted = set(asked)
    for first, last, fate in literals:
        stays = fate is PATTERN or bool(fate) and loose.isdisjoint(fate)
        for line in wanted.intersection(range(first, last + 1)):
            safe[line] = safe.get(line, True) and stays
    return sorted(line for line, ok in safe.items() if ok)


def inert_lines(text: pd.Series, lines: pd.Series) -> pd.Series:
    """Of the given lines of a file, those that are provably inert; a file is parsed once."""
    return pd.Series([provably_inert(t, [int(n) for n in a]) for t, a in zip(text, lines, strict=True)])


def suppress(findings: DataFrame, files: DataFrame, marker: str = MARKER, marked: DataFrame | None = None) -> DataFrame:
    """Inline markers, then comments and docstrings, then quoted exemplars, then reachability.

    What a finding asks of its file is worked out inside the file's row, once for
    each line asked about: texts are not shuffled while findings are few, and no more than the
    line and its neighbours ever travels with a finding.

    ``marked`` has the lines of all findings of files whose ``text`` is null: (path, line_no, line, around, whole), a row for each line, with ``whole`` false.
    Findings are then written already, and no text is read but the few that are there.
    """
    findings = written(findings) if marked is None else findings
    files = files if marked is None else files.where("text is not null")
    asked = findings.where("line > 0").groupBy("file").agg(
        F.collect_set("line").alias("asked"), F.bool_or(F.col("engine") == "aisec").alias("behaviour"),
    )
    asked = broadcast_if_small(written(asked))
    held = files.select(F.col("path").alias("file"), "text").join(asked, "file")
    # only docstrings need a walk over all lines; other labels are made of the lines asked about
    walked = F.when(F.col("behaviour") & has_docstrings(F.col("text"), F.col("file")), line_labels(F.col("lines"), F.col("file")))
    context = held.withColumn("lines", split_lines("text")).withColumn("labels", walked)
    facts = context.select("file", "lines", "labels", "behaviour", F.explode("asked").alias("line"))
    n = F.col("line")
    asked_line = F.try_element_at("lines", n)
    letter = F.coalesce(F.col("labels").substr(n, F.lit(1)), F.when(F.col("behaviour"), line_label(asked_line, F.col("file"))))
    facts = facts.select(
        "file", "line", asked_line.alias("__text"), letter.alias("__letter"),
        F.array_join(F.slice("lines", F.greatest(n - 1, F.lit(1)), F.when(n > 1, 3).otherwise(2)), " ").alias("__around"),
    )
    if marked is not None:
        file, line = F.col("path").alias("file"), F.col("line_no").alias("line")
        facts = facts.unionByName(marked.where("not whole").select(file, line, F.col("line").alias("__text"), line_label(F.col("line"), F.col("path")).alias("__letter"), F.col("around").alias("__around")))
    python = held.where(F.col("behaviour") & F.col("file").endswith(".py"))
    inert = python.select("file", F.explode(F.pandas_udf(inert_lines, "array<int>")("text", "asked")).alias("line")).withColumn("__inert", F.lit(True))
    rows = findings.join(facts, ["file", "line"], "left").join(inert, ["file", "line"], "left")
    line, letter = F.col("__text"), F.col("__letter")
    marked = F.coalesce(comment_text(line, F.col("file")).rlike(marker), F.lit(False))
    open_aisec = ~F.col("filtered") & (F.col("engine") == "aisec") & line.isNotNull()
    is_injection = F.col("category") == "PROMPT_INJECTION"
    reason = (
        F.when(marked, IGNORED)
        .when(open_aisec & (letter == "m"), IN_COMMENT)
        .when(open_aisec & (letter == "d"), IN_DOCSTRING)
        .when(open_aisec & is_injection & F.when(open_aisec & is_injection, _exemplar(line, F.col("__around"))).otherwise(False), EXEMPLAR)
        .when(open_aisec & F.coalesce("__inert", F.lit(False)), INERT)
    )
    rows = rows.withColumn("__reason", reason)
    rows = rows.withColumns({"filtered": F.col("filtered") | F.col("__reason").isNotNull(), "filter_reason": F.coalesce("__reason", "filter_reason")})
    return rows.select(*findings.columns)
