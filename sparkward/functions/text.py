"""Lines, regular expressions with Python's classes, redaction, severities, entropy."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a pattern's classes mean, as Java classes.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
ASCII_SPACE = r"[\s\x1c-\x1f]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Severities and confidences by rank, and the words other tools use for them.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
CONFIDENCES = ["LOW", "MEDIUM", "HIGH"]
SEVERITY_WORDS = {
    "INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4, "ERROR": 3, "WARNING": 2,
    "MODERATE": 2, "IMPORTANT": 3, "SEVERE": 3, "NONE": 0, "UNKNOWN": 1,
}


def java(pattern: str, ascii_only: bool = False) -> str:
    """A pattern in Python's syntax as one for Spark, its classes and word edges reading Unicode alike; simpler if it only meets ASCII."""
    swap = {r"\b": EDGE, r"\s": SPACE, r"\S": NOT_SPACE, r"\w": WORD, r"\W": NOT_WORD, r"\d": r"\p{Nd}"}
    inside = {r"\s": SPACE[1:-1], r"\w": WORD[1:-1], r"\d": r"\p{Nd}"}
    if ascii_only:
        swap, inside = {r"\s": ASCII_SPACE, r"\S": f"[^{ASCII_SPACE[1:]}"}, {r"\s": ASCII_SPACE[1:-1]}
    out, in_class = [], False
    for token in re.findall(r"\\.|\[\^?|\]|[^\\\[\]]+", pattern, re.S):
        if token[0] == "[":
            in_class = True
        elif token == "]":
            in_class = False
        elif token[0] == "\\":
            token = (inside if in_class else swap).get(token, token)
        out.append(token)
    return re.sub(r"^\(\?([ims]+)\)", lambda m: f"(?{m[1]}{'u' if 'i' in m[1] and not ascii_only else ''}d)", "".join(out))


def split_lines(text: Column | str) -> Column:
    """Lines end at a line feed only; an empty last one goes, and so does one carriage return at a line's end."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda x: F.when(x.endswith("\r"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def severity(word: Column) -> Column:
    """The rank of a severity word; MEDIUM if unknown."""
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(strip(F.coalesce(word, F.lit(""))))), F.lit(2))


def label(rank: Column, names: list[str] = SEVERITIES) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank + 1)


def redact(secret: Column, keep: int = 4) -> Column:
    """Enough of a secret to find it again: its ends and length, or the first character of a short one."""
    s, n = F.coalesce(secret, F.lit("")), F.length(F.coalesce(secret, F.lit("")))
    short = F.concat(F.substring(s, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), n - 1)))
    long = F.concat(F.substring(s, 1, keep), F.lit("*" * 8), s.substr(n - (keep - 1), F.lit(keep)), F.lit(" (len="), n.cast("string"), F.lit(")"))
    return F.when(secret.isNull(), "").when(n <= 2 * keep, short).otherwise(long)


def redact_line(line: Column, secret: Column) -> Column:
    hidden = F.when(F.coalesce(secret, F.lit("")) == "", line).otherwise(F.replace(line, secret, redact(secret)))
    return cut(strip(hidden), 200)


def entropy(word: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    n = F.length(word)
    # counted by taking a character out: a split inside the lambda would be made anew for each character
    shares = F.transform(F.array_distinct(F.split(word, "")), lambda c: (n - F.length(F.replace(word, c, F.lit("")))).cast("double") / n.cast("double"))
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def extension(path: Column) -> Column:
    """The lower-case suffix of a path's last part, its dot included; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)(\.[^.]*)\z", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def line_at(text: Column, index: Column) -> Column:
    """The 1-based line of the character before which ``index`` characters stand."""
    before = text.substr(F.lit(1), index)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern with its line: array<struct<hit, line>>; ``group`` is what ``hit`` holds."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    hits = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    gaps = F.transform(F.slice(F.split(text, pattern), 1, F.size(whole)), feeds)
    step = F.arrays_zip(gaps.alias("gap"), F.transform(whole, feeds).alias("inside"), hits.alias("hit"))
    walk = F.aggregate(
        step,
        F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<hit:string,line:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["line"] + x["gap"] + x["inside"]).alias("line"),
            F.concat(s["out"], F.array(F.struct(x["hit"].alias("hit"), (s["line"] + x["gap"]).alias("line")))).alias("out"),
        ),
    )
    return walk["out"]
