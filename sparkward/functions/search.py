"""Which of many tests a text or each of its lines passes: automata that read every byte once (RE2, by way of Arrow), where a search for each word reads it once a word."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters beyond ASCII that case folding makes ASCII ones.
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def any_case(word: str) -> str:
    """A pattern of a word in lower case that finds it in any case."""
    # no classes of letters beyond ASCII: where Arrow tells a match's place, it reads bytes
    return "".join("(?:" + "|".join([f"[{c}{c.upper()}]", *FOLDED.get(c, "")]) + ")" if c.isalpha() else re.escape(c) for c in word)


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def finder(tests: list[tuple[str, ...]]) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to the numbers of the tests that each passes; null texts pass those that ask for nothing.

    A test is the patterns that a text must hold, the rarest first. One automaton looks for the first patterns of all tests at once; only
    in texts with a hit are they told apart. Patterns with braces (counts, code points) are searched one by one, as they would multiply its states.
    """
    keys = [t[0] for t in tests if t and "{" not in t[0]]
    together = any_of(keys) if keys else ""
    # classes of nothing but code points beyond ASCII, which only texts of more bytes than characters can hold
    wide = {t[0] for t in tests if t and re.fullmatch(r"\[(?:\\x\{[0-9A-F]+\}-?)+\]", t[0]) and min(int(x, 16) for x in re.findall(r"\{([0-9A-F]+)\}", t[0])) > 0x7F}

    # nested, so that workers get them by value: they need not have this package to import
    def found(text: pa.Array, some: np.ndarray, pattern: str) -> np.ndarray:
        picked = text if len(some) == len(text) else text.take(pa.array(some))
        return some[pc.fill_null(pc.match_substring_regex(picked, pattern), False).to_numpy(zero_copy_only=False)]

    def run(text: pa.Array) -> pa.Array:
        rows, numbers = [], []
        every = np.arange(len(text))
        some = found(text, every, together) if together else every[:0]
        foreign = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(text), pc.utf8_length(text)), False)) if wide else every
        for number, patterns in enumerate(tests):
            if not patterns:
                hit = every
            elif "{" in patterns[0]:
                hit = foreign if patterns[0] in wide else every
            else:
                hit = some
            for pattern in patterns:
                hit = found(text, hit, pattern)
            rows.append(hit)
            numbers.append(np.full(len(hit), number, np.int32))
        rows, numbers = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (rows, numbers))
        order = np.argsort(rows, kind="stable")
        offsets = np.searchsorted(rows[order], np.arange(len(text) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[order]))

    return run


def line_finder(tests: list[tuple[str, ...]]) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to those of their lines that pass any test: each with its number from 1, between its neighbours, and with the numbers of its tests.

    Lines are those of ``split_lines``. What a line costs does not hang on the text around it: in a whole text, a word of each test stands somewhere.
    """
    passed = finder(tests)

    def bare(lines: pa.Array, at: np.ndarray, there: np.ndarray) -> pa.Array:
        return pc.replace_substring_regex(lines.take(pa.array(at, mask=~there)), r"\r\z", "")

    def run(text: pa.Array) -> pa.Array:
        parts = pc.split_pattern(text, "\n")
        lines, offsets = parts.values, parts.offsets.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(text)), np.diff(offsets))
        ends = offsets[row + 1]
        # what stands behind a text's last line feed is a line unless it is empty
        ends -= pc.binary_length(lines).to_numpy(zero_copy_only=False)[ends - 1] == 0
        held = passed(lines)
        at = np.flatnonzero((np.diff(held.offsets.to_numpy()) > 0) & (np.arange(len(lines)) < ends))
        number, line = at - offsets[row[at]] + 1, bare(lines, at, at >= 0)
        around = pc.binary_join_element_wise(bare(lines, at - 1, number > 1), line, bare(lines, at + 1, at + 1 < ends[at]), " ", null_handling="skip")
        kept = pa.StructArray.from_arrays([pa.array(number, pa.int32()), line, around, held.take(pa.array(at))], ["line_no", "line", "around", "held"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(text) + 1)), pa.int32()), kept)

    return run


def lines_held(text: Column | str, tests: list[tuple[str, ...]]) -> Column:
    """The lines of a text that pass any test, as array<struct<line_no, line, around, held>>."""
    run = line_finder(tests)

    def of(texts: pa.Array) -> pa.Array:
        return run(texts)

    return F.arrow_udf(of, "array<struct<line_no: int, line: string, around: string, held: array<int>>>")(text)
