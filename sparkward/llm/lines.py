"""Cross-site boilerplate lines, in built-in functions only.

A line is boilerplate if it stands on at least ``min_sites`` sites (sources).
Every line hash gathers a HyperLogLog sketch of its sites; sketches merge by
partial aggregation, so a line that a third of all rows hold costs one sketch
a task. Lines whose estimate lies near the threshold, within six times the
sketch's error, are counted exactly; the others are decided by the sketch.

Texts are then rewritten inside the row. While there are at most ``inline``
boilerplate lines, their hashes go into the plan as a literal set and no text
is shuffled; beyond it, each document's boilerplate hashes are joined to it.
Both ways give the same rows.

Copies don't make a line spread: a text that stands in many documents counts
once, at the smallest of its sites, so a group of exact copies keeps its lines
for near-dedup to judge. Every other document loses each boilerplate line, however
much of it that is; near copies on ``min_sites`` sites lose the lines they share.

Defined cases: a null text has no lines and stays null; lines without a word
never count and stay; a null source counts as one site of its own; a null
doc_id is kept; repeated rows are rewritten each; other columns pass through, whatever
their names. Equal texts are told by two 64-bit hashes and the length, equal lines by one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import broadcast_if_small, written
from .names import fresh

MIN_SITES, INLINE = 8, 50_000
#: log2 of a sketch's registers; its relative error is 1.04 / sqrt(1024), and six times that is under 0.2.
LG_K, NEAR = 10, 0.2
HAS_WORD = r"[^\x20\x09-\x0D]"


def _hashes(text: str) -> Column:
    """Hashes of a text's distinct lines with a word."""
    return F.array_distinct(F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD)), lambda x: F.xxhash64(x)))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(site, line) hashes -> hashes of the lines on at least ``min_sites`` sites."""
    spread = written(
        lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - NEAR))
    )
    far = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites"))
    return far.union(exact.where(F.col("sites") >= min_sites).select("line"))


def _rewritten(docs: DataFrame, own: str, is_boilerplate) -> DataFrame:
    """``docs`` with the columns clean, n (lines) and gone (lines that go), named after ``own``."""
    split = F.split(F.col("text"), "\n")
    kept = docs.withColumn(f"{own}kept", F.filter(split, lambda x: ~(x.rlike(HAS_WORD) & is_boilerplate(F.xxhash64(x)))))
    return kept.withColumns({
        f"{own}clean": F.array_join(f"{own}kept", "\n"),
        f"{own}n": F.coalesce(F.size(split), F.lit(0)),
        f"{own}gone": F.coalesce(F.size(split) - F.size(f"{own}kept"), F.lit(0)),
    }).drop(f"{own}kept")


def _cleaned(docs: DataFrame, own: str, min_sites: int, inline: int) -> DataFrame:
    docs = docs.withColumn("text", F.col("text").cast("string"))
    site = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    text = [F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"), F.coalesce(F.length("text"), F.lit(-1)).alias("chars")]
    found = written(docs.select(key.alias("key"), site.alias("site"), *text, _hashes("text").alias("lines")))
    # copies speak for one site; which is only looked up for texts that repeat, so that lines stay where they are
    same = ["t", "u", "chars"]
    repeated = found.groupBy(*same).agg(F.min("site").alias("first_site"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    sited = found.join(broadcast_if_small(written(repeated)), same, "left").select(F.coalesce("first_site", "site").alias("site"), "lines")
    marked = written(boilerplate(sited.select("site", F.explode("lines").alias("line")), min_sites))
    few = marked.limit(inline + 1).collect()
    if len(few) <= inline:
        values = [r.line for r in few]
        return _rewritten(docs, own, (lambda h: h.isin(values)) if values else (lambda h: F.lit(False)))
    held = (
        found.select("key", F.explode("lines").alias("line")).join(marked, "line", "left_semi")
        .groupBy("key").agg(F.collect_set("line").alias(f"{own}marked"))
    )
    # two documents may share a key: a line is boilerplate whoever holds it, so their sets may mix
    joined = docs.withColumn(f"{own}key", key).join(held.withColumnRenamed("key", f"{own}key"), f"{own}key", "left").drop(f"{own}key")
    joined = joined.withColumn(f"{own}marked", F.coalesce(f"{own}marked", F.array().cast("array<bigint>")))
    return _rewritten(joined, own, lambda h: F.array_contains(F.col(f"{own}marked"), h)).drop(f"{own}marked")


def line_report(docs: DataFrame, min_sites: int = MIN_SITES, inline: int = INLINE) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_chars and the md5 of the clean text, a row for each document."""
    own = "__lines_"
    return _cleaned(docs.select("doc_id", "source", "text"), own, min_sites, inline).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{own}n").cast("long").alias("n_lines"), F.col(f"{own}gone").cast("long").alias("n_removed"),
        F.length(f"{own}clean").cast("long").alias("clean_chars"), F.md5(F.col(f"{own}clean").cast("binary")).alias("clean_md5"),
    )


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, inline: int = INLINE) -> DataFrame:
    """The documents with clean texts and n_chars, with the columns they came with."""
    own = fresh(docs, "lines")
    out = _cleaned(docs, own, min_sites, inline).withColumn("text", F.col(f"{own}clean"))
    if "n_chars" in docs.columns:
        changed = F.col(f"{own}gone") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
with texts as (select text, min(coalesce(source, chr(1))) as site from documents group by text),
lines as (
  select distinct site, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]'))) as line
  from texts),
marked as (select line from lines group by line having count(distinct site) >= {MIN_SITES}),
bag as (select list(line) as all_lines from marked),
cut as (
  select doc_id, text, string_split(text, chr(10)) as ls,
         list_filter(string_split(text, chr(10)), lambda x: not list_contains(coalesce(all_lines, []), x)) as kept
  from documents, bag),
clean as (select doc_id, text, len(ls) as n, len(ls) - len(kept) as gone, array_to_string(kept, chr(10)) as c from cut)
select doc_id, coalesce(n, 0)::bigint as n_lines, coalesce(gone, 0)::bigint as n_removed, length(c)::bigint as clean_chars, md5(c) as clean_md5
from clean
"""
