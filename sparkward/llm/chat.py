"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and all others as named users; the loss mask
covers the assistant's words and their end mark. Narrators (the system) keep
their own header and are nobody's perspective.

A rendering is one text. It is stored in parts of ``BLOCK`` turn numbers, and a
part in pieces of ``MOST`` segments, so that no row and no task must hold an endless
conversation; ``start`` is a part's place in the whole text and the mask counts from the
whole text's beginning, so that the parts in order are the rendering, however it is
cut. Where parts start follows from sums of lengths by conversation, role and part;
texts join those sums by conversation and part, so a conversation that holds a third of
all rows is dealt out like any other.

What people write can't end a turn or begin one: in texts and roles a backslash goes
between "<" (with any backslashes after it) and "|", and taking one out again gives the original;
roles lose "|>" in the same way and line breaks to spaces.

Defined cases: a null text is empty; a null role speaks as "unknown"; rows
with a null conv_id are one conversation with that id; null turns come last, in
parts of their own by a hash of the row; rows of one turn are ordered by role and text;
repeated rows are rendered each; a conversation of narrators alone is rendered
once, with a null perspective and no mask; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, MOST, NARRATORS = 4096, 16_384, ("system",)
END = "<|end|>\n"
ASSISTANT = "<|assistant|>\n"
#: Parts of rows without a turn: this and the next NULL_PARTS numbers.
NULL_PART, NULL_PARTS = 1 << 40, 4096


def _plain(text: Column) -> Column:
    """A text that holds no marker."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _header(role: str, perspective: str | None, narrators: tuple[str, ...]) -> str:
    if role in narrators:
        return f"<|{role}|>\n"
    return ASSISTANT if role == perspective else f"<|user name={role}|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    lost = F.lit(NULL_PART) + F.pmod(F.xxhash64("role", "text"), F.lit(NULL_PARTS))
    role = F.regexp_replace(_plain(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))), r"\|(\\*)>", r"|$1\\>")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.regexp_replace(role, r"[\r\n]", " ").alias("role"), _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    return turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / BLOCK), lost))


def _starts(turns: DataFrame, narrators: tuple[str, ...]) -> DataFrame:
    """(c, p, perspective, start): every part of a conversation in every perspective, and where it starts."""
    narrates = F.col("role").isin(*narrators) if narrators else F.lit(False)
    head = F.length("role") + F.when(narrates, len("<||>\n")).otherwise(len("<|user name=|>\n"))
    said = turns.groupBy("conv_id", "part", "role").agg(
        F.count("*").alias("n"), F.sum(head + F.length("text") + len(END)).alias("chars"), F.first(narrates).alias("narrates"),
    )
    # what a speaker's own headers are shorter by in that speaker's perspective
    own = said.where(~F.col("narrates")).select("conv_id", "part", F.col("role").alias("perspective"), (F.col("n") * (F.length("role") + (len("<|user name=|>\n") - len(ASSISTANT)))).alias("less"))
    parts = said.groupBy("conv_id", "part").agg(F.sum("chars").alias("chars"))
    voices = own.select("conv_id", "perspective").distinct()
    mute = parts.select("conv_id").distinct().join(voices.select(F.col("conv_id").alias("c")).distinct(), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    views = voices.unionByName(mute.withColumn("perspective", F.lit(None).cast("string")))
    whole = parts.join(views.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    # one row each, added up: no join of the two on keys with nulls
    sums = whole.select("conv_id", "part", "perspective", "chars", F.lit(1).alias("view")).unionByName(own.select("conv_id", "part", "perspective", (-F.col("less")).alias("chars"), F.lit(0).alias("view")))
    sums = sums.groupBy("conv_id", "part", "perspective").agg(F.sum("chars").alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "perspective", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"))


def render(conversations: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, perspective, part, piece, start, n_turns, text, and mask: [start, end) of the characters of the whole text that count."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = _turns(conversations)
    starts = _starts(turns, narrators)
    rows = turns.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    order = ["conv_id", "perspective", "part"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("turn").asc_nulls_last(), "role", "text")
    names = ["conv_id", "perspective", "part", "piece", "start", "n_turns", "text", "mask"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece, made, mask, first, at = None, 0, [], [], 0, 0
        out: list[tuple] = []

        def flush() -> None:
            out.append((*key, piece, first, len(made), "".join(made), list(mask)))
            made.clear()
            mask.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            out.clear()
            return rows

        for b in batches:
            columns = [b.column(n).to_pylist() for n in ("conv_id", "perspective", "part", "start", "role", "text")]
            for conv, view, part, start, role, text in zip(*columns, strict=True):
                if (conv, view, part) != key or len(made) == MOST:
                    if made:
                        flush()
                    if (conv, view, part) == key:
                        piece, first = piece + 1, at
                    else:
                        key, piece, first, at = (conv, view, part), 0, start, start
                head = _header(role, view, narrators)
                made.append(head + text + END)
                if role == view and role not in narrators:
                    mask.append({"start": at + len(head), "end": at + len(made[-1])})
                at += len(made[-1])
            yield batch()
        if made:
            flush()
        yield batch()

    kept = rows.select("conv_id", "perspective", "part", "start", "role", "text")
    return kept.mapInArrow(run, "conv_id long, perspective string, part long, piece int, start long, n_turns long, text string, mask array<struct<start: long, end: long>>")


def digest(rendered: DataFrame) -> DataFrame:
    """The rendering's sizes, md5 of its text and sum of its mask's bounds instead of text and mask."""
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda s, m: s + m["end"] - m["start"])
    bounds = F.aggregate("mask", F.lit(0).cast("long"), lambda s, m: s + m["end"] + m["start"])
    return rendered.select(
        "conv_id", "perspective", "part", "piece", "start", "n_turns", F.length("text").cast("long").alias("n_chars"),
        masked.alias("n_masked"), bounds.alias("mask_bounds"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


_SYSTEM = ", ".join(f"'{n}'" for n in NARRATORS)
ORACLE = f"""
with plain as (
  select conv_id, turn, regexp_replace(coalesce(text, ''), '<(\\\\*)\\|', '<\\1\\\\|', 'g') as text, turn // {BLOCK} as part,
         regexp_replace(regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\\\*)\\|', '<\\1\\\\|', 'g'), '\\|(\\\\*)>', '|\\1\\\\>', 'g'), '[\\r\\n]', ' ', 'g') as role
  from conversations),
voices as (select distinct conv_id, role as perspective from plain where role not in ({_SYSTEM})),
views as (select * from voices union all select conv_id, null from (select distinct conv_id from plain) where conv_id not in (select conv_id from voices)),
said as (
  select t.conv_id, perspective, part, turn, role, text,
         case when role in ({_SYSTEM}) then '<|' || role || '|>' || chr(10) when role = perspective then '<|assistant|>' || chr(10)
              else '<|user name=' || role || '|>' || chr(10) end as head
  from plain t join views v on t.conv_id = v.conv_id),
placed as (
  select *, sum(length(head) + length(text) + {len(END)}) over (partition by conv_id, perspective order by turn, role, text rows unbounded preceding)::bigint as ends from said)
select conv_id, perspective, part::bigint as part, 0::int as piece, min(ends - length(head) - length(text) - {len(END)})::bigint as "start", count(*)::bigint as n_turns,
       sum(length(head) + length(text) + {len(END)})::bigint as n_chars,
       sum(case when role = perspective then length(text) + {len(END)} else 0 end)::bigint as n_masked,
       sum(case when role = perspective then 2 * ends - length(text) - {len(END)} else 0 end)::bigint as mask_bounds,
       md5(string_agg(head || text || '<|end|>' || chr(10), '' order by turn, role, text)) as text_md5
from placed group by conv_id, perspective, part
"""
