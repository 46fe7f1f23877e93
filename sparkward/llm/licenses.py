"""License scans by ordered signature rules, in built-in functions only.

A text is read as a stream of lower-case words. Every rule is a regular
expression over that stream with keywords, a priority and a confidence. A
document that holds none of the gate's words is done after one pass; in the
others only rules of which a keyword occurs are run; every match of a rule
holds one of its keywords. Each match is an interval of
the stream; a match inside the interval of one of equal or higher priority is
suppressed, so "apache license version 2 0" is not also a bare "apache
license". The four base phrases are counted apart and always stay.

Rules are in ``license_rules``: signatures of what licenses, notices and headers say,
and names with their versions as they are granted, named or cited.

Defined cases: a null text is empty and has no words; a null doc_id is kept;
repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

#: What stands between words: ASCII that is neither digit nor letter. Letters are lowered after the split.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Every match of a rule and every base phrase holds one of these words.
GATE = (
    "license licence licenses licensed unlicense spdx cc cc0 commons creativecommons opendatacommons domain publicdomain gpl lgpl agpl gfdl bsd wtfpl granted notice warranty mit ncsa restriction consortium redistribution "
    "redistributions distribution contributors acknowledgement acknowledgment patent basis asl apache useful linking gcc texts royalty form mozilla eclipse opensolaris liable altered png jpeg freetype obtaining boost anyone law reserved "
    "just stuff evil charityware python package perl bsdl sil openssl cryptographic agreement fee information w3c unicode nasa mulan cecill rail openrail prohibited permission intellectual government"
).split()


def _found(docs: DataFrame) -> DataFrame:
    """Adds n_words, base counts and the surviving matches to (doc_id, text)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # lower() may change other letters than A-Z, but never where words begin and end, and no rule or phrase has a letter that another one becomes
    text = text.withColumn("words", F.array_remove(F.split(F.lower("text"), f"{GAP}+"), "")).drop("text")
    text = text.withColumn("n_words", F.size("words").cast("long"))
    # the word stream, with a space at both ends, of documents that hold one of the gate's words only
    gated = F.arrays_overlap("words", F.array(*map(F.lit, GATE)))
    text = text.withColumn("stream", F.when(gated, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))).drop("words")
    phrase = f"(?<= )(?:{'|'.join(BASE)})(?= )"
    text = text.withColumns({"cut": F.split("stream", phrase), "hits": F.regexp_extract_all("stream", F.lit(f"({phrase})"), F.lit(1))})
    words = lambda c: f"(length({c}) - length(replace({c}, ' ', '')))"
    text = text.withColumns({
        "n_base": F.coalesce(F.size("hits"), F.lit(0)).cast("long"),
        # the stream's pieces begin with a space or word and end with one: spaces before a match are the words before it, plus one
        "first_word": F.expr(f"case when size(hits) > 0 then cast({words('cut[0]')} - 1 as bigint) end"),
        "last_word": F.expr(f"case when size(hits) > 0 then cast(n_words - {words('element_at(cut, -1)')} - {words('element_at(hits, -1)')} as bigint) end"),
        "base": F.array_distinct(F.transform("hits", lambda h: F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), h))),
    }).drop("cut", "hits")
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<label string, keywords array<string>, regex string, priority int, confidence double>>")
    text = text.withColumn("rules", F.when(F.col("stream").isNotNull(), F.filter(table, lambda r: F.exists(r.keywords, lambda k: F.contains("stream", k)))))
    # one pass a rule: every match between two marks, which no stream holds
    places = """
      transform(array(split(regexp_replace(stream, r.regex, '\\u0001$0\\u0002'), '\\u0001')), ps -> aggregate(
        slice(ps, 2, 1000000000), struct(length(ps[0]) as at, cast(array() as array<struct<a: int, b: int>>) as out),
        (s, x) -> struct(s.at + length(x) - 1 as at, concat(s.out, array(struct(s.at as a, s.at + instr(x, '\\u0002') - 1 as b))) as out)
      ).out)[0]"""
    flat = f"flatten(transform(rules, r -> transform({places}, p -> struct(p.a as a, -p.b as z, -r.priority as y, r.label as label, r.confidence as confidence))))"
    text = text.withColumn("found", F.expr(f"sort_array({flat})")).drop("rules")
    # by start, then the longest, then the highest priority: whatever holds an interval stands before it,
    # so the furthest end at each priority tells whether one of its own or a higher priority does
    keep = """
      aggregate(found,
        struct(array(-1, -1, -1, -1) as ends, cast(array() as array<string>) as labels, 0D as score),
        (s, x) -> struct(
          transform(s.ends, (e, i) -> if(i = -x.y, greatest(e, -x.z), e)) as ends,
          if(array_max(slice(s.ends, 1 - x.y, 4 + x.y)) >= -x.z, s.labels, array_union(s.labels, array(x.label))) as labels,
          if(array_max(slice(s.ends, 1 - x.y, 4 + x.y)) >= -x.z, s.score, greatest(s.score, x.confidence)) as score))"""
    return text.withColumn("kept", F.expr(keep))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, a row for each document."""
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    none = F.array().cast("array<string>")
    base = F.coalesce("base", none)
    return _found(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(base).alias("base_labels"),
        joined(F.array_union(base, F.coalesce("kept.labels", none))).alias("labels"),
        F.greatest(F.coalesce("kept.score", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
