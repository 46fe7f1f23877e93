"""URL filters: host and path rules, and a character language-model ratio for the rest.

A rule names a host and the beginning of a path and fits the host and all its
subdomains; of the rules that fit, the longest decides. URLs that rules decide
are the labelled rows: blocked ones are rejected, allowed ones accepted. For
each class a variable-order Markov model over the bytes of host and path is
estimated. A context is up to ``ORDERS - 1`` bytes; the probability of a byte after it
is (count + PRIOR * probability after the context without its first byte) /
(context's count + PRIOR), and below all orders each of the 256 bytes is as likely. A context that the class
never saw leaves the shorter one's probability as it is, so the order in use varies with what
was seen, and the probabilities of all bytes add up to one after any context.

Counts are of exact n-grams (an n-gram and its length fit in a long), of all
labelled rows, and grow with the corpus. While they need at most ``BROADCAST`` bytes
they are sent to the workers. Beyond that they stay a table: batches of URLs name their
distinct windows of ``ORDERS`` bytes, so that a window costs a row a batch however frequent it is, the
windows' n-grams are joined to the counts, and each batch gets its windows' log ratios back. Both ways
give the same scores.

A URL's score is its log-likelihood under the rejected model less that under
the accepted one, divided by its length in bytes. The threshold is calibrated on a fifth
of the labelled rows, held out of the counts by a hash of the URL: the score
that only ``false_rejects`` of the accepted ones exceed, and at least 0.

Defined cases: a null URL, or one without "://", has an empty host and path, no rule,
and is allowed; without labelled rows of both classes the model allows all;
a null page_id is kept; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written

ORDERS, PRIOR, FALSE_REJECTS = 6, 4.0, 0.01
#: Bytes of counts that are broadcast (24 for an n-gram), and URLs of a batch where they are not.
BROADCAST, BATCH = 32 << 20, 4096
#: (verdict, rule as host and path).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def ruled(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, over columns host and path; null if none fits."""
    chain_rule = chain_verdict = None
    for word, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        chain_rule = F.when(fits, text) if chain_rule is None else chain_rule.when(fits, text)
        chain_verdict = F.when(fits, word) if chain_verdict is None else chain_verdict.when(fits, word)
    none = F.lit(None).cast("string")
    return (none, none) if chain_rule is None else (chain_rule, chain_verdict)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in bytes, and the last ``ORDERS`` bytes at every byte as a number; zero bytes stand before a text."""
    raw = [t.encode() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    pad = b"\0" * (ORDERS - 1)
    data = np.frombuffer(pad + pad.join(raw), np.uint8).astype(np.int64)
    starts = len(pad) * np.arange(1, len(raw) + 1) + np.cumsum(lengths) - lengths
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    out = np.zeros(len(at), np.int64)
    for k in range(ORDERS):
        out |= data[at - k] << (8 * k)
    return lengths, out


def gram(window, order: int):
    """The last ``order`` bytes of windows, marked with their number; a context is the gram of the window without its last byte."""
    return window & ((1 << 8 * order) - 1) | order << 56


def _counts(labelled: DataFrame) -> DataFrame:
    """(text, rejected) rows -> (gram, accepted, rejected): how often each class has every n-gram, and every context as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rejected = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = np.array(b.column(0).to_pylist(), object)
            for c in (False, True):
                _, seen = windows(list(texts[rejected == c]))
                for order in range(1, ORDERS + 1):
                    grams, n = np.unique(gram(seen, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n * (not c)), pa.array(n * c)], names=["gram", "accepted", "rejected"])

    kinds = "gram long, accepted long, rejected long"
    grams = written(labelled.mapInArrow(run, kinds).groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    # a context's count is that of all bytes after it; it is kept as the gram of its bytes, marked by the order 64 above
    order = F.shiftright("gram", 56)
    context = F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << 56) - 1)), 8) + F.shiftleft(order + 63, 56)
    contexts = grams.withColumn("gram", context).groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return written(grams.unionByName(contexts))


def _looked_up(window, order: int) -> tuple:
    """Keys, in the table of counts, of the windows' grams and contexts of an order."""
    return gram(window, order), gram(window >> 8, order - 1) + (64 << 56)


def ratios(seen: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The last byte's log-likelihood in every window, rejected less accepted; ``counts`` (keys, 2) in the keys' order."""

    def found(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return counts[at] * (keys[at] == wanted)[:, None] if len(keys) else np.zeros((len(wanted), 2))

    p = np.full((len(seen), 2), 1 / 256)
    for order in range(1, ORDERS + 1):
        grams, contexts = map(found, _looked_up(seen, order))
        p = (grams + PRIOR * p) / (contexts + PRIOR)
    return np.log(p[:, 1]) - np.log(p[:, 0])


def _means(lengths: np.ndarray, logs: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(owner, weights=logs, minlength=len(lengths)) / np.maximum(lengths, 1)


def _scored(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``rows`` with the score of ``text``."""
    kinds = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", score double"
    names = [*rows.columns, "score"]
    if counts.count() * 24 <= most:
        table = counts.orderBy("gram").toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((table.column("gram").to_numpy(), np.column_stack([table.column(c).to_numpy() for c in ("accepted", "rejected")])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lengths, seen = windows(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_means(lengths, ratios(seen, *shared.value)))], names=names)

        return rows.mapInArrow(run, kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of rows as one row each, in Arrow's own format."""
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part, sink = b.slice(at, BATCH), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], names=["packed"])

    def unpacked(blob: bytes) -> pa.RecordBatch:
        return pa.ipc.open_stream(blob).read_next_batch()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nth, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = np.unique(windows(unpacked(blob).column("text").to_pylist())[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), nth)), pa.array(seen)], names=["nth", "window"])

    packed = written(rows.mapInArrow(cut, "packed binary").withColumn("nth", F.monotonically_increasing_id()))
    named = written(packed.select("nth", "packed").mapInArrow(name, "nth long, window long"))
    distinct = written(named.select("window").distinct())
    keys = {2 * order + i: k for order in range(1, ORDERS + 1) for i, k in enumerate(_looked_up_columns(order))}
    # all windows share the grams of 0 to 2 bytes: those are under 2 * 65,793 rows and are broadcast
    length = F.pmod(F.shiftright("gram", 56), F.lit(64))
    asked = distinct.select("window", F.explode(F.array(*[F.struct(F.lit(place).alias("place"), k.alias("gram")) for place, k in keys.items()])).alias("g")).select("window", "g.place", "g.gram")
    known = asked.where(length <= 2).join(F.broadcast(counts.where(length <= 2)), "gram").unionByName(asked.where(length > 2).join(counts.where(length > 2), "gram"))
    known = known.groupBy("window").agg(F.collect_list(F.struct("place", "accepted", "rejected")).alias("found"))  # at most two an order

    def step(c: str) -> str:
        n = lambda place: f"coalesce(get(filter(found, x -> x.place = {place}), 0).{c}, 0L)"
        p = "(1D / 256)"
        for order in range(1, ORDERS + 1):
            p = f"(({n(2 * order)} + {PRIOR}D * {p}) / ({n(2 * order + 1)} + {PRIOR}D))"
        return p

    logs = known.select("window", F.expr(f"ln({step('rejected')}) - ln({step('accepted')})").alias("log"))  # a window without a known gram has a ratio of 0
    back = named.join(logs, "window").select("nth", "window", "log")

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        known, values = right.column("window").to_numpy(), right.column("log").to_numpy()
        order = np.argsort(known)
        known, values = known[order], values[order]
        for blob in left.column("packed").to_pylist():
            part = unpacked(blob)
            lengths, seen = windows(part.column("text").to_pylist())
            at = np.minimum(np.searchsorted(known, seen), max(0, len(known) - 1))
            log = values[at] * (known[at] == seen) if len(known) else np.zeros(len(seen))
            out.append(pa.RecordBatch.from_arrays([*part.columns, pa.array(_means(lengths, log))], names=names))
        return pa.Table.from_batches(out)

    return packed.groupBy("nth").cogroup(back.groupBy("nth")).applyInArrow(score, kinds)


def _looked_up_columns(order: int) -> tuple[Column, Column]:
    """``_looked_up`` over a column ``window``."""
    part = lambda w, k: w.bitwiseAND(F.lit((1 << 8 * k) - 1)).bitwiseOR(F.lit(k << 56))
    return part(F.col("window"), order), part(F.shiftright("window", 8), order - 1) + F.lit(64 << 56)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, false_rejects: float = FALSE_REJECTS, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every URL."""
    host, path = parsed(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "text": F.concat("host", "path")})
    rows = rows.withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    rows = written(rows)
    labelled = rows.where("verdict is not null and not held_out").select("text", (F.col("verdict") == "block").alias("rejected"))
    if labelled.where("text <> ''").select("rejected").distinct().count() < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scored = written(_scored(rows, _counts(labelled), broadcast))
    least = scored.where("verdict = 'allow' and held_out").agg(F.percentile_approx("score", 1 - false_rejects, 10_000)).first()[0]
    threshold = max(0.0, least if least is not None else 0.0)
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score",
    )
