"""Nearest neighbours along shifted space-filling curves.

Vectors are projected to a few dimensions, shifted, and ordered along a Hilbert
curve; several projections and shifts give several orders. Each order is
range-partitioned in Spark and cut into blocks of consecutive vectors, whatever
the distribution. A query meets the vectors of a window about its own place in
every order, and the windows' best are merged and ranked. Nothing else is
searched: every row of the result comes from a window.

Inner products are turned into distances first: a vector of length r (the longest
being 1) gets one more component, sqrt(1 - r * r), and a query, at length 1, a zero.
Directions of projection are drawn from the covariance of a sample and cells
have the sample's quantiles as bounds, so that every cell holds about as much.

How wide the windows are is measured, not set: about ``ASKED`` of the queries are
compared with all rows, in one pass, and their true neighbours' places on the
curves give the least number of rows to read (curves times window) at which a
share of ``RECALL`` of them is met. On clustered vectors that is a small part of
the table; where vectors are spread evenly in many dimensions no curve keeps
neighbours together, and the windows grow to most of it (README has figures).

Blocks and queries travel packed, at most ``MOST_ROWS`` a row, so joins and tasks
handle rows of bounded size; vectors keep the type they came with, and are
multiplied in double precision. Of equal vectors only as many rows as any query
can need stay candidates (those with the smallest ids), so a vector that a
third of all rows hold crowds nothing.

Defined cases: vectors that are null, empty, zero or hold a null or a
non-finite component take no part, nor do rows with a null id or vectors of
another length than most; repeated rows are candidates each, and rows with a query's own
id never are; equal rows ask once; a product that overflows is infinite, and one of
both infinities is least; ties go to the smaller id; fewer candidates than k are all given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import written

CURVES, DIMS, LEVELS, SEED = 16, 8, 4, 7
#: Rows, and numbers in them, that the curves are fitted to; queries that widths are measured with; share of their neighbours to meet.
FIT_ROWS, FIT_NUMBERS, ASKED, RECALL = 20_000, 4_000_000, 256, 0.95
#: Rows of a block, queries of a packet, products at a time, rows of a worker's table of what it has found.
LEAST_ROWS, MOST_ROWS, PACKET, PRODUCTS, FOUND = 32, 4096, 1024, 1 << 22, 1 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cells (n, dims) of a grid with 2**bits steps a side -> their places on the Hilbert curve.

    Gray-code walk from the coarsest level down: at each level the axes' order
    and direction inside the cell depend on the orthant that was entered.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            high = (x[i] & level) > 0
            x[0] = np.where(high, x[0] ^ low, x[0])
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[dims - 1] & level) > 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves(NamedTuple):
    """What every worker needs to place a vector."""

    longest: float  # log of the greatest length
    centre: np.ndarray
    planes: np.ndarray  # (curves, length + 1, dims)
    knots: np.ndarray  # (curves, dims, quantiles)
    shifts: np.ndarray  # (curves, dims)


def _values(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _polar(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and logs of lengths, without overflow."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / most
    size = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / size, (np.log(size) + np.log(most))[:, 0]


def _raised(vectors: np.ndarray, longest: float, asked: bool) -> np.ndarray:
    """Points whose distances rise as the inner products fall."""
    unit, logs = _polar(vectors)
    r = np.ones(len(unit)) if asked else np.exp(np.minimum(logs - longest, 0))
    rest = np.zeros(len(unit)) if asked else np.sqrt(np.maximum(1 - r * r, 0))
    return np.column_stack([unit * r[:, None], rest])


def _keys(points: np.ndarray, curves: Curves, c: int) -> np.ndarray:
    flat = (points - curves.centre) @ curves.planes[c]
    steps = 1 << LEVELS
    cells = np.empty(flat.shape, np.int64)
    share = np.linspace(0, 1, curves.knots.shape[2])
    for d in range(flat.shape[1]):
        cells[:, d] = np.minimum((np.interp(flat[:, d], curves.knots[c, d], share) + curves.shifts[c, d]) / 2 * steps, steps - 1)
    return hilbert_keys(cells, LEVELS)


def _fitted(points: np.ndarray, longest: float, seed: int) -> Curves:
    """Curves for a sample of points, the same for every run."""
    rng = np.random.default_rng([seed, points.shape[1]])
    dims, centre = min(DIMS, points.shape[1]), points.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov((points - centre).T) if len(points) > 1 else np.eye(points.shape[1]))
    root = np.sqrt(np.maximum(values, 0) + 1e-9)[:, None] * axes.T
    planes = np.stack([np.linalg.qr((rng.standard_normal((dims, len(root))) @ root).T)[0] for _ in range(CURVES)])
    knots = np.stack([np.quantile((points - centre) @ p, np.linspace(0, 1, 257), axis=0).T for p in planes])
    return Curves(longest, centre, planes, knots, rng.random((CURVES, dims)))


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec) rows that take part; floats stay floats."""
    kind = rows.schema[vector_column].dataType.simpleString()
    vec = F.col(f"`{vector_column}`").cast(kind if kind == "array<float>" else "array<double>")
    rows = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (most.n if most else 0))


def _uncrowded(rows: DataFrame, k: int) -> DataFrame:
    """Without rows that no query can need: of equal vectors, k + 1 ids stay, and k rows of each."""
    crowds = rows.groupBy(F.xxhash64("vec").alias("crowd")).agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("crowd")
    crowds = written(crowds)
    if not crowds.limit(1).count():
        return rows
    marked = rows.withColumn("crowd", F.xxhash64("vec"))
    crowded = marked.join(crowds, "crowd", "left_semi")
    ids = crowded.withColumn("r", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    few = ids.withColumn("r", F.row_number().over(Window.partitionBy("vec", "id").orderBy("nth"))).where(F.col("r") <= k)
    return marked.join(crowds, "crowd", "left_anti").select(*rows.columns).unionByName(few.select(*rows.columns))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One formula for every pair, so that equal vectors have equal scores."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((q * x).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _nearest(qi: np.ndarray, q: np.ndarray, ids: np.ndarray, nths: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of a block for each query: places of queries and candidates, and scores."""
    step, length = max(1, PRODUCTS // max(1, len(ids))), q.shape[1]
    reach = np.abs(x).max(initial=0)
    parts = []
    for at in range(0, len(qi), step):
        part = q[at : at + step]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = part @ x.T
            # what rounding can do to sums of products of this size
            slack = 1e-15 * length * length * (1 + np.abs(part).max(axis=1, keepdims=True) * reach)
        own = qi[at : at + step, None] == ids[None, :]
        if np.isfinite(rough).all() and np.isfinite(slack).all():
            rough[own] = -np.inf
            kth = np.partition(rough, -k, axis=1)[:, -k, None] if len(ids) > k else np.full((len(part), 1), -np.inf)
            who, what = np.nonzero((rough >= kth - slack) & ~own)
        else:
            who, what = np.nonzero(~own)
        score = _scores(part[who], x[what])
        order = np.lexsort((nths[what], ids[what], -score, who))
        who, what, score = who[order], what[order], score[order]
        kept = np.arange(len(who)) - np.searchsorted(who, who) < k
        parts.append((who[kept] + at, what[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3


class _Found:
    """What a task has found so far: (asked, query_id, id, score, nth) columns, cut to each query's best now and then."""

    names = ("asked", "query_id", "id", "score", "nth")

    def __init__(self, k: int):
        self.k, self.parts, self.rows, self.cut = k, [], 0, FOUND // 2

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])

    def best(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        asked, _, ids, score, nth = columns
        order = np.lexsort((nth, ids, -score, asked))
        # a row that lies in the windows of several curves stands next to itself
        order = order[np.concatenate(([True], (np.diff(asked[order]) != 0) | (np.diff(nth[order]) != 0)))]
        asked = asked[order]
        kept = order[np.arange(len(asked)) - np.searchsorted(asked, asked) < self.k]
        return [c[kept] for c in columns]

    def batches(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.parts or not last and self.rows < FOUND:
            return
        columns = self.best()
        if last or len(columns[0]) > self.cut:
            self.parts, self.rows = [], 0
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=self.names)
        else:
            self.parts, self.rows = [tuple(columns)], len(columns[0])


KINDS = "asked long, query_id long, id long, score double, nth long"


def _all_rows(rows: DataFrame, asked: pa.Table, length: int, k: int) -> DataFrame:
    """Each asked query's best among all rows, by one pass: at most k rows a task and query."""
    qn, qi = asked.column("nth").to_numpy(), asked.column("id").to_numpy()
    q = _values(asked.column("vec").combine_chunks(), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(k)
        for b in batches:
            if b.num_rows:
                ids, nths, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _values(b.column(2), length)
                who, what, score = _nearest(qi, q, ids, nths, x, k)
                found.add(qn[who], qi[who], ids[what], score, nths[what])
                yield from found.batches(False)
        yield from found.batches(True)

    return _top(rows.select("id", "nth", "vec").mapInArrow(run, KINDS), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "id", "nth")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _places(keys: np.ndarray, ids: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of the (key, id) pairs, sorted, stand before each of the given ones."""
    low, high = np.searchsorted(keys, at), np.searchsorted(keys, at, side="right")
    return np.array([a + np.searchsorted(ids[a:b], i) for a, b, i in zip(low.tolist(), high.tolist(), own.tolist(), strict=True)], np.float64)


def _widths(curves: Curves, sample: pa.Table, asked: pa.Table, met: pa.Table, length: int, share: float, rows: int) -> tuple[int, int]:
    """How many curves, and how far about a query's place on them, for the least rows to read."""
    table = _raised(_values(sample.column("vec").combine_chunks(), length), curves.longest, False)
    ids = sample.column("id").to_numpy()
    queries = _raised(_values(asked.column("vec").combine_chunks(), length), curves.longest, True)
    found = _raised(_values(met.column("vec").combine_chunks(), length), curves.longest, False)
    whose = np.searchsorted(asked.column("nth").to_numpy(), met.column("asked").to_numpy())
    apart, best = np.full(len(found), np.inf), (np.inf, 1, rows)
    for c in range(len(curves.planes)):
        key = _keys(table, curves, c)
        order = np.lexsort((ids, key))
        key, own = key[order], ids[order]
        # a query stands before all rows of its key
        here = np.searchsorted(key, _keys(queries, curves, c)).astype(np.float64)
        there = _places(key, own, _keys(found, curves, c), met.column("id").to_numpy())
        apart = np.minimum(apart, np.abs(here[whose] - there))
        # a sample's place stands for rows / sample rows places
        width = int(np.ceil((np.quantile(apart, share, method="higher") + 1) * rows / len(key)))
        block = min(max(width, LEAST_ROWS), MOST_ROWS)
        cost = (c + 1) * min(rows, 2 * width + block)
        best = min(best, (cost, c + 1, width))
    return best[1], best[2]


def _packed(rows: DataFrame, asked: DataFrame, curves: Curves, many: int, block: int, length: int) -> DataFrame:
    """Packets (curve, part, block, is_query, ids, nths, vectors): blocks along each curve within a range partition, and queries with the block they stand in."""
    spark = rows.sparkSession
    both = rows.select("id", "nth", "vec", F.lit(False).alias("ask")).unionByName(asked.select("id", "nth", "vec", F.lit(True).alias("ask")))
    kind = rows.schema["vec"].dataType.simpleString()
    number = "<f4" if kind == "array<float>" else "<f8"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ask = _values(b.column(2), length), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            points = np.empty((len(x), length + 1))
            for a in (False, True):
                if (ask == a).any():
                    points[ask == a] = _raised(x[ask == a], curves.longest, a)
            for c in range(many if len(x) else 0):
                key = pa.array(_keys(points, curves, c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), key, *b.columns], names=["curve", "key", *b.schema.names])

    keyed = both.mapInArrow(place, f"curve int, key long, id long, nth long, vec {kind}, ask boolean")
    order = ["curve", "key", F.desc("ask"), "id", "nth"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, held = None, 0, {False: [], True: []}

        def packet(ask: bool) -> pa.RecordBatch:
            ids, nths, vectors = (np.concatenate(c) for c in zip(*held[ask], strict=True))
            held[ask].clear()
            place = (seen - 1) // block if not ask else seen // block
            row = {"curve": now[0], "part": now[1], "block": place, "is_query": ask, "ids": ids.astype("<i8").tobytes(), "nths": nths.astype("<i8").tobytes(), "vectors": vectors.astype(number).tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("curve", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("is_query", pa.bool_()), ("ids", pa.binary()), ("nths", pa.binary()), ("vectors", pa.binary())]))

        def flush() -> Iterator[pa.RecordBatch]:
            for ask in (True, False):
                if held[ask]:
                    yield packet(ask)

        for b in batches:
            curve, ask = b.column("curve").to_numpy(), b.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            ids, nths, vectors = b.column("id").to_numpy(), b.column("nth").to_numpy(), _values(b.column("vec"), length)
            # runs of rows of one curve and kind
            ends = np.flatnonzero((np.diff(curve) != 0) | (np.diff(ask) != 0)) + 1
            for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(curve)], strict=True):
                if i == j:
                    continue
                if now is None or now[0] != curve[i]:
                    yield from flush()
                    now, seen = (int(curve[i]), int(b.column("part")[0].as_py())), 0
                a = bool(ask[i])
                while i < j:
                    room = PACKET - sum(len(h[0]) for h in held[True]) if a else block - seen % block
                    take = min(j - i, room)
                    held[a].append((ids[i : i + take], nths[i : i + take], vectors[i : i + take]))
                    i += take
                    if a:
                        if take == room:
                            yield packet(True)
                    else:
                        seen += take
                        if seen % block == 0:
                            full = packet(False)
                            if held[True]:  # queries of the block that ends here
                                seen -= 1
                                yield packet(True)
                                seen += 1
                            yield full
        yield from flush()

    names = ["curve", "key", "id", "nth", "vec", "ask", "part"]
    return written(spread.select(*names).mapInArrow(pack, "curve int, part int, block long, is_query boolean, ids binary, nths binary, vectors binary"))


def _windows(packed: DataFrame, width: int, block: int, length: int, k: int, number: str) -> DataFrame:
    """Every query packet with the data packets that lie up to ``width`` rows away -> each query's best in them."""
    spark = packed.sparkSession
    counts = packed.groupBy("curve", "part").agg(F.sum(F.when(F.col("is_query"), 0).otherwise(F.octet_length("ids") / 8).cast("long")).alias("n")).collect()
    starts, before = [], {}
    for r in sorted(counts, key=lambda r: (r.curve, r.part)):
        starts.append((r.curve, r.part, before.get(r.curve, 0), r.n))
        before[r.curve] = before.get(r.curve, 0) + r.n
    parts = spark.createDataFrame(starts, "curve int, part int, start long, n long")  # a row for each curve and partition
    data = packed.where("not is_query").select("curve", "part", "block", "ids", "nths", "vectors")
    own = packed.where("is_query").withColumnRenamed("part", "q_part").join(F.broadcast(parts.select("curve", F.col("part").alias("q_part"), F.col("start").alias("q_start"))), ["curve", "q_part"])
    place = F.col("q_start") + F.col("block") * block
    own = own.select(
        "curve", F.col("ids").alias("q_ids"), F.col("nths").alias("q_nths"), F.col("vectors").alias("q_vectors"),
        (place - width).alias("first"), (place + block + width).alias("end"),
    )
    spans = own.join(F.broadcast(parts), "curve").where("start < end and start + n > first")
    queries = spans.select(
        "curve", "part", "q_ids", "q_nths", "q_vectors",
        F.explode(F.sequence(F.floor(F.greatest(F.col("first") - F.col("start"), F.lit(0)) / block), F.floor((F.least("end", F.col("start") + F.col("n")) - 1 - F.col("start")) / block))).alias("block"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(k)
        for b in batches:
            for i in range(b.num_rows):
                qi, qn, q, ids, nths, x = (b.column(c)[i].as_buffer() for c in range(6))
                qi, qn, ids, nths = (np.frombuffer(v, "<i8") for v in (qi, qn, ids, nths))
                q, x = (np.frombuffer(v, number).astype(np.float64).reshape(-1, length) for v in (q, x))
                who, what, score = _nearest(qi, q, ids, nths, x, k)
                found.add(qn[who], qi[who], ids[what], score, nths[what])
                yield from found.batches(False)
        yield from found.batches(True)

    met = queries.join(data, ["curve", "part", "block"]).select("q_ids", "q_nths", "q_vectors", "ids", "nths", "vectors")
    return met.mapInArrow(run, KINDS)


def search(rows: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = 20, recall: float = RECALL, seed: int = SEED, told: Callable[[dict], None] | None = None) -> DataFrame:
    """query_id, rank, id and score: the k largest inner products found for every row for which ``is_query`` (over ``id``) holds.

    ``told`` is given the number of curves, the window's width and the rows that a query reads.
    """
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    # rows are told apart by a number, so that repeated ones are no overlap of windows
    rows = written(usable(rows, id_column, vector_column).withColumn("nth", F.monotonically_increasing_id()))
    head = rows.select(F.size("vec").alias("n")).first()
    if head is None:
        return none
    length = head.n
    asked = rows.where(is_query).groupBy("id", "vec").agg(F.min("nth").alias("nth"))
    table = _uncrowded(rows, k)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([float(_polar(_values(b.column(0), length))[1].max())])], names=["n", "log"])

    n, longest = table.select("vec").mapInArrow(sizes, "n long, log double").agg(F.sum("n"), F.max("log")).first()
    some = lambda df, most, of, salt: df.where(F.pmod(F.xxhash64("nth", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, most / max(1, of)) * (1 << 30)))
    sample = some(table, min(FIT_ROWS, FIT_NUMBERS // length), n, seed).select("id", "vec").toArrow()
    test = some(asked, ASKED, asked.count(), seed + 1).select("id", "nth", "vec").orderBy("nth").toArrow()
    if not test.num_rows:  # of few queries, by chance none: take the first
        test = asked.select("id", "nth", "vec").orderBy("nth").limit(ASKED).toArrow()
    if not sample.num_rows:
        sample = table.select("id", "vec").limit(1).toArrow()
    if not test.num_rows:
        return none
    curves = _fitted(_raised(_values(sample.column("vec").combine_chunks(), length), longest, False), longest, seed)
    best = written(_all_rows(table, test, length, k).select("asked", "nth"))
    met = table.join(F.broadcast(best), "nth").select("asked", "id", "vec").toArrow()  # at most k rows for each measured query
    if not met.num_rows:
        return none
    many, width = _widths(curves, sample, test, met, length, recall, n)
    block = min(max(width, LEAST_ROWS), MOST_ROWS)
    if told:
        told({"curves": many, "width": width, "rows": n, "read": min(n, many * (2 * width + block))})
    number = "<f4" if rows.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"
    found = _windows(_packed(table, asked, curves, many, block, length), width, block, length, k, number)
    if many > 1:  # rows that lie in the windows of several curves
        found = found.groupBy("asked", "query_id", "id", "score", "nth").agg(F.lit(1).alias("one")).drop("one")
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
