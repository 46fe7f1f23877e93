"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is 64 sign bits of a document's shingle hashes. For radius r
there are 2**(r+1) - 1 tables. Each bit position owns a nonzero vector of
r + 1 bits; the table of a nonzero vector t keeps the positions whose vector
has an odd inner product with t. Up to r differing positions span at most r
of the r + 1 dimensions, so some t is orthogonal to all of them: that table
drops every differing position and the pair collides in it. No pair within
the radius is lost, whatever the data.

A bucket of two is compared directly. A node in a larger bucket emits the
ball of half the radius around its fingerprint (radius 2: itself and its 64
neighbours): two nodes are within 2 bits exactly if their balls of radius 1
meet, and no ball key can be shared by more than 65 fingerprints, so the
links of a crowded bucket come out in linear size, without listing its pairs.

``keep_one`` is the corpus stage: documents whose sets of five-word shingles have
a Jaccard similarity of 0.8 or more. A fingerprint of five-word shingles
differs in ten bits of 64 at that similarity, beyond any covering; those of
distinct words and of distinct word pairs differ in four or five. So the
fingerprints ``PRINTS`` of those, each covered to radius 4 (31 tables), give the
candidates, and their exact similarity decides. A similar pair within the radius
in one of them always ends in one component; a similar pair that is beyond it in
all of them may not be found (README has the measured share). Buckets of up to ``SMALL``
texts give all their pairs. A text in larger ones is first compared with the centres of most of its
buckets, which joins most of a large group of near copies in linear size. Where that leaves
more than one component in a bucket, all its texts go through an exact join of their
shingle sets by prefixes: shingles are ordered from rare to common, and two sets of
the similarity share one among the first fifth of each, and parities of 256 classes of shingles differ in no
more places than the sets may. Pairs of one component need
no comparison, so a group of near copies is not listed pair by pair, and no pair of a
bucket, however large, is left out.

Defined cases: a null or blank text has fingerprint zero, which links like any
other; rows with a null doc_id keep their fingerprint and take the component of
their class (null if the whole class has no id); repeated rows and repeated ids
are separate rows; other columns of the input are ignored, and pass through ``keep_one`` whatever
their names. There, texts are told apart by their 64-bit XXH64 and shingles by 32 bits of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from ..plans.shared import written
from .names import fresh

#: Shingles whose bits are added up at a time, so that a very long text needs little memory.
BLOCK = 1 << 16


def shingle_slices(text: bytes, words: int) -> list[bytes]:
    """The word shingles of a lower-cased text, repeats included."""
    found = text.lower().split()  # bytes.split cuts at 20 and 09-0D, bytes.lower changes A-Z only
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1))
    return [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, words: int, distinct: bool = False, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; a bit is set if it is set in over half of the hashes."""
    grams = shingle_slices(text, words)
    if distinct:
        grams = list(set(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), BLOCK):
        part = grams[at : at + BLOCK]
        hashes = np.fromiter(map(xxh64_intdigest, part, repeat(seed)), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; one pass over the texts, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", words) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Signed 64-bit masks, one for each table; positions deal out the nonzero vectors in turn."""
    span = 1 << (radius + 1)
    vectors = [1 + i % (span - 1) for i in range(64)]
    masks = [sum(1 << i for i, v in enumerate(vectors) if (v & t).bit_count() % 2) for t in range(1, span)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bucketed(nodes: DataFrame, radius: int) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))])
    return nodes.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _ball() -> Column:
    """The fingerprint and its 64 neighbours at one bit."""
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])


def links(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints -> links (u, v) whose components are those of all pairs within 2 bits."""
    rows = _bucketed(nodes, 2)
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sizes = written(sizes)
    twos = sizes.where("n = 2").where(_apart("u", "v") <= 2).select("u", "v")
    crowded = rows.join(sizes.where("n > 2").select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    met = crowded.select("fp", F.explode(_ball()).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    stars = met.select(F.array_min("near").alias("u"), F.explode("near").alias("v")).where("u <> v")
    return twos.union(stars).distinct()


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_size): whole texts, links at 2 bits or fewer."""
    fps = written(fingerprints(docs, words))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    nodes = written(nodes)
    roots = connected_components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_size"))
    classes = rooted.select("fp", "root").join(whole, "root").drop("root")
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )


SMALL, STARS, RADIUS, SIMILARITY, SHINGLE = 4, 2, 4, 0.8, 5
#: Rows of a table of keys (32 bytes each at most) that are broadcast; beyond it they are joined by a shuffle.
MANY_KEYS = 300_000
#: (words, seed) of the fingerprints of distinct shingles that find candidates.
PRINTS = ((1, 42), (2, 42), (1, 43))


def _prints(texts: DataFrame) -> DataFrame:
    """(cls, text) -> (cls, fp0, fp1, ...)."""
    names = [f"fp{i}" for i in range(len(PRINTS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(1).cast(pa.binary()).to_pylist()
            fps = [np.fromiter((fingerprint(t or b"", w, True, s) for t in found), np.uint64, len(found)).view(np.int64) for w, s in PRINTS]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, fps)], names=["cls", *names])

    return texts.select("cls", "text").mapInArrow(run, "cls long, " + ", ".join(f"{n} long" for n in names))


def _small(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast while it is small by count, so that the other side stays where it is; else both are shuffled, with the same outcome."""
    return F.broadcast(keys) if keys.limit(MANY_KEYS + 1).count() <= MANY_KEYS else keys


def _candidates(nodes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(cls, fp0, ...) of distinct texts -> pairs of classes (u < v) from shared buckets, within the radius in some fingerprint, and (key, cls) of buckets over ``SMALL``."""
    names = nodes.columns[1:]
    masks = covering_masks(radius)
    keys = F.array(*[F.xxhash64(F.lit(i * len(masks) + t), F.col(n).bitwiseAND(F.lit(m))) for i, n in enumerate(names) for t, m in enumerate(masks)])
    rows = nodes.select("cls", F.explode(keys).alias("key"))
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("u"), F.max("cls").alias("v")).where("n > 1"))
    crowded = sizes.where("n > 2")
    more = written(rows.join(_small(crowded), "key"))
    few = more.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("cls")).alias("x"))
    few = few.select(F.explode(F.expr("flatten(transform(x, (p, i) -> transform(slice(x, i + 2, size(x)), q -> struct(p as u, q as v))))")).alias("p")).select("p.u", "p.v")
    stars = _stars(more.where(F.col("n") > SMALL).select("key", "cls"))
    pairs = sizes.where("n = 2").select("u", "v").union(few).union(stars).where("u < v").distinct()
    left = nodes.select(F.col("cls").alias("u"), *[F.col(n).alias(f"u_{n}") for n in names])
    right = nodes.select(F.col("cls").alias("v"), *[F.col(n).alias(f"v_{n}") for n in names])
    apart = F.least(*[F.bit_count(F.col(f"u_{n}").bitwiseXOR(F.col(f"v_{n}"))) for n in names])
    return pairs.join(left, "u").join(right, "v").where(apart <= radius).select("u", "v"), more.where(F.col("n") > SMALL).select("key", "cls")


def _stars(members: DataFrame, similarity: float | None = None) -> DataFrame:
    """(key, cls) -> pairs (u, v): each text with the centres of most of its keys, ``STARS`` of them at most.

    A key's centre is its member that has the most company in all of its keys. What a group
    of copies was made from is nearer to them than they are to each other, so it
    has the most company and joins them, in as many pairs as there are texts. With a similarity,
    members have n, pos and root, and only pairs of different roots that can have it count.
    """
    more = ["n", "pos", "root"] if similarity else []
    crowd = members.groupBy("key").agg(F.count("*").alias("crowd"))
    company = _small(written(members.join(_small(written(crowd)), "key").groupBy("cls").agg(F.sum("crowd").alias("company"))))
    centre = F.max_by(F.struct("cls", *more), F.struct("company", -F.col("cls")))
    centres = _small(written(members.join(company, "cls").groupBy("key").agg(centre.alias("c")).select("key", F.col("c.cls").alias("u"), *[F.col(f"c.{m}").alias(f"u_{m}") for m in more])))
    met = members.join(centres, "key").where(F.col("u") != F.col("cls"))
    if similarity:
        met = met.withColumnsRenamed({"u_n": "m", "u_pos": "qos"}).where(F.col("root") != F.col("u_root")).where(_may_be(similarity))
    often = met.groupBy(F.col("cls").alias("v"), "u").agg(F.count("*").alias("often"))
    first = Window.partitionBy("v").orderBy(F.desc("often"), "u")
    return often.withColumn("r", F.row_number().over(first)).where(F.col("r") <= STARS).select("u", "v")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, cls, ...) -> the members of keys that hold more than one component, with their root."""
    rooted = members.join(_small(roots.withColumnRenamed("node", "cls")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = written(rooted)
    keys = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return rooted.join(_small(written(keys)), "key", "left_semi")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(cls, grams) -> (key, cls, n, pos): the shared shingles of every set's prefix; sets of the similarity share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, grams in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys = np.frombuffer(grams, "<u4").astype(np.int64)
                n = len(keys)
                keys = keys if n else np.array([-1])  # empty sets are equal
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), cls, np.int64)), pa.array(np.full(len(keys), n, np.int64))], names=["key", "cls", "n"])

    grams = written(sets.select("cls", "grams").mapInArrow(run, "key long, cls long, n long"))
    # a shingle of one text alone stands first and links nothing: only its place counts
    shared = written(grams.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"))
    rare = grams.join(_small(shared), "key").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("x"))
    rows = rare.select("cls", "n", F.greatest(F.col("n") - F.size("x"), F.lit(0)).alias("own"), F.posexplode("x").alias("at", "x"))
    rows = rows.select(F.col("x.key").alias("key"), "cls", "n", (F.col("own") + F.col("at")).alias("pos"))
    return written(rows.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9)))


PARITIES = [f"p{i}" for i in range(4)]


def _parities(sets: DataFrame) -> DataFrame:
    """(cls, grams) -> (cls, p0, ..., p3): whether the shingles with each of 256 remainders are odd in number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = [np.bincount(np.frombuffer(g, "<u4") & 255, minlength=256) & 1 for g in b.column(1).to_pylist()]
            words = np.packbits(np.array(odd, np.uint8).reshape(-1, 256), axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(words[:, i]) for i in range(4))], names=["cls", *PARITIES])

    return sets.select("cls", "grams").mapInArrow(run, "cls long, " + ", ".join(f"{n} long" for n in PARITIES))


def _can_be(similarity: float) -> Column:
    """Whether parities p0 to p3 and q0 to q3 allow the similarity: every odd bit between them is a shingle that only one set of ``n`` or ``m`` has."""
    odd = F.lit(0)
    for n in PARITIES:
        odd = odd + F.bit_count(F.col(n).bitwiseXOR(F.col(n.replace("p", "q"))))
    return odd <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("m")) + 1e-9


def _may_be(similarity: float) -> Column:
    """Whether sets of ``n`` and ``m`` shingles that first meet at places ``pos`` and ``qos`` can have the similarity."""
    most = F.greatest(F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("qos")), F.lit(0))
    return most >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9


def _settled(found: DataFrame, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links found so far, and members of crowded buckets -> (node, root) with every similar pair of a bucket in one component."""
    roots = written(connected_components(found))
    open_ = written(_mixed(members, roots).select("cls").distinct())
    if not open_.limit(1).count():
        return roots
    wanted = written(sets.join(_small(open_), "cls", "left_semi"))
    rows = _prefixes(wanted, similarity)
    # once with the centres of most of its shingles, in linear size, then all pairs of different components
    mixed = written(_mixed(rows, roots))
    stars = _stars(mixed, similarity)
    found = written(found.union(_verified(stars, sets, similarity)))
    roots = written(connected_components(found))
    mixed = written(_mixed(rows, roots).join(_small(written(_parities(wanted))), "cls"))
    others = mixed.select("key", F.col("cls").alias("v"), F.col("n").alias("m"), F.col("pos").alias("qos"), F.col("root").alias("other"), *[F.col(n).alias(n.replace("p", "q")) for n in PARITIES])
    rest = mixed.join(others, (mixed["key"] == others["key"]) & (F.col("cls") < F.col("v")) & (F.col("root") != F.col("other")) & _may_be(similarity) & _can_be(similarity))
    more = written(_verified(rest.select(F.col("cls").alias("u"), "v").distinct(), sets, similarity))
    return connected_components(found.union(more)) if more.limit(1).count() else roots


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(cls, text) -> (cls, grams): the distinct shingles' 32-bit hashes, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                grams = set(shingle_slices(text or b"", words))
                hashes = np.fromiter(map(xxh64_intdigest, grams), np.uint64, len(grams))
                sets.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["cls", "grams"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, grams binary")


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """(u, v, left, right) pairs whose sets have at least the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    kept.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("u", "v", "left", "right").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left, right = sets.select(F.col("cls").alias("u"), F.col("grams").alias("left")), sets.select(F.col("cls").alias("v"), F.col("grams").alias("right"))
    return _similar(pairs.join(left, "u").join(right, "v"), similarity)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(cls, root) of every distinct text with a near duplicate; cls is the text's XXH64, root the smallest of its component."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("cls", F.xxhash64("text"))
    fps = _prints(texts)
    nodes = written(fps.groupBy("cls").agg(*[F.min(n).alias(n) for n in fps.columns[1:]]))
    pairs, members = _candidates(nodes, radius)
    pairs = written(pairs)
    needed = pairs.select(F.col("u").alias("cls")).union(pairs.select(F.col("v").alias("cls"))).union(members.select("cls")).distinct()
    chosen = texts.join(_small(written(needed)), "cls", "left_semi").dropDuplicates(["cls"])
    sets = written(_shingle_sets(chosen, SHINGLE))
    return _settled(written(_verified(pairs, sets, similarity)), members, sets, similarity).select(F.col("node").alias("cls"), "root")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; the columns stay."""
    p = fresh(docs, "sim")
    own = docs.withColumn(f"{p}cls", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn(f"{p}id", F.col("doc_id").cast("long"))
    roots = near_duplicates(docs, similarity, radius)
    rows = own.groupBy(F.col(f"{p}id").alias("id"), F.col(f"{p}cls").alias("cls")).agg(F.count("*").alias("n"))
    rows = written(rows.join(_small(written(roots)), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    order = F.struct(F.col("id").isNull(), "id", "cls")
    groups = written(rows.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("members")).where("members > 1").select("root", "best"))
    lost = _small(written(rows.join(_small(groups), "root").where(~order.eqNullSafe(F.col("best"))).select(F.col("id").alias(f"{p}lost_id"), F.col("cls").alias(f"{p}lost_cls"))))
    out = own.join(lost, own[f"{p}id"].eqNullSafe(lost[f"{p}lost_id"]) & (own[f"{p}cls"] == lost[f"{p}lost_cls"]), "left_anti")
    if rows.where("n > 1").limit(1).count():  # rows with the same id and the same text
        out = out.dropDuplicates([f"{p}id", f"{p}cls"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
