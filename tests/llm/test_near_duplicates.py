import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sparkward.llm import simhash
from sparkward.operators.components import connected_components


def slow_fingerprint(text, words):
    found = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", ["", "  \n", "one", "one two", "A b\tC d\x0be f é", "x " * 50, "İ K É ß a b c"])
def test_fingerprints_by_hand(text):
    assert simhash.fingerprint(text.encode(), 3) == slow_fingerprint(text, 3)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_difference(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    sets = itertools.combinations(range(64), radius) if radius < 3 else (rng.sample(range(64), radius) for _ in range(3000))
    assert all(any(not (m % (1 << 64)) & sum(1 << i for i in s) for m in masks) for s in sets)


def brute(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if near(a, b) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_links_within_two_bits_even_in_crowded_buckets(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(200):  # a crowd around one fingerprint, at 0 to 6 bits
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    for f in list(fps)[:20]:
        fps.add(f ^ 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute(signed, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    got = {r.node: r.root for r in connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_documents(docs, rows_of):
    got = rows_of(simhash.simhash_components(docs("A b c d e", "a B c  d\te", None, "", "zz yy xx", ids=[5, 3, 9, 8, None])))
    assert got[5].component_id == 3 and got[5].fingerprint == got[3].fingerprint == f"{slow_fingerprint('a b c d e', 3):016x}"
    assert got[9].fingerprint == "0" * 16 and got[9].component_id == 8 and got[None].component_id is None


def test_nothing_in_nothing_out(docs):
    assert simhash.simhash_components(docs()).count() == 0 and simhash.keep_one(docs()).count() == 0


def test_chains_and_stars_settle(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(None, 4), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[i] == 1000 for i in range(1001, 1200))


def test_one_of_each_group_stays(docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(60):  # near copies: 2 words changed
        copy = list(base)
        for i in rng.sample(range(400), 2):
            copy[i] = word()
        texts.append(" ".join(copy))
    others = [" ".join(word() for _ in range(200)) for _ in range(30)]
    frame = docs(*texts, *others, texts[0], None, None)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [0, *range(61, 91), 92]


def test_same_row_twice(docs):
    assert simhash.keep_one(docs("a b c", "a b c", "q w e", ids=[1, 1, None])).count() == 2


def test_fingerprint_of_a_very_long_text():
    text = ("lorem ipsum dolor sit amet " * 40_000).encode()
    few = ("lorem ipsum dolor sit amet " * 40).encode()
    assert simhash.fingerprint(text, 3) == simhash.fingerprint(few, 3) == slow_fingerprint(few.decode(), 3)  # the five shingles come about as often


def test_prints_find_what_verification_decides(spark, docs):
    a = " ".join(f"w{i}" for i in range(100))
    pair = docs(a, a + " tail", " ".join(f"v{i}" for i in range(100)))
    assert simhash.near_duplicates(pair).select("root").distinct().count() == 1
    assert simhash.keep_one(pair).select(F.collect_list("doc_id")).first()[0] == [0, 2]


def test_every_similar_pair_of_a_crowded_bucket_is_found(docs, monkeypatch):
    # fingerprints that are all zero: one bucket a table holds every text
    monkeypatch.setattr(simhash, "PRINTS", ((1, 42), (2, 42)))
    monkeypatch.setattr(simhash, "fingerprint", lambda *a: 0)
    rng = random.Random(7)
    texts = []
    for _ in range(40):  # 40 pairs of near copies out of 12 words, each pair with nothing in common with the others but words
        words = rng.choices("abcdefghijkl", k=120)
        copy = list(words)
        copy[60] = "m"
        texts += [" ".join(words), " ".join(copy)]
    texts += ["", " ", "\n", "q", "q r"]
    got = simhash.near_duplicates(docs(*texts)).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 40 + [2]  # roots themselves are not listed


def test_prefix_join_is_exact(spark):
    rng = random.Random(11)
    sets = {0: set(), 1: set()}
    for g in range(12):  # groups about one set, with 0 to 25 of 60 members changed, and members of all groups in common
        core = rng.sample(range(3000), 50) + rng.sample(range(10), 10)
        for _ in range(15):
            own = list(core)
            for i in rng.sample(range(60), rng.randint(0, 12)):
                own[i] = rng.randrange(3000, 10**6)
            sets[len(sets)] = set(own)
    rows = [(c, bytearray(np.array(sorted(x), "<u4").tobytes())) for c, x in sets.items()]
    frame = spark.createDataFrame(rows, "cls long, grams binary")
    members = spark.createDataFrame([(1, c) for c in sets], "key long, cls long")
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    got = {r.node: r.root for r in simhash._settled(spark.createDataFrame([], "u long, v long"), members, frame, 0.8).collect()}
    assert {c: got.get(c, c) for c in sets} == brute(list(sets), alike)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(60_000))
    rows = [(1, long, "a", 1), (2, long + " tail", "b", 2), (3, "x" * 300_000, "c", 3), (4, long, "d", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __sim_cls string, `__SIM_id` int")
    assert sorted((r.doc_id, r["__sim_cls"], r["__SIM_id"]) for r in simhash.keep_one(frame).collect()) == [(1, "a", 1), (3, "c", 3)]
    parts = {r.doc_id: r.component_id for r in simhash.simhash_components(frame).collect()}
    assert parts[1] == parts[4] == 1 and parts[3] == 3


def test_near_copies_of_a_crowd_of_templates(docs):
    """400 texts of 300 words that differ from one template in 20 places, each with a near copy: crowded buckets, two texts to a class."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    template, texts = [word() for _ in range(300)], []
    for _ in range(400):
        own = list(template)
        for i in rng.sample(range(300), 20):
            own[i] = word()
        near = list(own)
        for i in rng.sample(range(300), 3):
            near[i] = word()
        texts += [" ".join(own), " ".join(near)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts]
    planted = [i for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    kept = {r.doc_id for r in simhash.keep_one(docs(*texts)).collect()}
    lost = [i for i in planted if i in kept and i + 1 in kept]
    assert len(planted) > 350 and len(lost) <= 0.05 * len(planted)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = brute(range(800), alike)
    assert all(any(root[i] == root[j] for j in kept) for i in set(range(800)) - kept)  # nothing goes without a near copy that stays
