import collections
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest

from sparkward.llm import bins, licenses, lines, packing, quality, registry, unigram

BPE, PIECES = registry.vocabulary("word_bpe_49k.json"), registry.vocabulary("piece_bpe_32k.model")
needs_files = pytest.mark.skipif(not os.path.exists(BPE), reason="no tokenizer files")
ODD = [None, "", " \n\t", "a", "word " * 30_000, "x" * 70_000, "é ß 日本 😀", "it's O'Neil, won't!", "<|endoftext|> <|startoftext|>", "a　b\x1cc\x85d", "É́ é", "\r\nline\r\n", "K İ ſ DON'T. A.B.C., 3.14;"]


@needs_files
def test_pieces_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(BPE).encode
    frame = docs(*ODD, ids=list(range(len(ODD))))
    got = packing.pack(frame, BPE, capacity=2048).collect()
    for i, text in enumerate(ODD):
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(k, k * 2048, min(2048, len(ids) - k * 2048)) for k in range(-(-len(ids) // 2048))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        ends = 0
        for at, n in sorted(spans):
            assert at == ends
            ends += n
        assert ends <= 2048


@needs_files
def test_words_of_every_plain_letter_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KNOWN", 50)  # chunks come back from the older generation, or are found again
    encode, ids = Tokenizer.from_file(BPE).encode, packing.ChunkIds(BPE)
    for c in map(chr, range(0x21, 0x260)):
        text = f"{c} ab{c}cd {c.upper()}e, {c * 3}. the word the WORD"
        assert ids.text(text) == np.asarray(encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@needs_files
def test_packing_an_empty_table_and_equal_rows(docs):
    assert packing.pack(docs(), BPE).count() == 0
    got = packing.pack(docs(*["same text"] * 700), BPE, capacity=64).collect()
    n = got[0].length
    assert len(got) == 700 and len({(r.sequence_id, r.offset) for r in got}) == 700 and len({r.sequence_id for r in got}) == -(-700 // (64 // n))


def best(sizes, room):
    """Fewest bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    found = [len(sizes)]

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= sizes[i]:
                bins[j] -= sizes[i]
                go(i + 1, bins)
                bins[j] += sizes[i]
        go(i + 1, [*bins, room - sizes[i]])

    go(0, [])
    return found[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_instances(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(9)]
    plan = bins.solve(collections.Counter(sizes), 20)
    assert sum(n for n, _ in plan) == best(sizes, 20) >= bins.lower_bound(collections.Counter(sizes), 20)
    filled = collections.Counter()
    for n, fill in plan:
        assert sum(s * k for s, k in fill) <= 20
        for s, k in fill:
            filled[s] += n * k
    assert filled == collections.Counter(sizes)


@pytest.mark.parametrize("seed", range(8))
def test_bin_completion_finds_the_sequences_that_lengths_were_cut_from(seed):
    rng = random.Random(seed)
    histogram = collections.Counter()
    for _ in range(60):  # 60 full sequences of 1 to 8 pieces
        cuts = sorted(rng.sample(range(1, 2048), rng.randint(0, 7)))
        histogram.update(b - a for a, b in zip([0, *cuts], [*cuts, 2048], strict=True))
    plan, greedy = bins.solve(histogram, 2048), bins.best_fit(histogram, 2048)
    assert sum(n for n, _ in plan) == 60 == bins.lower_bound(histogram, 2048) and sum(n for n, _ in greedy) >= 60
    for packed in (plan, greedy):
        filled = collections.Counter()
        for n, fill in packed:
            assert n > 0 and sum(s * k for s, k in fill) <= 2048
            filled.update({s: n * k for s, k in fill})
        assert filled == histogram
    assert plan == bins.solve(histogram, 2048)  # nothing depends on time


def test_fillings_are_undominated_and_within_the_waste():
    counts = [0] * 21
    for s, n in {9: 1, 5: 2, 4: 3, 2: 1}.items():
        counts[s] = n
    got = list(bins.fillings(counts, [9, 5, 4, 2], 11, 3, 1000))
    # by hand: 9+2 and 5+5; 9 could stand for 5+4 in 5+4+2, and whatever leaves more has room for a piece or a longer one
    assert got == [(0, ((9, 1), (2, 1))), (1, ((5, 2),))]
    counts[9] = counts[2] = 0
    assert list(bins.fillings(counts, [5, 4], 11, 3, 1000)) == [(1, ((5, 2),))]  # 5+4 leaves 2, and 5 could stand for 4


def test_quality_features_by_hand(docs, rows_of):
    texts = [*ODD, "a b c d e f g h " * 5, "line one\nline one\n \nline two\nline one", "#$% x | y <z> " * 10, "THE END!! " * 40, *(f"Plain words number {i} stand here. They differ in each one, {i * 7} times over.\n" * 1 + " ".join(f"w{i}x{j}" for j in range(60)) + "." for i in range(40))]
    got = rows_of(quality.judge(docs(*texts)))
    for i, text in enumerate(texts):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(len(texts) - 40, len(texts))) and not got[len(ODD) + 2].kept


def test_quality_verdicts_follow_the_posterior(docs, rows_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    good = [" ".join(word() for _ in range(40)).capitalize() + "." for _ in range(40)]
    bad = ["#$% " * 12 + " ".join(word() for _ in range(30)) + "!!!!" for _ in range(6)] + [" ".join(word().upper() for _ in range(30)) for _ in range(4)]
    got = list(rows_of(quality.judge(docs(*good, *bad, None, "few words"))).values())
    names = list(quality.RULES)

    def vote(row, rule):  # the rules' conditions are Python as they stand
        rejects, keeps = (re.sub(r"(?<![<>=])=(?!=)", "==", x).replace("false", "False") for x in quality.RULES[rule])
        values = row.asDict()
        return -1 if eval(rejects, {}, values) else 1 if eval(keeps, {}, values) else 0

    votes = [tuple(vote(r, n) for n in names) for r in got]
    m = slow_fit(list(collections.Counter(votes).items()))

    def like(v, r, keep):
        return np.prod([a if x < 0 else b if x > 0 else max(quality.ABSTAINS, 1 - a - b) for x, a, b in zip(v, r, keep, strict=True)])

    for r, v in zip(got, votes, strict=True):
        g, b = m["p"] * like(v, m["gr"], m["gk"]), (1 - m["p"]) * like(v, m["br"], m["bk"])
        assert abs(r.posterior - g / (g + b)) < 1e-6 and r.kept == (not r.base_failed and g >= b)
    # what several rules speak against goes; shouted words alone are one vote in so small a corpus
    assert all(r.kept for r in got[:40]) and not any(r.kept for r in [*got[40:46], *got[50:]])


def test_quality_stage_whatever_the_columns_and_very_long(spark):
    text = " ".join(f"Plain{i} words" for i in range(30)) + "."
    frame = spark.createDataFrame([(1, text, "t", "w", 5), (2, "bad", "t", "w", 6), (3, "word and another one. " * 30_000, "t", "w", 7)], "doc_id long, text string, __quality_t string, `__QUALITY_w` string, votes int")
    assert [tuple(r) for r in quality.keep_good(frame).collect()] == [(1, text, "t", "w", 5)]
    assert quality.keep_good(frame.limit(0)).columns == frame.columns


def slow_fit(patterns):
    """The same expectation-maximisation in plain Python."""
    k = len(quality.RULES)
    m = {"p": quality.GOOD, "gr": [quality.REJECTS_GOOD[0]] * k, "gk": [quality.KEEPS[0]] * k, "br": [quality.REJECTS_BAD[0]] * k, "bk": [quality.KEEPS[0]] * k}

    def like(v, r, keep):
        out = 1.0
        for x, a, b in zip(v, r, keep, strict=True):
            out *= a if x < 0 else b if x > 0 else max(quality.ABSTAINS, 1 - a - b)
        return out

    for _ in range(quality.ROUNDS):
        y = [(v, n, g / (g + b)) for v, n in patterns for g, b in [(m["p"] * like(v, m["gr"], m["gk"]), (1 - m["p"]) * like(v, m["br"], m["bk"]))]]
        good, bad = sum(n * s for _, n, s in y), sum(n * (1 - s) for _, n, s in y)
        rate = lambda j, vote, lim, w, tot: min(lim[2], max(lim[1], (sum(n * w(s) for v, n, s in y if v[j] == vote) + 5 * lim[0]) / (tot + 5)))  # noqa: B023,E731
        m = {
            "p": min(0.99, max(0.5, good / (good + bad))),
            "gr": [rate(j, -1, quality.REJECTS_GOOD, lambda s: s, good) for j in range(k)], "gk": [rate(j, 1, quality.KEEPS, lambda s: s, good) for j in range(k)],
            "br": [rate(j, -1, quality.REJECTS_BAD, lambda s: 1 - s, bad) for j in range(k)], "bk": [rate(j, 1, quality.KEEPS, lambda s: 1 - s, bad) for j in range(k)],
        }
    return m


def test_votes_are_weighed_as_by_hand(spark):
    rng = random.Random(4)
    k = len(quality.RULES)
    patterns = [([rng.choice((-1, 0, 0, 1)) for _ in range(k)], rng.randint(1, 50)) for _ in range(12)] + [([0, 0, 1] + [0] * (k - 5) + [1, 1], 900)]
    got, want = quality.fit(spark.createDataFrame(patterns, "votes array<int>, n long")), slow_fit(patterns)
    assert abs(got["p"] - want["p"]) < 1e-9 and all(np.allclose(got[n], want[n]) for n in ("gr", "gk", "br", "bk"))
    assert quality.fit(spark.createDataFrame([], "votes array<int>, n long"))["p"] == quality.GOOD


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    judged = registry.op3_quality(spark, sf).join(registry.table(spark, sf, "labels"), "doc_id").select("base_failed", "kept", "quality", "n_words").collect()
    rest = [r for r in judged if not r.base_failed]
    assert sum(r.kept == bool(r.quality) for r in rest) >= 0.97 * len(rest)


def test_quality_stage_keeps_columns_and_handles_nothing(docs):
    good = " ".join(f"word{i}" for i in range(50)) + "."
    frame = docs(good, "x", None, ids=[None, 1, 2])
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and [r.doc_id for r in kept.collect()] == [None] and quality.keep_good(docs()).count() == 0


def spread(n_sites, line="boiler plate line here", unique=40):
    return [f"{line}\n" + "\n".join(f"own {i} text line {j}" for j in range(3)) for i in range(n_sites)]


@pytest.mark.parametrize("inline", [50_000, 0])
def test_lines_on_many_sites_go(docs, rows_of, inline):
    texts = spread(8) + spread(7, "seven sites only") + ["boiler plate line here", None, "", "boiler plate line here\nboiler plate line here\nand a much longer line of its own that stays here for good"]
    sources = [f"s{i}" for i in range(8)] + [f"s{i}" for i in range(7)] + ["s0", "s0", None, "s1"]
    got = rows_of(lines.line_report(docs(*texts, sources=sources), inline=inline))
    assert [got[i].n_removed for i in range(8)] == [1] * 8 and [got[i].n_removed for i in range(8, 15)] == [0] * 7
    assert got[15].n_removed == 1 and got[15].clean_chars == 0 and got[16].clean_md5 is None and got[17].n_lines == 1 and got[18].n_removed == 2
    assert got[0].clean_md5 == hashlib.md5("\n".join(texts[0].split("\n")[1:]).encode()).hexdigest()


def test_line_stage_keeps_columns_and_counts(docs):
    frame = docs(*spread(9), sources=[f"s{i}" for i in range(9)], ids=[None] * 9)
    out = lines.without_boilerplate(frame)
    rows = out.collect()
    assert out.columns == frame.columns and all("boiler" not in r.text and r.n_chars == len(r.text) for r in rows) and len(rows) == 9
    assert lines.without_boilerplate(docs()).count() == 0


def test_copies_spread_no_line(docs, rows_of):
    copies = ["one page that is copied\nfrom site to site"] * 30
    others = [f"one page that is copied\nby number {i}" for i in range(6)]
    sources = [f"s{i}" for i in range(30)] + [f"s{i}" for i in range(6)]
    got = rows_of(lines.line_report(docs(*copies, *others, sources=sources)))
    # the copies count as one text on the site s0, where others[0] stands as well: six sites in all
    assert all(r.n_removed == 0 for r in got.values())
    more = [*others, *(f"one page that is copied\nand again {i}" for i in range(2))]
    got = rows_of(lines.line_report(docs(*copies, *more, sources=[*sources, "s6", "s7"])))
    assert all(r.n_removed == 1 for r in got.values())


def test_lines_whatever_the_columns_and_very_long(spark):
    texts = [f"boiler\nown {i}" for i in range(8)] + ["boiler\n" * 20_000 + "w" * 300_000]
    frame = spark.createDataFrame([(i, t, f"s{i}", "keep", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, __lines_n string, `__LINES_clean` int")
    rows = {r.doc_id: r for r in lines.without_boilerplate(frame).collect()}
    assert all(r["__lines_n"] == "keep" and r["__LINES_clean"] == i for i, r in rows.items())
    assert [rows[i].text for i in range(8)] == [f"own {i}" for i in range(8)] and rows[8].text == "w" * 300_000


def test_license_places_by_hand(docs, rows_of):
    rng = random.Random(9)
    bits = ["mit", "MIT", "license", "License", "gnu", "general", "public", "apache", "cc", "BY", "é", "x", "K", "2.0", "-", ",", "\n", "CC-BY-NC", "cc_by", "\x00"]
    texts = [*ODD, *(" ".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(150))]
    got = rows_of(licenses.scan(docs(*texts)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_license_rules_and_suppression(docs, rows_of):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: BSD-3-Clause", "the Mozilla Public License 2.0 and the GNU Lesser General Public License v2.1", "Creative Commons Attribution-ShareAlike 4.0",
        "nothing here", "released into the public domain",
    ]
    got = rows_of(licenses.scan(docs(*texts)))
    assert [got[i].labels for i in range(6)] == ["apache,apache-2.0", "bsd-3-clause", "lgpl-2.1,mpl-2.0", "cc-by-sa-4.0", "", "public-domain"]
    assert len(licenses.rules()) > 200 and got[4].score == 0 and got[0].score > got[5].score


def specimen(pattern, turn):
    """A text that a rule's regular expression matches; ``turn`` chooses among alternatives and optional parts."""
    from re import _parser

    def say(parsed):
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, value = arg[turn % len(arg)]
                out += chr(value[0] if str(kind) == "RANGE" else value)
            elif name == "BRANCH":
                out += say(arg[1][turn % len(arg[1])])
            elif name == "SUBPATTERN":
                out += say(arg[3])
            elif name == "MAX_REPEAT":
                out += say(arg[2]) * (min(int(arg[1]), arg[0] + 2) if turn % 2 else arg[0])
            elif not name.startswith("ASSERT"):
                raise ValueError(name)
        return out

    return say(_parser.parse(pattern))


def test_license_names_without_the_word_license_pass_the_gate(docs, rows_of):
    texts = {
        "Released under the GNU GPL version 3 or later.": "gpl-3", "Distributed under the BSD 3-Clause terms": "bsd-3-clause", "Published under CC0 1.0": "cc0-1.0", "Covered by the LGPL 2.1": "lgpl-2.1",
        "AGPL v3": "agpl-3", "WTFPL": "wtfpl", "CC Zero": "cc0",
    }
    got = rows_of(licenses.scan(docs(*texts)))
    for i, label in enumerate(texts.values()):
        assert label in got[i].labels.split(",") and got[i].score > 0
    assert all(set(licenses.GATE) & set(specimen(r["regex"], turn).split()) for r in licenses.rules() for turn in range(12))
    assert all(set(licenses.GATE) & set(phrase.split()) for phrase in licenses.BASE)


def test_every_license_rule_finds_its_own_specimen(docs, rows_of):
    wanted = {(specimen(r["regex"], turn).strip(), r["label"]) for r in licenses.rules() for turn in (0, 1, 3)} | {("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"), ("licensed under the GFDL 1.3", "gfdl-1.3")}
    wanted = sorted(wanted)
    got = rows_of(licenses.scan(docs(*[t for t, _ in wanted])))
    assert [x for i, x in enumerate(wanted) if x[1] not in got[i].labels.split(",")] == []
    assert all(any(k in specimen(r["regex"], turn) for k in r["keywords"]) for r in licenses.rules() for turn in range(12))


def test_license_bodies(docs, rows_of):
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that": "bsd",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or": "gpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "To the extent possible under law, A. N. Author has waived all copyright and related or neighboring rights": "cc0",
    }
    got = rows_of(licenses.scan(docs(*texts)))
    for i, label in enumerate(texts.values()):
        assert label in got[i].labels.split(","), (i, got[i].labels)


def test_license_intervals_by_definition(docs, rows_of):
    rules, rng = licenses.rules(), random.Random(3)
    texts = []
    for _ in range(120):  # specimens one after another and inside each other
        parts = [specimen(rng.choice(rules)["regex"], rng.randrange(12)).strip() for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            words = parts[0].split()
            words[rng.randrange(len(words)) : 0] = rng.choice(parts).split()
            parts[0] = " ".join(words)
        texts.append(" filler ".join(parts))
    got = rows_of(licenses.scan(docs(*texts)))
    for i, text in enumerate(texts):
        spans = sorted({(m.start(), -m.end(), -r["priority"], r["label"], r["confidence"]) for r in rules for m in re.finditer(r["regex"], f" {text} ")})
        kept = [x for k, x in enumerate(spans) if not any(o[0] <= x[0] and o[1] <= x[1] and o[2] <= x[2] for o in spans[:k])]
        base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {text} "}
        assert set(got[i].labels.split(",")) - {""} == base | {x[3] for x in kept}, text
        assert got[i].score == max([x[4] for x in kept] + [0.5 if base else 0.0])


def patched(data):
    """The model file as a unigram model with finite space scores, so that the library's Viterbi is exact on it."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    out = b""
    for field, value in unigram._fields(data):
        if field == 1:
            body = b""
            for f, x in unigram._fields(value):
                body += b"\x0a" + varint(len(x)) + x if f == 1 else b"\x15" + struct.pack("<f", max(x, -31000.0)) if f == 2 else b"\x18" + varint(x)
            out += b"\x0a" + varint(len(body)) + body
        elif field == 2:
            at = value.index(b"\x18\x02")
            value = value[:at] + b"\x18\x01" + value[at + 2 :]
            out += b"\x12" + varint(len(value)) + value
        else:
            out += varint(field << 3 | 2) + varint(len(value)) + value
    return out


@needs_files
def test_unigram_paths_are_the_librarys():
    import sentencepiece

    with open(PIECES, "rb") as f:
        model = patched(f.read())
    mine, theirs = unigram.Unigram(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", *("".join(rng.choices("abcé  ▁\n\tüß日本😀.,the ing", k=rng.randint(0, 40))) for _ in range(800))]
    for t in texts:
        ids = np.frombuffer(mine.encode(t), "<u4").tolist()
        assert ids == theirs.encode(t) and mine.decode(ids) == theirs.decode(ids)
    assert [n for n, _ in mine.count(texts)] == [len(mine.encode(t)) // 4 for t in texts]


@needs_files
def test_encoding_and_counts_of_documents(docs, rows_of):
    frame = docs(*ODD)
    report, counts = rows_of(unigram.encoding_report(frame, PIECES)), rows_of(unigram.count_tokens(frame, PIECES))
    back = rows_of(unigram.decode(unigram.encode(frame, PIECES), PIECES))
    for i, text in enumerate(ODD):
        assert report[i].round_trip and back[i].text == (text or "") and counts[i].n_tokens == report[i].n_pieces
    assert report[11].n_byte_pieces > 0 and unigram.count_tokens(docs(), PIECES).count() == 0


def test_double_array_holds_its_keys():
    rng = random.Random(8)
    keys = sorted({bytes(rng.choices(range(256), k=rng.randint(1, 5))) for _ in range(3000)})
    base, check, value = unigram.double_array([(k, i) for i, k in enumerate(keys)])

    def look(key):
        s = 0
        for c in key:
            t = base[s] + c
            if t >= len(check) or check[t] != s:
                return -1
            s = t
        return value[s]

    assert all(look(k) == i for i, k in enumerate(keys)) and all(look(k + b"\0q") == -1 for k in keys if k + b"\0q" not in keys)
