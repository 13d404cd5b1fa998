"""Operators 1, 5, 7 and 8 against brute force, and on odd input."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glean.llm import decontam, license, queries, simhash, winnow

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, fp string, size int, hits string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "x", 1, "y"), (2, "", None, None, None), (3, " \t\n", "a", 2, "b"), (None, "one two three four", "a", 2, "b")]
    rows += [(4, "one two three four five", "a", 1, "b")] * 3 + [(5, "one two three four five", None, 1, None), (6, long, "a", 1, "b")]
    return spark.createDataFrame(rows, SCHEMA)


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


# --- 1 ---
def brute_tiles(a, b, least):
    """Greedy string tiling, straight from its definition."""
    fa, fb, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return tiles
        for i, j in found:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = [False] * best
                fb[j : j + best] = [False] * best
                tiles.append((i, j, best))


def test_tiling_matches_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        a = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 25))]
        b = [rnd.randint(0, 6) for _ in range(rnd.randint(0, 40))]
        least = min(rnd.randint(1, 4), len(a))
        got = decontam.tile(np.array(a, np.uint64), np.array(b, np.uint64), least)
        assert got == brute_tiles(a, [x or -1 for x in b], least)


def test_decontamination(spark, odd):
    item = "The quick brown fox jumps over the lazy dog. A second sentence stands right behind it, as ever!"
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "one, two"), (7, item)], "item_id bigint, text string")
    moved = "x y. a second sentence stands RIGHT behind it as ever; z z z the quick brown fox jumps over the lazy dog"
    half = "the quick brown fox jumps over the lazy dog and nothing of the rest"
    docs = spark.createDataFrame([(1, item), (2, moved), (3, half), (4, "clean words only")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_tiles) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 7, 1), (2, 7, 2)}
    assert decontam.contaminated(docs, bench).count() == 4  # the item stands twice in the benchmark
    for words in (1, 20, 10_000):  # blocks of the benchmark do not change the result
        assert {r.doc_id for r in decontam.clean(docs, bench, block_words=words).collect()} == {3, 4}
        assert decontam.contaminated(docs, bench, block_words=words).count() == 4
    kept = decontam.clean(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 3, 6]
    assert decontam.contaminated(odd.limit(0), bench).count() == 0
    assert decontam.clean(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_of_all_documents(spark):
    bench = [(r.item_id, decontam.tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for d, t in texts(spark):
        ws = decontam.tokens(t)
        grams = {tuple(ws[i : i + 4]) for i in range(len(ws))}
        for i, b in bench:
            if any(tuple(b[k : k + 4]) in grams for k in range(len(b) - 3)):
                if sum(x[2] for x in brute_tiles(b, ws, 4)) >= 0.7 * len(b):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, SF).collect()}
    assert got == want and want


# --- 5 ---
def brute_simhash(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))] if ws else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, x in enumerate(order):
        for y in order[:i]:
            if (x ^ y).bit_count() <= 2:
                root[find(x)] = find(y)
    return {f: find(f) for f in fps}


def test_simhash_query(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SF).collect()}
    fps = {d: brute_simhash(t) for d, t in texts(spark)}
    root = brute_components(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(d, least.get(root[f], d))
    assert got == {d: (f"{f:016x}", least[root[f]]) for d, f in fps.items()}


def clusters(rnd, n):
    out = set()
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 5, 60])):
            out.add(x)
            x ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                x ^= 1 << rnd.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("limit", [20_000, 40])
def test_links_join_the_same_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "NODE_LIMIT", limit)
    rnd = random.Random(limit)
    near = rnd.getrandbits(64)
    fps = clusters(rnd, 700) + [near ^ (1 << a | 1 << b) for a in range(0, 40, 3) for b in range(1, 40, 3)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    roots = simhash.components(simhash.fingerprint_links(df))
    got = {r.fp % 2**64: r.root % 2**64 for r in roots.collect()}
    want = brute_components(fps)
    groups = lambda m: {frozenset(f for f in fps if m.get(f, f) == v) for v in set(m.values())}
    assert {g for g in groups(got) if len(g) > 1} == {g for g in groups(want) if len(g) > 1}


def test_gray_forest_finds_all_pairs_and_prunes():
    rnd = np.random.default_rng(1)
    fps = np.unique(rnd.integers(0, 2**16, 3000, dtype=np.uint64))
    node = (fps % np.uint64(3)).astype(np.int64) * (fps < 2**15)  # trees of several sizes
    forest = simhash.GrayForest(node, fps)
    node = node[forest.order]
    q, m = forest.search(np.arange(len(fps)), 2)
    got = set(zip(q.tolist(), m.tolist()))
    f = forest.fps
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    assert got == set(zip(*np.nonzero(near & (node[:, None] == node[None, :]))))
    assert forest.visits < 0.6 * (node[:, None] == node[None, :]).sum()
    assert simhash.GrayForest(node[:0], fps[:0]).search(np.arange(0), 2)[0].size == 0


def test_links_of_the_documents_come_out_of_the_descent(spark):
    """The table's own fingerprints, and a near one of each, fill trees; every near pair is met below a node they share."""
    own = {brute_simhash(t) for _, t in texts(spark)}
    fps = np.array(sorted(own | {f ^ 1 << i % 64 ^ 1 << (7 * i + 3) % 64 for i, f in enumerate(sorted(own))}), np.uint64)
    pairs, visits = set(), 0
    for mask in simhash.LEVEL_1:
        under = fps & np.uint64(mask % 2**64)
        forest = simhash.GrayForest(np.unique(under, return_inverse=True)[1], fps)
        q, m = forest.search(np.arange(len(fps)), 2)
        visits += forest.visits
        pairs |= {(int(forest.fps[i]), int(forest.fps[j])) for i, j in zip(q, m) if forest.fps[i] < forest.fps[j]}
    want = {(int(x), int(y)) for i, x in enumerate(fps) for y in fps[i + 1 :] if int(x ^ y).bit_count() <= 2}
    assert pairs == want and want
    assert visits > 6 * len(fps)  # three searches each, all of them down to a leaf


def test_simhash_odd_input(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    left = simhash.survivors(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(ids, key=str) == [1, 4, 6, None]
    again = spark.createDataFrame([(5, "a b c d e f"), (3, "a b c d e f"), (5, "g h i j k l"), (None, "a b c d e f")], "doc_id int, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.survivors(again).collect()) == [(3, "a b c d e f"), (5, "g h i j k l")]
    assert [r.doc_id for r in simhash.survivors(again.filter("text < 'b'").dropDuplicates(["doc_id"]).filter("doc_id > 0")).collect()] == [3]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.survivors(odd.limit(0)).count() == 0


# --- 7 ---
def brute_winnow(text, k, w):
    keep = [(i, c) for i, c in enumerate(text or "") if ord(c) > 32 and ord(c) not in (0x85, 0xA0)]
    cs = [ord(c) + (32 if "A" <= c <= "Z" else 0) for _, c in keep]
    if not cs:
        return [], []
    k, hs = min(k, len(cs)), []
    for i in range(len(cs) - k + 1):
        h = 0
        for c in cs[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
        hs.append(((h ^ h >> 31) * 0xBF58476D1CE4E5B9) % 2**64 >> 32)
    chosen = []
    for s in range(max(len(hs) - w, 0) + 1):
        at = min(range(s, min(s + w, len(hs))), key=lambda i: (hs[i], -i))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return [hs[i] for i in chosen], [keep[i][0] for i in chosen]


def test_winnowing_matches_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        t = "".join(rnd.choice("abAB é\n") for _ in range(rnd.randint(0, 120)))
        k, w = rnd.randint(1, 6), rnd.randint(1, 12)
        h, p = winnow.winnow(t, k, w)
        assert (h.tolist(), p.tolist()) == brute_winnow(t, k, w)


def test_long_match_shares_a_fingerprint():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    for _ in range(30):
        common = word(winnow.K + winnow.WINDOW - 1)
        a, b = (winnow.winnow(word(rnd.randint(0, 300)) + common + word(rnd.randint(0, 300)))[0] for _ in "ab")
        assert set(a.tolist()) & set(b.tolist())


def check_near(rows, source):
    order = sorted(source, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (brute_winnow(x, winnow.K, winnow.WINDOW)[0] for x in (t, new, after))
        places = brute_winnow(t, winnow.K, winnow.WINDOW)[1]
        j = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if x or y else 1.0
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(f"{h:08x}" for h in a), round(j(a, b), 9), round(j(a, c), 9), places))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.positions) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("cuts", [[], [3], [-5, 0, 9], list(range(0, 300, 7))])
def test_cuts_upto(spark, cuts):
    rows = spark.range(-8, 310).select("id", winnow.cuts_upto(F.col("id"), cuts).alias("n")).collect()
    assert all(r.n == sum(c <= r.id for c in cuts) for r in rows)


def test_winnowing_query(spark):
    short = [(d, t) for d, t in texts(spark) if len(t) < 1500]
    docs = spark.createDataFrame(short, "doc_id bigint, text string").repartition(5)
    check_near(winnow.near_next(docs).collect(), short)
    assert queries.op7_winnowing(spark, SF).count() == len(texts(spark))


def test_winnowing_odd_input(spark, odd):
    small = odd.filter("doc_id is null or doc_id < 6")
    check_near(winnow.near_next(small).collect(), [(r.doc_id, r.text) for r in small.collect()])
    nulls = odd.filter("doc_id is null")
    check_near(winnow.near_next(nulls).collect(), [(r.doc_id, r.text) for r in nulls.collect()])
    assert winnow.near_next(odd).count() == odd.count() and winnow.near_next(odd.limit(0)).count() == 0
    f = {r.doc_id: r for r in winnow.fingerprints(odd).collect()}
    assert f[1].hashes == [] and len(f[6].hashes) == len(f[6].positions) > 1000


def test_half_of_a_short_text_is_seen_again():
    rnd = random.Random(9)
    for n in (70, 90, 120, 150):
        for _ in range(40):
            t, after = ("".join(rnd.choice("abcdefghijklmnop") for _ in range(n)) for _ in "ab")
            assert winnow.likeness(winnow.winnow(t)[0], winnow.winnow(winnow.edited(t, after))[0]) > 0


# --- 8 ---
def brute_license(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, la) for p, la in license.BASE_PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in base]
    return len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({la for _, la in base})), ws


def brute_base(ws):
    return [(i, la) for p, la in license.BASE_PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]


def template_regex(template):
    parts = []
    for p in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        parts.append("(?:" if p == "[[" else ")?" if p == "]]" else f"(?:[^ ]+ ){{0,{p[2:-2]}}}" if p[0] == "{" else re.escape(p) + " ")
    return "(?:^| )" + "".join(parts)


def test_license_query(spark):
    source = dict(texts(spark))
    found = 0
    for r in queries.op8_license_scan(spark, SF).collect():
        *want, ws = brute_license(source[r.doc_id])
        assert [r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] == want
        joined = " ".join(ws) + " "
        found_at = [(la, m.start()) for la, t in license.TEMPLATES for m in re.finditer(f"(?={template_regex(t)})", joined)]
        places = [(la, joined[:i].count(" ") + (joined[i] == " ")) for la, i in found_at]
        grants = [i for la, i in places if la != "proprietary"] + [i for i, _ in brute_base(ws)]
        own = {la for la, i in places if la != "proprietary" or not any(abs(i - g) <= license.REFUTED_BY_WORDS for g in grants)}
        assert r.labels == ",".join(sorted({*own, *filter(None, want[-1].split(","))}))
        assert (r.score == 1.0) == bool(own)
        found += bool(own)
    assert found


def test_template_regions():
    s = license.Scanner([("t", "alpha [[beta [[gamma]]]] {{2}} delta")], {})
    for text, ok in [
        ("Alpha, DELTA", 1), ("alpha beta delta", 1), ("alpha beta gamma x y delta", 1), ("alpha gamma delta", 1),
        ("alpha x y z delta", 0), ("alpha beta", 0), ("alphas delta", 0), ("zz alpha x alpha q r delta", 1),
    ]:
        assert bool(s.scan(text)["labels"]) == bool(ok), text
    lead = license.Scanner([("t", "{{2}} alpha beta")], {})
    assert lead.scan("x y z alpha beta")["spans"] == [{"label": "t", "first": 1, "words": 4}]
    with pytest.raises(ValueError):
        license.compile_template("t", "[[only optional]]")


BSD = """Copyright (c) 2020, Jane Doe. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""
GNU = "you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize(
    "text,labels",
    [
        (BSD + AS_IS, ["bsd", "bsd-2-clause"]),
        (BSD + THIRD + AS_IS, ["bsd", "bsd-3-clause"]),
        (BSD.replace("must retain", "may retain") + THIRD, ["bsd"]),
        ("Copyright 2020 Acme Corp. All rights reserved. " + "no grant here " * 30, ["proprietary"]),
        (MIT, ["mit"]),
        (MIT.replace("without restriction", "with restriction"), []),
        (ISC, ["isc"]),
        (ISC.replace("hereby granted", "hereby denied"), []),
        (GNU % "General Public License", ["gpl", "gpl-3.0-or-later"]),
        (GNU % "Lesser General Public License", ["gpl", "lgpl"]),
        (GNU % "Affero General Public License", ["agpl", "gpl"]),
        (APACHE, ["apache", "apache-2.0"]),
        (MPL, ["mpl-2.0"]),
    ],
)
def test_license_texts_and_near_misses(text, labels):
    assert license.Scanner().scan("x y " + text + " z")["labels"] == labels


def test_license_odd_input(spark, odd):
    r = {x.doc_id: x for x in license.license_scan(odd).collect()}
    assert r[1].n_words == r[2].n_words == 0 and r[1].first_word is None and r[1].labels == [] and r[1].score == 0.0
    assert r[6].n_words == 60_000 and license.license_scan(odd.limit(0)).count() == 0
    d = spark.createDataFrame([(1, "MIT License mit-license. é General Public License")], "doc_id int, text string")
    x = license.license_scan(d).first()
    assert (x.n_base, x.first_word, x.last_word, x.base_labels) == (3, 0, 5, ["gpl", "mit"])
