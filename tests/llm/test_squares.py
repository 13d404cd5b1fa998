"""Operator 12 against brute force: runs, the whole query, odd input."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from glean.llm import queries, squares
from glean.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_runs(w, least, exponent):
    """Every maximal stretch by its definition; the smallest period of each."""
    out = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def test_catchers_match_brute_force_however_words_arrive():
    rnd = random.Random(1)
    for _ in range(600):
        n, letters = rnd.randint(0, 110), rnd.choice([0, 1, 1, 2, 5])
        w = [rnd.randint(0, letters) for _ in range(n)]
        if n > 5 and rnd.random() < 0.6:
            a, p = rnd.randrange(n), rnd.randint(1, n // 3)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        caught, i = squares.Catchers(), 0
        while i < n:
            step = rnd.choice([1, 1, 2, 9, n])
            caught.append(np.array(w[i : i + step], np.int64))
            i += step
        for least, exponent in ((2, 2), (1, 3), (24, 3)):
            got = [tuple(r) for r in caught.runs(least, exponent).tolist()]
            assert got == sorted(brute_runs(w, least, exponent), key=lambda r: (r[0], r[2]))
        assert [tuple(r) for r in squares.find(w).tolist()] == sorted(brute_runs(w, 24, 3), key=lambda r: (r[0], r[2]))


def test_long_and_hard_texts():
    assert squares.find(["a"] * 300_000).tolist() == [[0, 300_000, 1]]
    two = ["a", "b"] * 5000
    assert squares.find([*two, "x", *two]).tolist() == [[0, 10_000, 2], [10_001, 10_000, 2]]
    block = [f"w{i}" for i in range(70_000)]  # one period is longer than a batch
    assert squares.find(block * 3 + block[:5]).tolist() == [[0, 210_005, 70_000]]
    assert squares.find(block * 2).tolist() == []
    assert squares.find(block * 2, 24, 2).tolist() == [[0, 140_000, 70_000]]


def brute_query(doc_id, text):
    w = (text or "").encode().split()
    key = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = key // 10, len(w)
    if key % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w, 24, 3), key=lambda r: (r[0], r[2]))
    drop = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (
        doc_id,
        len(runs),
        *top,
        1000 * top[1] // top[2] if runs else None,
        hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest(),
    )


def test_query_matches_brute_force_on_short_texts(spark):
    short = table(spark, SF, "documents").filter(F.length("text") < 6000)
    got = sorted(map(tuple, squares.run_digests(squares.repeats(squares.damaged(short))).collect()))
    assert got == sorted(brute_query(r.doc_id, r.text) for r in short.collect())
    assert sum(r[1] for r in got) > 5
    whole = queries.op12_squares(spark, SF)
    assert whole.count() == table(spark, SF, "documents").count()
    assert whole.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_input(spark):
    again = "la " * 30
    rows = [(None, again, "x"), (1, None, "x"), (2, "", None), (3, " \t\r\n\x0b\x0c", "y"), (4, "  " * 40, "z"), (5, "one", "z")]
    rows += [(6, again, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").withColumn("n_words", F.lit(1)).withColumn("h", F.lit("x"))
    got = squares.run_digests(squares.repeats(squares.damaged(docs))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_query(*r[:2]) for r in rows), key=str)
    assert squares.repeats(docs.limit(0)).count() == 0
    text = squares.repeats(docs.filter("doc_id = 6")).first().collapsed
    assert text == "la"
