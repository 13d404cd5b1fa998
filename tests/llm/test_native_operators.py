"""Operators 4, 9 and 10 against brute force, and on odd input."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glean.llm import chat, cube, hilbert, queries
from tests.oracle import canon, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, size int, shard string, target int, src string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, 1, "x", None, "y"), (2, "", "en", "a", None, None, 1, None), (None, "one two", "en", "b", 1, "x", 1, "s")]
    rows += [(3, "one two three é", "en", "a", 1, "x", 1, "s")] * 5 + [(4, "w " * 50_000, "de", None, 1, "x", 1, "s")]
    rows += [(10 + i, "x " * (i % 7), "fr", "a", 1, "x", 1, "s") for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


# --- 4 ---
@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_curve_is_a_hilbert_curve(spark, bits):
    n = 1 << bits
    cells = spark.range(n**3).select(*[(F.floor(F.col("id") / n**i) % n).alias(c) for i, c in enumerate("xyz")])
    rows = cells.withColumn("h", hilbert.curve_index([F.col(c) for c in "xyz"], bits)).collect()
    order = [(r.x, r.y, r.z) for r in sorted(rows, key=lambda r: r.h)]
    assert sorted(r.h for r in rows) == list(range(n**3)) and order[0] == (0, 0, 0)
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))  # neighbours touch
    for level in range(1, bits):  # every aligned run of cells fills one box: the curve is self-similar
        run = 8**level
        for at in range(0, len(order), run):
            assert len({tuple(c >> level for c in p) for p in order[at : at + run]}) == 1


def check_shards(rows, source):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in source)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(slots[s]) for s in range(hilbert.SHARDS)]
    assert set(slots) <= set(range(hilbert.SHARDS)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_place = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in by_place] == sorted(r.hilbert for r in rows)


def test_hilbert_query(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_shards(queries.op4_hilbert(spark, SF).collect(), [(r.doc_id, r.text) for r in docs])
    monkeypatch.setattr(hilbert, "RUN_ROWS", 3)  # cells of several runs
    rows = queries.op4_hilbert(spark, SF).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs])
    assert sorted(rows) == sorted(queries.op4_hilbert(spark, SF).collect())
    # A shard is narrow in the dimensions: it holds a part of the sources only.
    source = {r.doc_id: r.source for r in docs}
    held = defaultdict(set)
    for r in rows:
        held[r.shard].add(source[r.doc_id])
    assert sum(map(len, held.values())) < 0.8 * hilbert.SHARDS * len(set(source.values()))


@pytest.mark.parametrize("sources", [20, 32, 90])
def test_hilbert_cells_of_sources_with_a_common_beginning(spark, sources):
    names = [None] + [f"https://common.example/crawl-2024-{i:02}" for i in range(1, sources)]
    rows = [(i, "t", None, names[i % sources]) for i in range(sources * 12)] + [(9_000 + i, "t", None, names[1]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    meta = hilbert.metadata(docs).persist()
    found = meta.select("source", hilbert.cell_of(meta, {d: F.col(d) for d in hilbert.DIMENSIONS}).alias("cell")).distinct().collect()
    meta.unpersist()
    cells = {r.source: r.cell >> 2 * hilbert.BITS for r in found}
    assert len(found) == sources  # whole values have one cell each
    in_order = [cells[s] for s in names]
    assert in_order == sorted(in_order) and 0 == in_order[0] and in_order[-1] < 1 << hilbert.BITS
    rows_before = [sum(r[3] == s for r in rows) for s in names]
    if sources <= 1 << hilbert.BITS:
        assert len(set(in_order)) == sources
    else:
        assert in_order == [sum(rows_before[:i]) * 32 // len(rows) for i in range(sources)]


def test_hilbert_odd_input(spark, odd, tmp_path):
    check_shards(hilbert.shards(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert hilbert.shards(odd.limit(0)).count() == 0
    hilbert.write_files(odd, str(tmp_path / "files"), 4)
    back = spark.read.parquet(str(tmp_path / "files"))
    assert back.columns == odd.columns and Counter(map(tuple, back.collect())) == Counter(map(tuple, odd.collect()))
    # One id with many texts: each row is written once.
    again = spark.range(40).selectExpr("7L AS doc_id", "repeat('a', CAST(id AS INT)) AS text", "'s' AS source", "'l' AS lang", "id AS _glean_cell")
    hilbert.write_files(again, str(tmp_path / "again"), 4)
    back = spark.read.parquet(str(tmp_path / "again"))
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, again.collect()))


# --- 9 ---
def brute_targets(sizes):
    """Reshare the excess by weight until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cube.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        if not free or not total:
            return target
        for s in free:
            target[s] = left * weight[s] / total
        above = [s for s in free if target[s] > 3 * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            full.add(s)


def check_mix(rows, docs, close):
    import re

    words = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs)
    assert Counter((r.doc_id, r.size) for r in rows) == words
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(dict(sizes))
    source = {r.doc_id: r.source for r in docs}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, t in want.items():
        biggest = max((r.size for r in rows if source[r.doc_id] == s), default=0)
        assert abs(taken[s] - t) <= (close * t if close else biggest)


def test_mix_query(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op9_cube_mix(spark, SF).collect()
    check_mix(rows, docs, 0.05)
    assert sorted(rows) == sorted(queries.op9_cube_mix(spark, SF).collect())
    monkeypatch.setattr(cube, "CHUNK_ROWS", 4)
    check_mix(queries.op9_cube_mix(spark, SF).collect(), docs, 0.05)
    # Several rounds of chunks: what is open after one is more than a chunk.
    monkeypatch.setattr(cube, "HOLD", 0)
    rows = queries.op9_cube_mix(spark, SF).collect()
    check_mix(rows, docs, 0.05)
    assert sorted(rows) == sorted(queries.op9_cube_mix(spark, SF).collect())


def test_targets_stop_at_three_sizes(spark):
    rng = random.Random(1)
    for _ in range(5):
        sizes = {f"s{i}": rng.choice([1, 5, 40, 1000, 30_000]) for i in range(rng.randint(1, 9))} | {None: rng.randint(0, 50)}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        got = {r.source: r.target for r in cube.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_flight_keeps_both_totals():
    rng = random.Random(4)
    for _ in range(30):
        units = [[i, rng.randint(0, 30), 0.37, rng.getrandbits(60)] for i in range(200)]
        flight, done = cube.Flight(), []
        for u in units:
            done += flight.add(u)
        rest = done + flight.open
        assert len(flight.open) <= 2 and all(u[2] in (0.0, 1.0) for u in done)
        assert sorted(u[0] for u in rest) == list(range(200))
        assert sum(u[2] for u in rest) == pytest.approx(74) and sum(u[1] * u[2] for u in rest) == pytest.approx(0.37 * sum(u[1] for u in rest))


def test_flight_keeps_inclusion_probabilities():
    rng = random.Random(9)
    hits = Counter()
    for _ in range(3000):
        flight = cube.Flight()
        units = [[i, 1 + i % 5, 0.3, rng.getrandbits(60)] for i in range(30)]
        for u in units:
            for d in flight.add(u):
                hits[d[0]] += d[2]
        for u in flight.open:
            hits[u[0]] += u[2]
    assert all(abs(hits[i] / 3000 - 0.3) < 0.05 for i in range(30))


def test_mix_odd_input(spark, odd):
    rows = cube.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert {r.taken for r in rows if r.doc_id in (1, 2)} == {0}
    out = cube.mixed(odd)
    assert out.columns == odd.columns
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert cube.mix(odd.limit(0)).count() == 0 and cube.mixed(odd.limit(0)).count() == 0
    empty = odd.filter("doc_id in (1, 2)")
    assert {(r.target, r.taken) for r in cube.mix(empty).collect()} == {(0.0, 0)}
    plain = odd.filter("doc_id >= 10")
    copies = {r.doc_id: r.copies for r in cube.mix(plain).collect()}
    assert Counter(r.doc_id for r in cube.mixed(plain).collect()) == +Counter(copies)


# --- 10 ---
def brute_chat(rows):
    logged = defaultdict(list)
    for r in rows:
        logged[r.conv_id].append(r)
    turns = {c: tuple((r.role, r.text) for r in sorted(v, key=lambda r: (r.turn is not None, r.turn or 0, r.role or ""))) for c, v in logged.items()}
    inner = {t[:i] for t in turns.values() for i in range(1, len(t))}
    out = {}
    for t in set(turns.values()) - inner:
        ids = [c for c, u in turns.items() if u == t]
        text = "".join(f"<|{'unknown' if a is None else a}|>\n{b or ''}<|end|>\n" for a, b in t)
        out[min((c for c in ids if c is not None), default=None)] = (len(t), len(ids), text)
    return out


def joined(rows):
    parts = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.part):
        parts[r.conv_id].append(r)
    assert all([r.part for r in v] == list(range(len(v))) for v in parts.values())
    return {c: (v[0].n_turns, v[0].copies, "".join(r.chat for r in v)) for c, v in parts.items()}


def test_chat_query_matches_sql(spark):
    con = duck(SF)
    rel = con.sql(queries.QUERIES["op10_chat"][1])
    df = queries.op10_chat(spark, SF)
    assert canon(list(rel.columns), rel.fetchall()) == canon(df.columns, [tuple(r) for r in df.collect()])


def test_chat_collapses_snapshots(spark):
    rng = random.Random(6)
    rows, c = [], 0
    for _ in range(40):
        talk = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(1, 9))]
        for n in rng.sample(range(1, len(talk) + 1), rng.randint(1, len(talk))):
            rows += [(c, i, *t, "extra") for i, t in enumerate(talk[:n])]
            c += 1
    long = [(i, "user", f"turn {i % 11}") for i in range(700)]
    for n in (256, 257, 300, 512, 700, 700):
        rows += [(c, *t, "extra") for t in long[:n]]
        c += 1
    rows += [(None, i, "user", f"lost {i}", "extra") for i in range(3)] + [(c, 5, "user", "same", "x")] * 3 + [(c + 1, None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place string").repartition(7)
    got = joined(chat.rendered(df).collect())
    assert got == brute_chat(df.collect()) and len(got) < 60
    assert max(v[0] for v in got.values()) == 700
    assert chat.rendered(df.limit(0)).count() == 0
