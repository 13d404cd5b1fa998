"""Hand-made frames for the semantic quirks and the skew-safe paths."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glean.functions import paths as P
from glean.functions import text as T
from glean.operators import chunk as C
from glean.operators import evalr as E
from glean.operators import keyword as K
from glean.operators import knn as N
from glean.operators import ordered as O
from glean.operators import patch as PT
from glean.operators import risk as R


def one(spark, value, col=T.py_strip, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col(F.col("s")).alias("r")).first()["r"]


def test_py_strip_unicode_space(spark):
    assert one(spark, "　\x1c a b \xa0\n") == "a b"


def test_tokens_match_python_rule(spark):
    import re

    texts = ["a$b $c d$ é1_x", "def foo(bar): return x$$y", "Ünïcode wörds 42"]
    for t in texts:
        assert one(spark, t, T.tokens) == re.findall(r"\b[\w$]+\b", t.lower())


def test_normalise_query(spark):
    assert one(spark, "  DEF  save_study(x)", T.normalise_query) == "def_save_study(x)"


def test_file_type_is_ordered_substring(spark):
    df = spark.createDataFrame([("report.py", False), ("test_a.py", False), ("api_models.py", False), ("x.py", True)], "n string, t boolean")
    got = [r[0] for r in df.select(P.file_type(F.col("n"), F.col("t"))).collect()]
    assert got == ["database_access", "unit_test", "api_endpoint", "unit_test"]


def test_extract_path_strips_characters(spark):
    assert one(spark, "test ./.github/x.py now", lambda c: P.extract(c)) == "github/x.py"
    assert one(spark, "no path here", lambda c: P.extract(c)) == "unknown_file.py"


def test_split_blocks_prefix_leading_text(spark):
    s = "lead --- RESULT 1 | IS_TEST: True ---\nA\n\n--- RESULT 2 | IS_TEST: False ---\nB"
    blocks = one(spark, s, T.split_blocks)
    assert blocks[0] == "--- RESULTlead"
    kept = one(spark, s, T.keep_test_blocks)
    assert kept == "\n\n--- RESULT 1 | IS_TEST: True ---\nA"
    assert one(spark, "nothing", T.keep_test_blocks) == "No reference tests found."


def test_log_tail_keeps_short_text(spark):
    assert one(spark, "a\nb\n", lambda c: T.log_tail(c, 30, 2000)) == "a\nb\n"
    long = "\n".join(str(i) for i in range(40))
    assert one(spark, long, lambda c: T.log_tail(c, 30, 2000)) == "\n".join(str(i) for i in range(10, 40))


def test_exclude_self_is_two_way_and_after_rank(spark):
    hits = spark.createDataFrame(
        [(1, 1, 10, "svc/a.py"), (1, 2, 11, "svc/a.py.bak"), (1, 3, 12, "other/b.py"), (2, 1, 20, ""), (2, 2, 21, "x.py")],
        "query_id int, rank int, doc_id int, relative_path string",
    )
    targets = spark.createDataFrame([(1, "svc/a.py"), (2, "")], "query_id int, target_file string")
    got = {r.query_id: (r.doc_id, r.found) for r in K.exclude_self(hits, targets).collect()}
    assert got[1] == (12, True)
    assert got[2] == (20, True)  # empty target drops nothing


def test_mrr_zero_and_rounded_mean(spark):
    hits = spark.createDataFrame(
        [(1, 1, "x", "a/one.md"), (1, 2, "has KEY", "a/two.md"), (1, 3, "key", "b/three.md"), (2, 1, "none", "c/four.md")],
        "query_id int, rank int, text string, relative_path string",
    )
    truth = spark.createDataFrame([(1, "q1", "key"), (2, "q2", "key"), (3, "q3", "key")], "query_id int, query string, keyword string")
    rep = {r.query_id: r for r in E.evaluate(hits, truth, k=5).collect()}
    assert rep[1].mrr == 0.5 and rep[1].r_at_5 == 1 and rep[1].relative_file == "two.md"
    assert rep[2].mrr == 0.0 and rep[3].relative_file == "Not Found"
    avg = E.averages(E.evaluate(hits, truth, k=5)).first()
    assert avg.avg_mrr == round(0.5 / 3, 6)


def test_running_total_hot_key_equals_window(spark):
    random.seed(1)
    rows = [(0, i, random.randint(0, 9)) for i in range(3000)]  # one hot key
    rows += [(k, i, random.randint(0, 9)) for k in range(1, 200) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = O.running_total(df, "k", [F.col("o")], "v", "run", partitions=16)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("v").over(w))
    assert got.select("k", "o", "run").exceptAll(want.select("k", "o", "run")).count() == 0
    assert got.count() == df.count()
    # The hot key is spread over several range partitions.
    parts = O.ordinal(df, "k", [F.col("o")], "pos", partitions=16)
    assert parts.count() == df.count()


def test_knn_equals_brute_force_with_hot_cell(spark):
    random.seed(7)
    vecs = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vecs += [(1000 + i, [0.001 * random.random() for _ in range(8)]) for i in range(300)]  # dense clump
    df = spark.createDataFrame(vecs, "id long, vec array<double>")
    got = N.knn(df.withColumnRenamed("id", "query_id"), df, k=4, exclude_self=True, cell_target=50)
    got = {(r.query_id, r.rank): r.id for r in got.collect()}
    for qid, qv in vecs[::37]:
        d = sorted((round(math.dist(qv, v), 6), i) for i, v in vecs if i != qid)[:4]
        assert [got[(qid, r + 1)] for r in range(4)] == [i for _, i in d]


def test_term_frequencies_in_row(spark):
    got = one(spark, "b a b c b", lambda c: K.term_frequencies(T.tokens(c)))
    assert [(r.term, r.tf) for r in got] == [("a", 1), ("b", 3), ("c", 1)]


def test_recursive_chunks_respect_size_and_cover_text():
    text = ("word " * 50 + "\n") * 40 + "x" * 2500
    chunks = C.split_recursive_text(text, 300, 50)
    assert all(len(c) <= 300 for c in chunks)
    assert "".join(text.split()).startswith("".join(chunks[0].split()))
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))


def test_patch_exact_and_fallback(spark):
    docs = spark.createDataFrame(
        [("a.py", "x = 1\ny = 'v'\n"), ("b.py", "p = 2\n"), ("c.py", "q = 3\n")], "relative_path string, text string"
    )
    patches = spark.createDataFrame(
        [
            ("a.py", "<<<<<<< SEARCH\ny = 'v'\n=======\ny = 'w'\n>>>>>>> REPLACE"),
            ("b.py", "<<<<<<< SEARCH\n  p = 2  \n    zzz\n=======\np = 5\n>>>>>>> REPLACE"),
            ("c.py", "no markers"),
        ],
        "relative_path string, patch string",
    )
    got = {r.relative_path: r for r in PT.apply(docs, patches).collect()}
    assert got["a.py"].mode == "exact" and got["a.py"].content == "x = 1\ny = 'w'\n"
    assert got["b.py"].mode == "fallback" and got["b.py"].content == "p = 5\n"
    assert got["c.py"].mode == "error" and got["c.py"].content is None


def test_stratified_split_exact_counts(spark):
    rows = [(i, int(i % 5 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, y int")
    c = {(r.y, r.split): r["count"] for r in R.stratified_split(df, "y", F.col("id"), 0.2).groupBy("y", "split").count().collect()}
    assert c[(1, "test")] == 40 and c[(0, "test")] == 160


def test_top_reasons_same_features_every_row(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "a double, b double, c double")
    imp = spark.createDataFrame([(0.1, 0.5, 0.4)], "a double, b double, c double")
    rows = R.top_reasons(df, imp, ["a", "b", "c"], 2).collect()
    assert [[x.feature for x in r.reasons] for r in rows] == [["b", "c"], ["b", "c"]]


def test_tree_scan_keeps_hidden_and_underscore_files(spark, tmp_path):
    from glean.sources import io as IO
    from glean.sources import tree

    files = {
        "a.py": "print('a') # long enough",
        "_p.py": "x = 1  # long enough",
        ".hid.py": "y = 2  # long enough",
        "__init__.py": "z = 3  # long enough",
        "pkg/.github/w.py": "w = 4  # long enough",
        "pkg/.git/skip.py": "s = 5  # long enough",
        "pkg/sub/tests/t.py": "t = 6  # long enough",
        "venv/v.py": "v = 7  # long enough",
        "pkg/readme.md": "# readme long enough",
        "pkg/short.py": "x=1",
        "pkg/notes.txt": "not an allowed suffix",
    }
    for rel, body in files.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "pkg" / "bad.py").write_bytes(b"\xff\xfe invalid utf8 bytes here")
    got = tree.scan(spark, str(tmp_path))
    paths = sorted(r.relative_path for r in got.collect())
    assert paths == sorted(["a.py", "_p.py", ".hid.py", "pkg/.github/w.py", "pkg/readme.md", "pkg/short.py", "pkg/bad.py"])
    docs = IO.to_documents(got)
    kept = sorted(r.relative_path for r in docs.collect())
    assert "pkg/short.py" not in kept and "pkg/bad.py" not in kept and "pkg/.github/w.py" in kept


def test_tree_scan_of_one_deep_folder_is_dealt_evenly(spark, tmp_path):
    from glean.sources import tree

    for i in range(400):
        p = tmp_path / "src" / "main" / "pkg" / f"m{i % 5}" / f"f{i}.py"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"x = {i}\n" * (1 + i % 7))
    (tmp_path / "src" / "loop").symlink_to(tmp_path / "src", target_is_directory=True)
    (tmp_path / "src" / "empty").mkdir()
    got = tree.scan(spark, f"file://{tmp_path}")
    sizes = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 400 and len(sizes) > 1 and max(sizes) < 200
    rows = {r.relative_path: bytes(r.content).decode() for r in got.collect()}
    assert rows["src/main/pkg/m3/f8.py"] == "x = 8\n" * 2


def test_tree_scan_of_a_store_without_mounted_folder(spark, tmp_path):
    """A root that no path of this machine names, opened by the given function."""
    from pyarrow import fs as pafs

    from glean.sources import tree

    base = str(tmp_path)

    def bucket(root):
        return pafs.SubTreeFileSystem(base, pafs.LocalFileSystem()), root.removeprefix("bucket://")

    files = spark.createDataFrame(
        [("a/_u.py", "u = 1"), ("a/b/c.md", "# ä 漢"), ("tests/t.py", "t"), ("a/empty.md", ""), ("a/null.md", None), ("a/z.py.gz", "z")],
        "relative_path string, text string",
    )
    for _ in range(2):  # written again by a task that is run again
        tree.write_tree(files, "bucket://trees/one", bucket)
    got = {r.relative_path: bytes(r.content).decode() for r in tree.scan(spark, "bucket://trees/one", store=bucket).collect()}
    assert got == {"a/_u.py": "u = 1", "a/b/c.md": "# ä 漢", "a/empty.md": "", "a/null.md": ""}
    assert tree.scan(spark, "bucket://trees/one", extensions=(".rs",), store=bucket).count() == 0
    with pytest.raises(Exception, match="missing"):
        tree.scan(spark, "bucket://missing", store=bucket).collect()


def test_code_tokens_and_fallback(spark):
    from glean.functions.code import code_tokens

    texts = [
        ("def save_study(x):\n    return 'A'\n", ["def", "def_save_study", "save_study", "x", "return", "'a'"]),
        # Unterminated string: no tokens, so words first, then the bigrams.
        ("class Foo 'oops\ndef bar", ["class", "foo", "oops", "def", "bar", "class_foo", "def_bar"]),
        ("class A: pass", ["class", "class_a", "a", "pass"]),
        ("def (x", ["def", "x", "def_x"]),
        ("", []),
        (None, []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", code_tokens(F.col("s")).alias("t")).collect()}
    assert [got[i] for i in range(len(texts))] == [want for _, want in texts]


def test_line_fix_strips_all_white_space(spark):
    from glean.functions import text as T

    df = spark.createDataFrame([("a \u00a0\r\nb\x0c\nc \u2028d  ",)], "s string")
    assert df.select(T.fix_lines(F.col("s"))).first()[0] == "a\nb\nc \u2028d"


def test_pruned_bm25_broadcasts_no_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    from glean.operators import keyword as K

    texts = [(i if i else None, f"common w{i % 40} {'rare' if i % 50 == 0 else 'other'} w{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "common rare w3"), (2, "common other"), (None, "rare w5")], "query_id long, query string")
    sent, real = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or real(df))
    pruned = K.search(queries, K.build_index(docs), k=5, prune=True, rare_fraction=0.05).collect()
    assert sent and not [c for c in sent if "doc_id" in c]  # candidates grow with the documents
    full = K.search(queries, K.build_index(docs), k=5, prune=False).collect()
    assert sorted(map(str, pruned)) == sorted(map(str, full)) and len(full) == 15
    few = K.search(queries, K.build_index(docs), k=5, prune=True, rare_fraction=0.05, max_lookup_rows=1).collect()
    assert sorted(map(str, few)) == sorted(map(str, full))


def test_bm25_of_many_query_terms_broadcasts_none_of_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common w{i % 3} x{i}") for i in range(6)], "doc_id long, text string")
    queries = spark.range(70_001).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id") % 5), F.lit("other")).alias("query"))
    sent, real = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or real(df))
    got = K.search(queries, K.build_index(docs), k=1)
    assert not [c for c in sent if "term" in c]  # 210,003 terms: a broadcast is built on the driver
    joins = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [j for j in joins if "BroadcastHashJoin" in j and "term" in j] and [j for j in joins if "SortMergeJoin" in j and "term" in j]
    few = queries.limit(40).unionByName(queries.limit(1).select(F.lit(None).cast("long").alias("query_id"), "query"))
    shuffled = K.search(few, K.build_index(docs), k=2, max_broadcast_rows=10).collect()
    streamed = K.search(few, K.build_index(docs), k=2).collect()
    assert [c for c in sent if "term" in c]
    assert sorted(map(str, shuffled)) == sorted(map(str, streamed)) and len(streamed) == 82


def test_hits_of_many_queries_are_not_broadcast(spark, tmp_path, monkeypatch):
    from glean.plans import retrieval as RT

    spark.range(60_000).select(F.col("id").alias("item_id"), F.lit("some words").alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    sent = []
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or df)
    hits = spark.createDataFrame([(1, 1, 1, 0.5)], "query_id long, rank int, doc_id long, score double")
    assert RT._bounded(spark, str(tmp_path), hits, 10) is hits and not sent  # up to 600,000 hits, built on the driver
    RT._bounded(spark, str(tmp_path), hits, 3)
    assert sent


def test_pruned_bm25_equals_exhaustive_with_hot_term(spark):
    random.seed(3)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for d in range(400):
        words = ["the"] * random.randint(1, 5) + random.choices(vocab, k=random.randint(3, 40))
        random.shuffle(words)
        docs.append((d, " ".join(words)))
    queries = [(q, " ".join(["the"] + random.sample(vocab, 3))) for q in range(30)]
    queries.append((99, "the the"))  # only the hot term: must fall back
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    idx = K.build_index(d)
    full = sorted(map(tuple, K.search(q, idx, k=5, prune=False).collect()))
    pruned = sorted(map(tuple, K.search(q, idx, k=5, prune=True, rare_fraction=0.05).collect()))
    auto = sorted(map(tuple, K.search(q, idx, k=5, exhaustive_rows=10).collect()))
    assert pruned == full and auto == full
    assert {r[0] for r in full} >= {99}



def test_ordinal_matches_row_number_on_wide_rows(spark):
    # Wide rows (many columns unused by the ordering) must not break the
    # shared range exchange of the two branches.
    random.seed(5)
    rows = [(random.choice("ab"), i, random.random(), "x" * (i % 7), float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i int, v double, pad string, w double")
    got = O.ordinal(df, "k", [F.col("v"), F.col("i")], "pos", partitions=12)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")))
    assert got.select("k", "i", "pos").exceptAll(want.select("k", "i", "pos")).count() == 0


def test_documents_metadata_merge_right_wins(spark):
    from glean.sources import io as IO

    files = spark.createDataFrame([("svc/api_routes.py", "def handler():  return 1")], "relative_path string, content string")
    extra = F.create_map(F.lit("test_status"), F.lit("passed"), F.lit("file_type"), F.lit("custom"))
    d = IO.to_documents(files, is_test=False, extra=extra).first()
    assert d.service == "svc" and d.file_type == "api_endpoint"
    assert d.metadata["file_type"] == "custom" and d.metadata["test_status"] == "passed"
    assert d.metadata["is_test"] == "False"


def test_both_modes_and_vector_table(spark, tmp_path):
    from glean.sources import io as IO

    seed = spark.createDataFrame([(1, "a")], "chunk_id long, text string")
    src = spark.createDataFrame([(2, "b"), (3, "c")], "chunk_id long, text string")
    both = IO.both_modes(seed, src)
    assert sorted((r.chunk_id, r.is_test) for r in both.collect()) == [(1, True), (2, False), (3, False)]
    path = str(tmp_path / "vec")
    assert IO.append_vectors(both.limit(0), path) is False
    assert IO.append_vectors(both, path) and IO.append_vectors(both, path)
    assert IO.index_count(spark, path) == 6  # plain append duplicates
    assert IO.append_vectors(both, path, dedup_key="chunk_id") and IO.index_count(spark, path) == 6
    IO.clear_index(spark, path, both.schema)
    assert IO.index_count(spark, path) == 0


def test_trim_keeps_whole_suffix_only(spark):
    from glean.operators import history as H

    rows = [(1, 0, "system", "s " * 5), (1, 1, "human", "a " * 4), (1, 2, "ai", "b " * 3), (1, 3, "human", "c " * 2),
            (2, 0, "human", "x " * 2), (2, 1, "ai", "y " * 9)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, type string, text string")
    kept = sorted((r.conv_id, r.turn) for r in H.trim(df, budget=5).collect())
    assert kept == [(1, 2), (1, 3)]  # conv 2: the newest message alone exceeds the budget


def test_code_tokens_leave_python_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from glean.functions import code

    monkeypatch.setattr(code, "PIECE_CHARS", 100)
    texts = ["def a(x): return x", None, "", "x = (", "y = 'é'"] * 40
    got = list(code._lexemes.func(iter([pa.array(texts), pa.array([], pa.string())])))
    # A batch of texts no longer turns into one array of tokens.
    assert len(got) > 10 and max(len(x) for x in got) < len(texts) / 4
    flat = [x for part in got for x in part.to_pylist()]
    want = [code.lexemes(t) for t in texts]
    assert [x if x is None else [(t["kind"], t["text"]) for t in x] for x in flat] == want


def test_code_metrics_walk_the_tree_once(monkeypatch):
    import ast

    from glean.operators import metrics as M

    code = """
@d
class A(B):
    @e(lambda x: x if x else 0)
    def f(self, a=[i for i in r if i]):
        def g():
            class In: pass
            return a and b and c
        try:
            while a: pass
        except E: pass
        else: pass
        finally: pass
    class C:
        async def h(self):
            async for i in x: pass
            with a: assert b
if a: pass
elif b: pass
else: pass
match a:
    case 1 if b or c: pass
for x in y: pass
else: pass
"""
    want = (36, [3, 3, 8, 10])
    seen, real = [], ast.iter_child_nodes
    monkeypatch.setattr(ast, "iter_child_nodes", lambda node: seen.append(node) or real(node))
    loc, vg, *_ = M._python_metrics(code)
    assert len(seen) == 0  # three walks over every node before
    assert (loc, vg) == (want[0], sum(want[1]) / len(want[1]))


def test_code_metrics_on_python_sources(spark):
    import glob
    import os

    from glean.operators import metrics as M

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    texts = [open(p).read() for p in sorted(glob.glob(os.path.join(root, "glean", "operators", "*.py")))]
    srcs = [(i, t) for i, t in enumerate(t for t in texts if t.strip())]
    srcs.append((len(srcs), "def broken(:\n    pass"))
    df = spark.createDataFrame(srcs, "doc_id long, text string")
    rows = {r.doc_id: r for r in M.code_metrics(df).collect()}
    bad = rows.pop(len(srcs) - 1)
    assert bad.loc is None  # parse failure -> no features
    for r in rows.values():
        assert r.loc > 0 and r.vg >= 1 and r.v > 0
        assert math.isclose(r.e, r.d * r.v, rel_tol=1e-9)
        assert math.isclose(r.complexity_density, r.vg / max(r.loc, 1), rel_tol=1e-9)


def test_metrics_extractor_hook(spark):
    from glean.operators import metrics as M

    def fn(code):
        if code == "boom":
            raise ValueError("no")
        return {"loc": 10, "v": float("inf")}

    df = spark.createDataFrame([(1, "ok"), (2, "boom")], "doc_id long, text string")
    rows = {r.doc_id: r for r in M.extract(df, fn).collect()}
    assert rows[1].loc == 10 and rows[1].v == 0.0 and rows[1].d == 0.0  # missing -> 0, inf -> 0
    assert rows[2].loc is None


def test_metrics_walk_skips_by_substring(spark, tmp_path):
    from glean.sources import tree

    for rel in ["a.py", "tests/t.py", ".github/w.py", "pkg/venv_tools/x.py", "pkg/ok/y.py", "node_modules/z.py", "pkg/__init__.py"]:
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    got = sorted(r.relative_path for r in tree.metrics_walk(spark, str(tmp_path)).collect())
    # tests/ is kept (no name pruning here); .github matches ".git"; __init__.py is not special-cased by the walk
    assert got == ["a.py", "pkg/__init__.py", "pkg/ok/y.py", "tests/t.py"]


def test_risk_text_block(spark):
    df = spark.createDataFrame([(0.42,), (0.1,)], "s double")
    imp = spark.createDataFrame([(0.7, 0.3)], "loc double, vg double")
    feats = spark.createDataFrame([(0.42, 12.0, 3.0), (0.1, 5.0, 1.0)], "s double, loc double, vg double")
    rows = R.top_reasons(feats, imp, ["loc", "vg"], 3).select(R.risk_text(F.col("s"), F.col("reasons")).alias("t")).collect()
    assert rows[0].t == (
        "🚨 ML RISK ANALYSIS: Score 0.42 (HIGH RISK)\nTop Risk Factors to investigate:\n"
        "- LOC: Impact 0.70 (Current Value: 12.0)\n- VG: Impact 0.30 (Current Value: 3.0)\n"
    )
    assert rows[1].t.startswith("🚨 ML RISK ANALYSIS: Score 0.10 (LOW RISK)")
    empty = df.select(R.risk_text(F.col("s"), F.array().cast("array<struct<feature:string,impact:double,value:double>>")).alias("t"))
    assert empty.first().t == "ML RISK ANALYSIS: No specific risk factors identified."


def test_running_total_under_heavy_coalescing(spark):
    random.seed(11)
    rows = [(random.randint(0, 3), i, random.randint(0, 5)) for i in range(20000)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = O.running_total(df, "k", [F.col("o").desc()], "v", "run", partitions=200)
    w = Window.partitionBy("k").orderBy(F.col("o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("v").over(w))
    assert got.select("k", "o", "run").exceptAll(want.select("k", "o", "run")).count() == 0


def test_incremental_index_over_several_batches(spark, tmp_path):
    from glean.streaming import incremental as S

    random.seed(2)
    words = [f"t{i}" for i in range(50)]
    src = tmp_path / "in"
    for part in range(3):
        rows = [(part * 100 + i, "", " ".join(random.choices(words, k=30)), "passed") for i in range(20)]
        spark.createDataFrame(rows, "doc_id long, relative_path string, text string, status string").write.parquet(str(src / f"p{part}"))
    schema = "doc_id long, relative_path string, text string, status string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    S.self_feed(stream, str(tmp_path / "chunks"), str(tmp_path / "ckpt"), index_path=str(tmp_path / "idx"))
    inc = K.read_increments(spark, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx" / "corpus")).select("epoch").distinct().count() >= 3  # one per file
    batch_docs = spark.read.parquet(str(tmp_path / "chunks")).select("chunk_id", "chunk")
    full = K.build_index(batch_docs, "chunk_id", "chunk")
    a = sorted(map(tuple, inc.term_stats.select("term", "df", F.round("idf", 9)).collect()))
    b = sorted(map(tuple, full.term_stats.select("term", "df", F.round("idf", 9)).collect()))
    assert a == b
    assert inc.corpus_stats.first().n_docs == full.corpus_stats.first().n_docs == 60


def test_ordinal_lag_equals_window_lag(spark):
    random.seed(13)
    rows = [(0, i, random.choice("xyz")) for i in range(4000)]  # hot key over many partitions
    rows += [(k, i, random.choice("xy")) for k in range(1, 300) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    got = O.ordinal_lag(df, "k", [F.col("o")], ["v"], "pos", partitions=16)
    w = Window.partitionBy("k").orderBy("o")
    want = df.withColumn("pos", F.row_number().over(w)).withColumn("prev_v", F.lag("v").over(w))
    cols = ["k", "o", "pos", "prev_v"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0 and got.count() == df.count()


def test_exclude_before_and_after(spark):
    docs = spark.createDataFrame(
        [(1, "alpha alpha beta", "svc/a.py"), (2, "alpha beta", "svc/a.py.bak"), (3, "alpha", "other/c.py"), (4, "gamma", "x/d.py")],
        "doc_id long, text string, relative_path string",
    )
    idx = K.build_index(docs)
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    targets = spark.createDataFrame([(1, "svc/a.py")], "query_id long, target_file string")
    paths = docs.select("doc_id", "relative_path")
    after = K.search_excluding(q, idx, targets, paths, k=2, exclude="after").first()
    before = K.search_excluding(q, idx, targets, paths, k=2, exclude="before").first()
    # After: the top 2 are both under svc/a.py* -> nothing external left.
    assert after.found is False
    # Before: self documents removed first, the next best survives.
    assert before.found is True and before.doc_id == 3


def test_exact_quantiles_with_hot_value(spark):
    import numpy as np

    random.seed(17)
    vals = [0.0] * 3000 + [random.random() * 10 for _ in range(6000)] + [5.0] * 7
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    long = R.unpivot(df, ["x"])
    got = {r.q: r.quantile for r in R.exact_quantiles(long, (0.1, 0.25, 0.5, 0.75, 0.999)).collect()}
    for q, v in got.items():
        assert math.isclose(v, float(np.quantile(vals, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_exact_quantiles_of_extreme_values(spark):
    rng = random.Random(5)
    tiny, huge = 5e-324, 1.7976931348623157e308
    columns = {
        "powers": [rng.choice((-1, 1)) * 2.0 ** rng.randint(-1074, 1023) for _ in range(500)],
        "near_one": [1.0 + k * 2.0**-52 for k in range(300)],
        "edges": [tiny, -tiny, 2 * tiny, 0.0, -0.0, 1.0, 1.0 - 2.0**-53, huge, 1e-310],
        "one": [7.25],
        "same": [3.0] * 50,
        "infinite": [float("-inf")] * 3 + [1.0, 2.0] + [float("inf")] * 4,
    }
    rows = [(c, v) for c, vs in columns.items() for v in vs] + [("nulls", None), ("near_one", None)]
    long = spark.createDataFrame(rows, "column_name string, value double")
    qs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {(r.column_name, r.q): r.quantile for r in R.exact_quantiles(long, qs).collect()}
    assert {c for c, _ in got} == set(columns)
    for (c, q), v in got.items():
        vs = sorted(columns[c])
        h = (len(vs) - 1) * q
        lo, hi = vs[math.floor(h)], vs[math.ceil(h)]
        assert v == (lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)), (c, q)
    with_nan = spark.createDataFrame([("x", v) for v in (1.0, float("nan"), 2.0)], "column_name string, value double")
    mid, top = R.exact_quantiles(with_nan, (0.5, 1.0)).sort("q").collect()
    assert mid.quantile == 2.0 and math.isnan(top.quantile)
    assert R.exact_quantiles(long.limit(0)).count() == 0


def test_knn_is_exact_under_many_ties(spark):
    import random

    from glean.operators import knn as N

    ids = list(range(400))
    random.Random(1).shuffle(ids)
    v = spark.createDataFrame([(i, [0.25, 0.5, 1.0] if i < 390 else [float(i), 0.0, 0.0]) for i in ids], "id long, vec array<double>").repartition(6)
    q = v.withColumnRenamed("id", "query_id")
    for target in (20_000, 50):
        got = N.knn(q, v, k=5, cell_target=target).filter("query_id = 7").orderBy("rank").collect()
        assert [r.id for r in got] == [0, 1, 2, 3, 4]
        got = N.knn(q, v, k=5, exclude_self=True, cell_target=target).filter("query_id = 3").orderBy("rank").collect()
        assert [r.id for r in got] == [0, 1, 2, 4, 5]
    assert N.knn(q, v, k=1000).count() == 400 * 400


def test_running_totals_with_null_keys_and_large_ids(spark):
    from glean.operators.ordered import ordinal, ordinal_lag

    big = 1 << 60
    rows = [(None if i < 60 else "k", i, big + i) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, o int, id long").repartition(5)
    pos = {r.o: r.pos for r in ordinal(df, "key", [F.col("o")], partitions=4).collect()}
    assert pos == {i: i + 1 if i < 60 else i - 59 for i in range(90)}
    lag = {r.o: (r.pos, r.prev_id) for r in ordinal_lag(df, "key", [F.col("o")], ["id"], partitions=4).collect()}
    assert lag == {i: (pos[i], None if i in (0, 60) else big + i - 1) for i in range(90)}


def test_language_chooses_the_separators(spark):
    code = "import os\n" + "x = 1\n" * 20 + "class A:\n    y = 2\n" + "    z = 3\n" * 10 + "def f():\n    return 1\n"
    df = spark.createDataFrame([(1, code, "python"), (2, code, "go"), (3, None, "python")], "doc_id int, text string, language string")
    rows = C.split_recursive(df, size=150, overlap=0, language_col="language").collect()
    chunks = {d: [r.chunk for r in rows if r.doc_id == d] for d in (1, 2, 3)}
    assert chunks[3] == [] and all(len(c) <= 150 for v in chunks.values() for c in v)
    assert any(c.startswith("A:") for c in chunks[1]) and not any(c.startswith("A:") for c in chunks[2])


def test_patches_in_order(spark):
    docs = spark.createDataFrame([("a", "one two")], "relative_path string, text string")
    p = lambda s, r: f"{PT.SEARCH_MARK}\n{s}\n{PT.DIVIDER}\n{r}\n{PT.REPLACE_MARK}"
    patches = spark.createDataFrame([("a", 2, p("three", "four")), ("a", 1, p("one", "three"))], "relative_path string, n int, patch string")
    got = PT.apply_in_order(docs, patches, "n").first()
    assert (got.content, got.modes) == ("four two", ["exact", "exact"])


def _documents(spark, path, rows):
    df = spark.createDataFrame([(i, t, "en", "src2", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_task_run_searches_with_the_whole_text(spark, tmp_path):
    from glean.plans import tasks

    rows = [(50, "alpha\nzebra quokka"), (100, "beta\nzebra quokka"), (150, "\ngamma delta"), (200, "epsilon\ndelta"), (250, "none")]
    rows = [(i, f"{t} " + " ".join(f"own{i}x{j}" for j in range(60))) for i, t in rows]  # enough volume for the gate
    got = {r.task_id: r.dependency_doc_id for r in tasks.q_task_run(spark, _documents(spark, tmp_path, rows)).collect()}
    assert got == {50: 100, 100: 50, 150: 200, 200: 150, 250: None}


def test_task_run_takes_every_fiftieth_file_against_all(spark, tmp_path):
    from glean.plans import tasks

    rows = [(100, "zebra quokka"), (7, "okapi\nzebra quokka"), (150, "gamma"), (-50, "lynx"), (51, "lynx gamma"), (0, "ibex")]
    rows = [(i, f"{t} " + " ".join(f"own{i}x{j}".replace("-", "m") for j in range(60))) for i, t in rows]
    got = {r.task_id: r.dependency_doc_id for r in tasks.q_task_run(spark, _documents(spark, tmp_path, rows)).collect()}
    assert got == {100: 7, 150: 51, -50: 51, 0: None}


def test_code_metrics_reads_whole_texts(spark, tmp_path, monkeypatch):
    import ast

    from glean.plans import corpus

    text = "it's \\ a 'quote' \'\'\' end\\\nsecond line\n\tthird \u00e9"
    sf = _documents(spark, tmp_path, [(1, text), (2, ""), (3, "a\na\nb")])
    seen, real = [], corpus.M.code_metrics
    monkeypatch.setattr(corpus.M, "code_metrics", lambda df: seen.append(df) or real(df))
    rows = corpus.q_code_metrics(spark, sf).collect()
    codes = {r.doc_id: r.text for r in seen[0].collect()}
    held = {
        i: "\n".join(n.value for n in sorted((n for n in ast.walk(ast.parse(c)) if isinstance(n, ast.Constant)), key=lambda n: n.lineno))
        for i, c in codes.items()
    }
    assert held == {1: text, 2: "", 3: "a\na\nb"}
    # An assignment and two loops; one assignment; three branches.
    assert {r.doc_id: (r.loc, r.vg) for r in rows} == {1: (7.0, 5.0), 2: (3.0, 1.0), 3: (8.0, 4.0)}
    lines = {r.doc_id: (r.loc, r.vg, r.d) for r in corpus.q_code_metrics_lines(spark, sf).collect()}
    assert lines == {1: (5.0, 1.0, 3.0), 2: (3.0, 1.0, 3.333333), 3: (5.0, 1.0, 3.75)}


def test_split_keeps_rows_with_null_ids(spark):
    from glean.operators import risk as R

    rows = [(None if i % 3 == 0 else i, i % 2, i) for i in range(1000)] + [(None, None, 1000 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, y int, n int")
    got = R.stratified_split(df, "y", F.col("id")).collect()
    assert sorted(r.n for r in got) == sorted(r[2] for r in rows)
    for y, size in ((0, 500), (1, 500), (None, 10)):
        assert sum(r.y == y and r.split == "test" for r in got) == -(-size // 5)


def test_forest_scores_batches_as_spark_ml_does(spark, monkeypatch):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    rng = random.Random(5)
    rows = [(i, rng.random(), float(rng.randrange(4)), rng.gauss(0, 9), rng.randrange(2), 1.0 + i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int, weight double").coalesce(1).cache()
    model = R.fit_forest(df, ["a", "b", "c"], "y", trees=30, depth=12)
    odd = [(1000, None, 1.0, 2.0), (1001, float("nan"), None, None), (1002, float("inf"), -0.0, float("-inf")), (1003, 0.5, 9.0, 0.0)]
    # Values that equal a threshold go left.
    at = [float(x) for x in model.stages[-1].toDebugString.split() if x.endswith(")") for x in [x.strip("()")] if "." in x]
    odd += [(2000 + i, x, x, x) for i, x in enumerate(sorted(set(at))[:50])]
    rows = df.select("id", "a", "b", "c").unionByName(spark.createDataFrame(odd, "id int, a double, b double, c double"))
    want = {r.id: r.p for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert max(sum("Predict" in line for line in t.toDebugString.splitlines()) for t in model.stages[-1].trees) > 64
    monkeypatch.setattr(PipelineModel, "transform", None)  # no row is walked through the trees
    got = R.score(rows, model)
    assert got.columns == ["id", "a", "b", "c", "risk_score"]
    assert {r.id: r.risk_score for r in got.collect()} == want


def test_forest_is_fitted_on_all_training_rows(spark, monkeypatch):
    from glean.operators import risk as R
    from glean.plans import risk as plans

    cols = [f"CAST(id % 7 AS DOUBLE) AS {c}" for c in plans.MODEL_COLS]
    ids = [f"id AS {c}" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    train = R.with_weights(spark.range(1500).selectExpr(*ids, *cols, "CAST(id % 3 = 0 AS INT) AS defects"), "defects")
    seen = []
    monkeypatch.setattr(R, "fit_forest", lambda df, *a, **b: seen.append(df))
    plans._forest(train)
    assert sorted(r.l_orderkey for r in seen[0].collect()) == list(range(1500))


def test_forest_grown_on_the_executors(spark, monkeypatch):
    from glean.operators import forest
    from glean.operators import risk as R

    rng = random.Random(3)
    rows = [(i, rng.random() * 9, float(rng.randrange(4)), rng.gauss(0, 1), i % 5) for i in range(3000)]
    rows = [(i, a, b, c, int((a > 4) ^ (b >= 2) ^ (e == 0))) for i, a, b, c, e in rows]
    df = R.with_weights(spark.createDataFrame(rows, "id int, a double, b double, c double, y int"), "y")
    args = (df, ["a", "b", "c"], "y", 40, 6)
    small = R.fit_forest(df.limit(2400), *args[1:])  # of Spark ML
    want = {r.id: r.risk_score for r in R.score(df.select("id", "a", "b", "c"), small).collect()}
    like = {r.feature: r.importance for r in R.importances(small, ["a", "b", "c"]).collect()}
    monkeypatch.setattr(R, "ML_DRAWS", 0)
    model = R.fit_forest(*args)
    assert isinstance(model, forest.Grown)
    odd = spark.createDataFrame([(9000, None, 1.0, float("nan")), (9001, float("inf"), None, 0.0), (9001, float("inf"), None, 0.0)], "id int, a double, b double, c double")
    scored = R.score(df.select("id", "a", "b", "c").unionByName(odd), model)
    assert scored.columns == ["id", "a", "b", "c", "risk_score"]
    got = [(r.id, r.risk_score) for r in scored.collect()]
    assert len(got) == 3003 and all(0 <= p <= 1 for _, p in got)
    got = dict(got)
    # Other draws than Spark ML's, the same forest otherwise: the rule is learned, scores and importances are close.
    assert sum(abs(got[i] - want[i]) for i in want) / len(want) < 0.05
    found = {r.feature: r.importance for r in R.importances(model, ["a", "b", "c"]).collect()}
    assert sum(found.values()) == pytest.approx(1) and all(abs(found[c] - like[c]) < 0.1 for c in like)
    assert {r.id: r.risk_score for r in R.score(df, R.fit_forest(*args)).collect()} == {i: got[i] for i in want}


def test_a_grown_tree_splits_as_brute_force():
    import numpy as np

    from glean.operators.forest import Tree

    class Fixed:  # every row once, all features in order
        poisson = staticmethod(lambda counts: counts)
        random = staticmethod(lambda shape: np.zeros(shape) + np.arange(shape[1]))

    rng = np.random.default_rng(8)
    bins = np.unique(rng.integers(0, 6, (90, 3)).astype(np.uint8), axis=0)
    counts, w = rng.integers(0, 4, (2, len(bins))), np.array([0.7, 1.9])

    def gini(t):
        p = t * w / (t @ w)
        return 1 - (p * p).sum()

    def brute(rows, depth):
        t = counts[:, rows].sum(1)
        best = (1e-12, None)
        if depth and (t > 0).all():
            for f in range(3):
                for b in range(6):
                    left = bins[rows, f] <= b
                    l, r = counts[:, rows[left]].sum(1), counts[:, rows[~left]].sum(1)
                    if l.sum() and r.sum():
                        gain = gini(t) - ((l @ w) * gini(l) + (r @ w) * gini(r)) / (t @ w)
                        if gain > best[0] + 1e-13:
                            best = (gain, (f, b))
        said, share = int(t[1] * w[1] > t[0] * w[0]), t[1] * w[1] / (t @ w)
        if best[1] is None:
            return said, dict.fromkeys(rows.tolist(), share), True
        left = bins[rows, best[1][0]] <= best[1][1]
        (p, x, leaf), (q, y, end) = brute(rows[left], depth - 1), brute(rows[~left], depth - 1)
        if leaf and end and p == q:
            return p, dict.fromkeys(rows.tolist(), share), True
        return said, x | y, False

    rows = np.flatnonzero(counts.sum(0))
    for depth in (0, 1, 3, 20):
        tree = Tree(bins, counts, w, depth, 3, Fixed)
        want = brute(rows, depth)[1]
        assert np.allclose(tree.shares(bins[rows]) / (1 << 40), [want[i] for i in rows.tolist()], atol=1e-9)
