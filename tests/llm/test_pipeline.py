"""Every stage of the pipeline against brute force on what the stage before it kept."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from glean.llm import decontam, langid  # noqa: E402
from glean.llm.common import stored, table  # noqa: E402
from tests.llm.test_native_operators import check_mix, check_shards  # noqa: E402
from tests.llm.test_text_operators import brute_components, brute_simhash, brute_tiles  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    extra = docs.limit(3).selectExpr("doc_id + 100000 AS doc_id", "'12 34 -- 56' AS text", "lang", "source", "n_chars")
    out = [stored(docs.unionByName(extra).withColumn("size", docs.n_chars), "test-pipeline")]
    for _, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test-pipeline"))
    return out


def test_columns_and_names(steps):
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_keeps_what_has_a_language(steps):
    before, after = (Counter(map(tuple, s.collect())) for s in steps[:2])
    assert after == Counter({r: n for r, n in before.items() if langid.words(r[1])})


def test_one_document_of_each_group_stays(steps):
    rows = {r.doc_id: brute_simhash(r.text) for r in steps[1].collect()}
    root, least = brute_components(set(rows.values())), {}
    for d, f in rows.items():
        least[root[f]] = min(d, least.get(root[f], d))
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(least.values()) and len(least) < len(rows)


def test_leaks_go_and_clean_documents_stay(spark, steps):
    bench = [decontam.tokens(r.text) for r in table(spark, SF, "benchmark").collect()]
    want = []
    for r in steps[2].collect():
        ws = decontam.tokens(r.text)
        grams = {tuple(ws[i : i + 4]) for i in range(len(ws))}
        near = [b for b in bench if any(tuple(b[k : k + 4]) in grams for k in range(len(b) - 3))]
        if not any(sum(x[2] for x in brute_tiles(b, ws, 4)) >= 0.7 * len(b) for b in near):
            want.append(r.doc_id)
    got = [r.doc_id for r in steps[3].collect()]
    assert sorted(got) == sorted(want) and len(got) < steps[2].count()


def test_mix_repeats_and_drops(spark, steps):
    from glean.llm import cube

    plan = cube.mix(steps[3]).collect()
    check_mix(plan, steps[3].collect(), 0.05)
    assert Counter(r.doc_id for r in steps[4].collect()) == +Counter({r.doc_id: r.copies for r in plan})


def test_shards(steps):
    check_shards(steps[5].collect(), [(r.doc_id, r.text) for r in steps[4].collect()])


def test_run_and_empty_input(spark, steps):
    once, again = (sorted(map(tuple, P.run(spark, SF).collect()), key=repr) for _ in "ab")
    assert once == again and len(once) == steps[5].count()
    docs = steps[0].limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
