"""Operator 11: ids against the library, pieces and sequences against their law."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glean.llm import packing, queries
from glean.llm.common import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return packing.Words(PATH)


def as_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_ids_are_those_of_the_library(words, monkeypatch):
    rnd = random.Random(2)
    letters = list(" \t\n\x0b\x0c\r\x1c\x85\xa0 aAbZ'stré́١½²!?.,<|>Σς日​İ_-\x00가\U0001f600") + ["<|endoftext|>", "'s ", "don't "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + [None, "", "x" * 5000]
    want = [words._tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    assert [ids.tolist() for _, ids in packing.tokenised(as_batch(texts), words)] == want
    monkeypatch.setattr(packing, "STRETCH", 7)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5)
    assert [ids.tolist() for _, ids in packing.tokenised(as_batch(texts), words)] == want


def check(rows, texts, words, least_share=None):
    """``texts``: (doc_id, text) of every row packed."""
    ids = defaultdict(list)
    for d, t in texts:
        ids[d].append(np.array(words._tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, copies in ids.items():
        assert sum(p[1] for p in pieces[d]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for start, n, crc, total in sorted(pieces[d]):
                assert (start, total) == (at, len(copies[0]))
                assert crc == zlib.crc32(copies[0][at : at + n].tobytes())
                at += n
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    share = padding / max(1, sum(r.length for r in rows) + padding)
    assert least_share is None or share <= least_share
    return share


@pytest.mark.parametrize("tasks", [1, 9, 70])
def test_every_id_in_one_piece_and_little_padding(spark, words, tasks):
    docs = table(spark, SF, "documents")
    rows = packing.pack(docs.repartition(tasks), PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], words, 0.01)


def test_query(spark, words):
    docs = table(spark, SF, "documents")
    got = queries.op11_packing(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(got.collect(), [(r.doc_id, r.text) for r in docs.collect()], words, 0.01)


def test_ids_of_the_pieces_make_the_documents(spark, words):
    docs = table(spark, SF, "documents").limit(40)
    found = defaultdict(list)
    for r in packing.pack(docs, PATH, with_ids=True).collect():
        found[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4")))
    for r in docs.collect():
        whole = np.concatenate([ids for _, ids in sorted(found[r.doc_id], key=lambda x: x[0])])
        assert whole.tolist() == words._tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]


def test_packer_is_best_fit_in_bounded_space():
    piece = lambda n: packing.Piece(0, 0, np.zeros(n, np.uint16), n)
    packer = packing.Packer(window=10, open_windows=2, least_cut=4)
    assert [list(packer.add(piece(n))) for n in (6, 7)] == [[], []]
    assert list(packer.add(piece(3)))[0][0].total == 7  # the window that it fills best
    assert list(packer.add(piece(25))) and len(packer.rest()) == 2  # two whole windows, five ids stay
    (full,) = packer.add(piece(8))  # no room: the fullest goes, its gap of four takes the head
    assert [len(p.ids) for p in full] == [6, 4]
    assert sorted(sum(len(p.ids) for p in w) for w in packer.rest()) == [9]  # the rest fits the other
    ends = [sum(len(p.ids) for p in w) for w in packing.filled([[piece(9)], [piece(9), piece(9)]], 10)]
    assert ends == [10, 10, 4, 2, 1]


def test_odd_input(spark, words):
    long = " ".join(f"w{i % 977}x" for i in range(200_000))
    rows = [(None, "one two", "x"), (1, None, "x"), (2, "", None), (3, " \t\n", "y"), (6, long, "x")] + [(4, "five five", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("open", F.lit(1)).withColumn("t", F.lit(2))
    check(packing.pack(docs, PATH).collect(), [r[:2] for r in rows], words)
    assert packing.pack(docs.limit(0), PATH).count() == 0
