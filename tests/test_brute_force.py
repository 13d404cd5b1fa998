"""Queries that SQL cannot express, over all documents, against plain readings of their rules."""

import hashlib
import io
import tokenize


from glean.operators import chunk as C
from glean.plans.registry import load_all

SF = "/root/testdata/sf0.01"


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_recursive_chunks_of_all_documents(spark):
    """Chunks are stretches of whole words in order; they cover the text, overlap by no more than allowed, and are full."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    by_doc: dict = {}
    for r in C.split_recursive(docs).sort("doc_id", "chunk_no").collect():
        assert r.chunk_no == len(by_doc.setdefault(r.doc_id, []))
        by_doc[r.doc_id].append(r.chunk)
    texts = _texts(spark)
    assert set(by_doc) == {d for d, t in texts.items() if t and t.strip()}
    several = 0
    for doc, chunks in by_doc.items():
        words, spaces_only = texts[doc].split(), "\n" not in texts[doc]
        several += len(chunks) > 1
        ends = {0}  # where the chunks so far may end: texts that repeat a word leave several places
        for i, c in enumerate(chunks):
            assert len(c) <= C.CHUNK_SIZE
            mine = c.split()
            starts = set()
            for end in ends:
                s, held = end, 0
                while s >= 0 and held <= C.CHUNK_OVERLAP:
                    starts.add(s)
                    s -= 1
                    held += len(words[s]) + (held > 0)
            starts = {s for s in starts if words[s : s + len(mine)] == mine}
            if spaces_only and i + 1 < len(chunks):
                # The next word would not have fitted.
                starts = {s for s in starts if s + len(mine) < len(words) and len(c) + 1 + len(words[s + len(mine)]) > C.CHUNK_SIZE}
            assert starts, (doc, i)
            ends = {s + len(mine) for s in starts}
        assert len(words) in ends, doc
    assert several > 100
    got = load_all()["chunk_recursive"].fn(spark, SF)
    have = {(r.doc_id, r.chunk_no): (r.n_chars, r.chunk_md5) for r in got.collect()}
    assert have == {(d, i): (len(c), _md5(c)) for d, cs in by_doc.items() for i, c in enumerate(cs)}


def test_code_tokens_of_all_documents(spark):
    """Python's own tokenizer on the whole text; where it fails, the word rule, which SQL checks."""
    fallback = {r.doc_id: (r.n_tokens, r.tokens_md5) for r in load_all()["fallback_tokens"].fn(spark, SF).collect()}
    got = {r.doc_id: (r.n_tokens, r.tokens_md5) for r in load_all()["code_tokens"].fn(spark, SF).collect()}
    texts = _texts(spark)
    assert set(got) == set(texts)
    lexed = 0
    for doc, text in texts.items():
        want = fallback[doc]
        if text is not None:
            try:
                toks = list(tokenize.generate_tokens(io.StringIO("def " + text).readline))
            except (tokenize.TokenError, SyntaxError):
                toks = None
            if toks is not None:
                lexed += 1
                out = []
                for i, t in enumerate(toks):
                    if t.type not in (tokenize.NAME, tokenize.STRING, tokenize.NUMBER):
                        continue
                    out.append(t.string.lower())
                    if t.string in ("def", "class") and toks[i + 1].type == tokenize.NAME:
                        out.append(f"{t.string}_{toks[i + 1].string.lower()}")
                want = (len(out), _md5(" ".join(out)))
        assert got[doc] == want, (doc, (text or "")[:80])
    assert 0 < lexed
