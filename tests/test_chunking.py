import math
import re

import pytest

from tidegraph.operators.chunking import ChunkingStrategyComparator, FixedSizeChunker, RecursiveChunker, SentenceChunker, chunk_docs

TEXTS = [
    "", "   \n ", "abc", "a" * 10, "a" * 11, "word " * 200, "One. Two! Three? Four.  Five.\nSix", "\n\nlead " + "x" * 30, "para one here.\n\npara two is here.\n\n" + "y" * 40 + "\n\nend",
    "short " + "z" * 35 + " tail of words that go on", "é\u00a0ü. ß\u202fö! ñ", "a. b. c. d. e. f. g", "line\n" * 12, ". . . . . . . .",
]


def run(spark, chunker):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    return [r["c"] for r in df.select("i", chunker.chunks("t").alias("c")).orderBy("i").collect()]


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (10, 9), (5, 7)])
def test_fixed(spark, size, overlap):
    def spec(t):
        if not t or len(t) <= size:
            return [t] if t else []
        out, at = [], 0
        while overlap < size:
            out.append(t[at : at + size])
            if at + size >= len(t):
                break
            at += size - overlap
        return out

    assert run(spark, FixedSizeChunker(size, overlap)) == [spec(t) for t in TEXTS]


def test_fixed_needs_a_step():
    with pytest.raises(ValueError):
        FixedSizeChunker(5, 5).chunks("t")


@pytest.mark.parametrize("n", [0, 1, 3])
def test_sentences(spark, n):
    def spec(t):
        parts = [p for p in map(str.strip, re.split(r"(?<=[.!?])\s+", t.strip())) if p]
        k = max(1, n)
        return [" ".join(parts[i * k : i * k + k]) for i in range(math.ceil(len(parts) / k))]

    assert run(spark, SentenceChunker(n)) == [spec(t) for t in TEXTS]


def pieces(text, seps, size):
    """A plain statement of the rule, for comparison."""
    if len(text) <= size:
        return [text]
    if not seps or not seps[0]:
        return [text[i : i + size] for i in range(0, len(text), size)]
    out, held = [], ""
    for p in text.split(seps[0]):
        joined = held + seps[0] + p if held else p
        if len(joined) > size:
            out += [held] if held else []
            held, more = (p, []) if len(p) <= size else ("", pieces(p, seps[1:], size))
            out += more
        else:
            held = joined
    return out + ([held] if held else [])


@pytest.mark.parametrize("seps", [None, [], ["\n", " "], ["*", ""]])
@pytest.mark.parametrize("size", [7, 20])
def test_recursive(spark, seps, size):
    own = ["\n\n", "\n", ". ", " ", ""] if seps is None else seps
    want = [[p for p in pieces(t, own, size) if p.strip()] if t else [] for t in TEXTS]
    assert run(spark, RecursiveChunker(seps, size)) == want


def test_compare(spark):
    df = spark.createDataFrame([(1, "a b. c d. " * 40), (2, "")], "doc_id int, text string")
    rows = {(r["doc_id"], r["strategy"]): r for r in ChunkingStrategyComparator().compare(df, 50).collect()}
    assert len(rows) == 6
    assert rows[2, "recursive"]["n_chunks"] == 0 and rows[2, "recursive"]["avg_length"] == 0
    assert rows[1, "fixed_size"]["n_chunks"] == 8 and rows[1, "fixed_size"]["avg_length"] == 50


def test_chunk_docs(spark):
    df = spark.createDataFrame([("d", "x" * 30, {"doc_id": "other", "k": "v"}), ("e", "", None)], "id string, content string, metadata map<string,string>")
    rows = chunk_docs(df, 20).orderBy("chunk_idx").collect()
    assert [(r["id"], r["metadata"]) for r in rows] == [("d#0", {"doc_id": "d", "k": "v"}), ("d#1", {"doc_id": "d", "k": "v"})]


def test_compare_query_has_every_strategy(spark, tmp_path):
    """The query and its SQL, over texts that every separator cuts."""
    duckdb = pytest.importorskip("duckdb")
    from tidegraph.plans import registry

    texts = [t for t in TEXTS if t] + ["p. " * 90 + "\n\n" + "w" * 450 + " tail. " + "line of words\n" * 40, " \u2003" * 150, "y" * 401, "a b" * 300 + "\n\n\n" + "c. d" * 99, "  \n\n  " * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["strategy"]): (r["n_chunks"], r["avg_length"]) for r in registry.chunk_compare(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {(i, s): (n, x) for i, s, n, x in con.execute(registry.ORACLE_SQL["chunk_compare"]).fetchall()}
    assert len(got) == 3 * len(texts)
    assert {k: v for k, v in got.items() if k[1] != "by_sentences"} == {k: v for k, v in want.items() if k[1] != "by_sentences"}
