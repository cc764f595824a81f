import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import vectors as V


def spec(text, dim=64):
    s, out = int(hashlib.md5(text.encode()).hexdigest(), 16), []
    for _ in range(dim):
        s = (s * 1664525 + 1013904223) % 2**32
        out.append(s / (2**32 - 1) * 2 - 1)
    n = math.sqrt(math.fsum(x * x for x in out)) or 1.0
    return [x / n for x in out]


def test_mock_embedder(spark):
    df = spark.createDataFrame([("",), ("hello",), ("xin chào",)], "t string")
    for r in df.select("t", V.MockEmbedder()("t").alias("v")).collect():
        assert r["v"] == pytest.approx(spec(r["t"]), abs=1e-12)


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 2.0], [-1.0, -2.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([3.0, 4.0, 9.0], [3.0, 4.0], 25 / (math.sqrt(106) * 5))])
def test_cosine(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(V.cosine("a", "b")).head()[0] == pytest.approx(want)


def flat(values):
    """A stand-in embedder: the number in the text."""
    return F.array(F.regexp_extract(values, r"(\d+)", 1).cast("double"))


def store(spark):
    s = V.EmbeddingStore(spark, flat)
    s.add_documents(spark.createDataFrame([("a", "2", {"lang": "vi"}), ("b", "3", {"lang": "en", "doc_id": "B"}), ("c", "3", None)], "id string, content string, metadata map<string,string>"))
    return s


def test_search_keeps_ties_in_order(spark):
    rows = store(spark).search("1", 2).collect()
    assert [(r["id"], r["score"]) for r in rows] == [("b#2", 3.0), ("c#3", 3.0)]
    assert rows[1]["metadata"] == {"doc_id": "c"} and set(rows[0].asDict()) == {"id", "content", "metadata", "score"}
    assert store(spark).search("1", 0).count() == 0 and store(spark).search("1", 9).count() == 3


def test_filter(spark):
    s = store(spark)
    ids = lambda **f: [r["id"] for r in s.search_with_filter("1", 5, f).collect()]
    assert ids(lang="vi") == ["a#1"] and ids(lang=None) == ["c#3"] and ids(lang="en", doc_id="B") == ["b#2"] and len(ids()) == 3


def test_delete(spark):
    s = store(spark)
    assert s.get_collection_size() == 3 and s.delete_document("B") and not s.delete_document("B") and s.get_collection_size() == 2
    s.add_documents(spark.createDataFrame([("d", "9", None)], "id string, content string, metadata map<string,string>"))
    assert s.search("1", 1).head()["id"] == "d#4"


def test_negative_k(spark):
    with pytest.raises(ValueError):
        store(spark).search("1", -1)


def test_every_benchmark_item_is_asked(spark, tmp_path):
    from tidegraph.plans import registry

    spark.createDataFrame([(i, f"text of {i} " * 20, "en", "s", 9) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"question {i}") for i in range(3, 63)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = registry.flat_prompt(spark, str(tmp_path)).collect()
    assert sorted(r["question_id"] for r in rows) == list(range(3, 63))
    assert all(f"question {r['question_id']}" in r["prompt"] for r in rows)


@pytest.mark.parametrize("blocks", [0, 5])
def test_batch_keeps_k_rows_a_query_and_task(spark, blocks, monkeypatch):
    """The same rows as from all pairs, nulls, odd numbers, lengths, copies and ties among them; no join makes a row a pair."""
    import random

    from pyspark.sql import Window

    monkeypatch.setattr(V, "QUERIES", 15)
    r, nan, inf = random.Random(7), float("nan"), float("inf")
    vec = lambda: r.choice([None, [], [nan, 1.0], [inf, 0.0, None], [0.1, 0.2, 0.3, 0.4]]) if r.random() < 0.1 else [r.choice([0.1, 0.3, -0.7, r.random()]) for _ in range(4)]
    items = spark.createDataFrame([(f"d{i % 90}#{i}", vec(), f"c{i}", {"k": str(i)}) for i in range(400)], "seq string, embedding array<double>, content string, metadata map<string,string>")
    asked = spark.createDataFrame([(i, vec()) for i in range(40)], "query_id long, query array<double>")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))
    pairs = items.crossJoin(asked).withColumn("score", V.dot("embedding", "query")).withColumn("rank", rank).filter("rank <= 3")
    shown = lambda df: sorted(map(str, df.select("query_id", "rank", "seq", "content", F.element_at("metadata", "k"), F.col("score").cast("string")).collect()))
    got = V.top_k_batch(items, asked, 3, blocks=blocks)
    assert shown(got) == shown(pairs)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_written_once(spark):
    """What is asked of the hits reads a table of k rows a question and does not search again."""
    from tidegraph.operators import agent

    store = spark.createDataFrame([(f"d#{i}", f"text {i}", {"doc_id": f"d{i}"}, [float(i)]) for i in range(9)], "seq string, content string, metadata map<string,string>, embedding array<double>")
    asked = spark.createDataFrame([(1, "7")], "question_id int, question string")
    hits = agent._hits(store, asked, flat, 3)
    assert [r["content"] for r in hits.orderBy("rank").collect()] == ["text 8", "text 7", "text 6"]
    assert hits._jdf.queryExecution().optimizedPlan().toString().startswith("Relation")
