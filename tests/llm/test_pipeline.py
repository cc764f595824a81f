"""The pipeline's stages against brute force, and their cases: nulls, empty, ties, repeats, clashing names."""

import random
import re

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from tidegraph.llm import similar  # noqa: E402

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "s", "t", "nd", "l")]
BENCH = "which of the seven rivers named in the old song reaches the inner sea first"


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def rows(seed=3):
    rng = random.Random(seed)
    out, n = [], 0

    def add(text, lang="en", source="web"):
        nonlocal n
        n += 1
        out.append((n, text, lang, source, None if text is None else len(text)))

    clean = [prose(rng, rng.randint(80, 400)) for _ in range(40)]
    for x in clean:
        add(x)
    add(None)
    add("")
    add("short text only")
    add("# $ % & " * 40)
    add(clean[0])  # an exact copy
    for k in (1, 2, 3):  # near copies
        w = clean[k].split()
        w[len(w) // 2] = "changed"
        add(" ".join(w))
    w = clean[4].split()
    half = len(w) // 2
    add(" ".join([*w[:half], *prose(rng, half).split()]))  # half a copy: not near
    add(prose(rng, 60) + " " + BENCH + " " + prose(rng, 60))
    add(prose(rng, 90) + " write to someone@example.org or call +44 20 7946 0958 " + prose(rng, 40))
    out.append(out[9])  # the same row again
    return out


def frames(spark, path, data, extra=False):
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("rejected_by", "t", "g", "token", "_kind", "ids2"):
            docs = docs.withColumn(c, docs["lang"])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, BENCH), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def through(spark, sf, upto):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:upto]:
        docs = stage(spark, docs, sf)
    return docs


def test_stages_keep_clean_rows_and_take_effect(spark, tmp_path):
    data = rows()
    sf = frames(spark, tmp_path, data)
    after = [sorted(r["doc_id"] for r in through(spark, sf, k).select("doc_id").collect()) for k in range(1, 5)]
    assert after[0] == sorted(r[0] for r in data if r[0] <= 40 or r[0] >= 45)
    # near-duplicates: brute force over what stays, components of a similarity of 0.8 or more; the least id stays
    stay = [r for r in data if r[0] in set(after[0])]
    sets, root = [shingles(r[1]) for r in stay], list(range(len(stay)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            met = len(a & sets[j])
            if 10 * met >= 8 * (len(a) + len(sets[j]) - met):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(stay):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    assert after[1] == sorted(least.values())
    leaked = [r[0] for r in stay if BENCH in r[1]]
    assert after[2] == [x for x in after[1] if x not in leaked]
    assert after[3] == after[2]
    private = next(r[0] for r in data if r[1] and "someone@" in r[1])
    text = {r["doc_id"]: r["text"] for r in through(spark, sf, 4).collect()}
    assert "[EMAIL]" in text[private] and "[PHONE]" in text[private] and "someone@" not in text[private]
    assert text[1] == data[0][1]
    out = pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in out.collect()) == after[3]
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in out.collect())


def test_other_columns_pass(spark, tmp_path):
    sf = frames(spark, tmp_path, rows(), extra=True)
    before = spark.read.parquet(f"{sf}/documents.parquet").columns
    for k in range(1, 5):
        out = through(spark, sf, k)
        assert out.columns == before
    assert all(r["rejected_by"] == r["lang"] == r["t"] == r["token"] for r in out.collect())


@pytest.mark.parametrize("data", [[], [(None, None, None, None, None)] * 3, [(1, "", "en", "a", 0), (None, "", None, None, 0)]])
def test_empty_tables_and_nulls(spark, tmp_path, data):
    assert pipeline.run(spark, frames(spark, tmp_path, data)).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m, met in ((10, 10, 9), (500, 450, 440), (3000, 2600, 2000), (70, 4000, 60)):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m), dtype=np.uint64))
        rng.shuffle(pool)
        a, b = pool[:n], pool[n - met : n - met + m]
        assert similar.differ(similar.parities(a), similar.parities(b)) <= n + m - 2 * met
        short = np.bitwise_count((similar.short_parities(a) ^ similar.short_parities(b)).view(np.uint64)).sum()
        assert short <= n + m - 2 * met
    assert similar.differ(similar.parities(a), similar.parities(a)) == 0
