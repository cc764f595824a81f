import pytest
from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.operators.lawparse import parse_articles, parse_cases
from tidegraph.operators.linking import link, link_entity

KNOWN = ["mua bán trái phép chất ma túy", "tàng trữ trái phép chất ma túy", "vận chuyển trái phép chất ma túy"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).head()[0]


@pytest.mark.parametrize("name,want", [("  Tội  Mua  bán ", "mua bán"), ('"Tội x"', "x"), ('" tội x"', " tội x".strip()), ("TỘI", "tội"), ("“Tội tội a”", "tội a"), ("", "")])
def test_normalize(spark, name, want):
    assert one(spark, name, X.normalize_name) == want


def test_terms_in_catalog_order(spark):
    assert one(spark, "ketamine và METHAMPHETAMINE", X.find_terms) == ["Methamphetamine", "Amphetamine", "Ketamine"]


def test_quantities(spark):
    assert one(spark, "thu 1,5 KG, 20gam và 3 kgx", X.quantities) == ["1.5kg", "20gam"]


def test_article_refs(spark):
    assert one(spark, "Điều 251 và điều  7", X.article_refs) == ["Điều 251 BLHS", "Điều 7 BLHS"]


@pytest.mark.parametrize("text,want", [("```json\n{}\n```", "{}"), ("```\na\n```\nrest", "a"), ("plain ``` x", "plain ``` x"), ("```", "")])
def test_fences(spark, text, want):
    assert one(spark, text, X.strip_fences) == want


@pytest.mark.parametrize("text,want", [(" Héllo World! ", "h-llo-world"), ("--", "document"), ("", "document")])
def test_slug(spark, text, want):
    assert one(spark, text, X.slugify) == want


@pytest.mark.parametrize("mention,want", [(KNOWN[0], KNOWN[0]), ("Tội " + KNOWN[1].upper(), KNOWN[1]), ("vận chuyển trái phép chất ma tuý", KNOWN[2]), ("cướp giật tài sản", None), ("", None)])
def test_link(spark, mention, want):
    assert link_entity(mention, KNOWN, spark) == want


def test_link_keeps_the_last_spelling(spark):
    known = spark.createDataFrame([(0, "Tội A b"), (1, "a  B")], "ord long, name string")
    said = spark.createDataFrame([("tội a b",), (None,)], "mention string")
    assert {r["mention"]: r["linked"] for r in link(said, known).collect()} == {"tội a b": "a  B", None: None}


LAW = "Điều 9. x\n1. Người nào bán[2] bị phạt tù từ 1 năm đến 2 năm:\na) Heroine\n2. Nặng thì\nbị tù chung thân.\n3. Còn bị cảnh cáo.\n"


def test_articles(spark):
    meta = {"article": "Điều 9 BLHS", "title": "Điều 9 BLHS. Tội Bán x", "law": "BLHS"}
    docs = spark.createDataFrame([("d9", LAW, meta), ("d1", "no clauses", {"article": "Điều 1", "title": "Phạm vi"})], "id string, content string, metadata map<string,string>")
    a, b = sorted(parse_articles(docs).collect(), key=lambda r: r["doc_id"], reverse=True)
    assert (a["title"], a["crime"], a["law"]) == ("Tội Bán x", "bán x", "BLHS")
    assert [(c["id"], c["number"], c["penalty"], c["substances"]) for c in a["clauses"]] == [("Điều 9 BLHS khoản 1", 1, "phạt tù từ 1 năm đến 2 năm", ["Heroine"]), ("Điều 9 BLHS khoản 2", 2, "", []), ("Điều 9 BLHS khoản 3", 3, "cảnh cáo", [])]
    assert a["clauses"][0]["text"].startswith("1. Người nào bán bị") and b["clauses"] == [] and b["crime"] is None


@pytest.mark.parametrize("answer,n", [('{"cases": [{"name": "a"}]}', 1), ("oops", 0), ("[1]", 0), ('{"x": 1}', 0), ('```json\n{"cases": [{"name": "a"}, {}]}\n```', 2), (None, 0)])
def test_cases(spark, answer, n):
    assert len(parse_cases(spark.createDataFrame([(answer,)], "answer string")).head()["cases"]) == n


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(["aaaa", "b" * 7, "aaaa", "cc", "d"],)], "f array<string>")
    got = lambda **k: df.select(X.budget("f", **k)).head()[0]
    assert got(most=60, chars=8) == ["aaaa", "cc", "d"] and got(most=2, chars=8) == ["aaaa", "cc"] and got(most=0) == []


def test_recall(spark):
    df = spark.createDataFrame([("Mức PHẠT tù", ["phạt", "x"]), ("a", [])], "a string, k array<string>")
    assert [r[0] for r in df.select(X.keyword_recall("a", "k")).collect()] == [0.5, None]


def test_link_compares_distinct_mentions_once_and_like_difflib(spark, tmp_path):
    """However often a mention stands, it is compared once; what is left out by its characters could not have won."""
    import difflib
    import random

    from tidegraph.operators import linking

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé# 1ầ漢") for _ in range(r.randint(1, 9))).strip() or "a"
    names, said = sorted({word() for _ in range(120)}), [word() for _ in range(60)]
    known = spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    rows = spark.createDataFrame([(m,) for m in said * 3], "mention string")
    got = {x["mention"]: x["linked"] for x in link(rows, known, normalize=lambda x: x).collect()}
    assert got == {m: m if m in names else next(iter(difflib.get_close_matches(m, names, n=1, cutoff=linking.CUTOFF)), None) for m in said}
    plan = link(rows, known, normalize=lambda x: x)._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")
    assert len(plan) == 2 and "Aggregate" in plan[1]


@pytest.mark.parametrize("few", [0, 100])
def test_link_cases_by_one_map_or_by_maps_of_their_own(spark, few, monkeypatch):
    from tidegraph.operators import linking

    monkeypatch.setattr(linking, "FEW", few)
    answers = ['{"cases": [{"charges": ["Tội B", "b", "A", "zzz"], "people": [{"name": "p", "charge": "TỘI A"}, {"name": "q"}]}, {"name": "n"}]}', '{"cases": [{"charges": ["zzz"]}]}', "{oops", None]
    docs = parse_cases(spark.createDataFrame([(str(i), a) for i, a in enumerate(answers)], "id string, answer string")).drop("answer")
    out = linking.link_cases(docs, spark.createDataFrame([(1, "a"), (2, "b")], "ord long, name string"), fuzzy=False)
    got = {r["id"]: [(c["charges"], [p["charge"] for p in c["people"] or []]) for c in r["cases"]] for r in out.collect()}
    assert got == {"0": [(["a", "b"], ["a", ""]), ([], [])], "1": [([], [])], "2": [], "3": []}
    assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == (few == 0)
