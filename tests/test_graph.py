from pyspark.sql import functions as F

from tidegraph.operators import agent, graph
from tidegraph.operators.context import context
from tidegraph.operators.lawparse import CASE_SCHEMA, parse_articles

LAW = "1. Người nào bán bị phạt tù 1 năm:\n\nHeroine 5 gam\n\nkhác\n2. Cocaine bị tù 9 năm."


def built(spark):
    docs = spark.createDataFrame([("law1", LAW, {"article": "Điều 9 BLHS", "title": "Điều 9. Tội bán x", "law": "BLHS"}, 0)], "id string, content string, metadata map<string,string>, ord long")
    articles = parse_articles(docs).withColumn("ord", F.lit(0).cast("long"))
    cases = [
        ("news1", "t1", 0, '{"cases": [{"name": "Vụ một", "summary": "bắt 36 kg", "location": "Huế", "charges": ["bán x"], "substances": [{"name": "Cocaine", "amount": "36kg"}, {"name": ""}], "people": [{"name": "Lan", "aliases": ["A1"], "role": "bị cáo"}, {"name": ""}]}]}'),
        ("news2", "t2", 1, '{"cases": [{"name": "Vụ hai", "charges": [], "people": [{"name": "Lan", "aliases": ["A2"], "role": "r", "sentence": "8 năm"}]}, {"location": ""}]}'),
    ]
    raw = spark.createDataFrame(cases, "id string, title string, ord long, j string")
    return graph.build(articles, raw.withColumn("cases", F.from_json("j", CASE_SCHEMA)["cases"]))


def test_merge(spark):
    nodes, edges = built(spark)
    by = {(r["label"], r["key"]): r for r in nodes.collect()}
    assert sorted(k for k in by if k[0] in ("Case", "Person", "Crime", "Substance", "Location")) == [
        ("Case", "Vụ hai"), ("Case", "Vụ một"), ("Case", "t2"), ("Crime", "bán x"), ("Location", "Huế"), ("Person", "Lan"), ("Substance", "Cocaine"), ("Substance", "Heroine"),
    ]
    assert by["Person", "Lan"]["aliases"] == ["A2"]  # the last writer wins
    assert by["Clause", "Điều 9 BLHS khoản 1"]["doc_id"] == "law1" and by["Crime", "bán x"]["doc_id"] is None
    rels = sorted((r["src"], r["rel"], r["dst"]) for r in edges.collect())
    assert ("Vụ một", "CHARGED_WITH", "bán x") in rels and ("Điều 9 BLHS", "DEFINES", "bán x") in rels and len(rels) == 10
    assert graph.violations(nodes).isEmpty()


def test_shortest(spark):
    nodes, edges = built(spark)
    hops = graph.shortest_hops(edges, nodes.filter("doc_id = 'law1'"), nodes.filter("label = 'Case'")).collect()
    assert {r["key"]: r["hops"] for r in hops} == {"Vụ một": 2, "Vụ hai": 4}


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "question_id string, question string, doc_ids array<string>")


def test_context(spark):
    nodes, edges = built(spark)
    got = {r["question_id"]: r["facts"] for r in context(nodes, edges, ask(spark, ("q1", "Lan làm gì?", []), ("q2", "vụ 36kg", []), ("q3", "Điều 9 nói gì về Cocaine, cao nhất?", []), ("q4", "không", []))).collect()}
    assert got["q1"][0].startswith("[news2] Lan: vai trò r; mức án 8 năm; tội danh chưa rõ; vụ 'Vụ hai'") and got["q1"][1].startswith("[news1] Lan")
    assert got["q2"][0] == "[news1] Vụ việc 'Vụ một': bắt 36 kg"
    # the first clause always, the second for the shared substance
    assert [f for f in got["q2"] if "khoản" in f] == ["[Điều 9 BLHS - Tội bán x] khoản 1: 1. Người nào bán bị phạt tù 1 năm:", "[Điều 9 BLHS - Tội bán x] khoản 2: 2. Cocaine bị tù 9 năm."]
    assert len([f for f in got["q3"] if "khoản" in f]) >= 2 and got["q4"] == []
    assert context(nodes, edges, ask(spark, ("q", "Lan", [])), 0).head()["facts"] == []


def test_prompts(spark):
    row = spark.createDataFrame([("Hỏi?", ["f1"], ["c1", "c2"])], "q string, f array<string>, c array<string>")
    flat, both = row.select(agent.flat_prompt(F.col("q"), F.col("c")), agent.graph_prompt(F.col("q"), F.col("f"), F.col("c"))).head()
    assert "[1] c1\n\n[2] c2" in flat and flat.endswith("Câu hỏi: Hỏi?\nTrả lời:")
    assert "- f1" in both and "[2] c2" in both and both.endswith("Câu hỏi: Hỏi?\nTrả lời:")


def test_last_writer_wins_beyond_a_thousand_people(spark):
    people = [(f"p{k}", [], "role", "", "") for k in range(1500)] + [("p0", [], "last", "", "")]
    case = ("one", "", "", "", [], [], people)
    schema = "id string, title string, ord long, cases array<struct<name:string,summary:string,date:string,location:string,charges:array<string>,substances:array<struct<name:string,amount:string>>,people:array<struct<name:string,aliases:array<string>,role:string,charge:string,sentence:string>>>>"
    docs = spark.createDataFrame([("d", "t", 5, [case])], schema)
    _, edges = graph.case_rows(docs)
    won = graph.merge_edges(edges).filter("rel = 'INVOLVED_IN' and src = 'p0'").head()
    assert won["props"]["role"] == "last"


def test_link_cases_and_storage(spark, tmp_path):
    from tidegraph.operators import build

    law = spark.createDataFrame([("law1", LAW, {"article": "Điều 9 BLHS", "title": "Điều 9. Tội bán x", "law": "BLHS"}, 0)], "id string, content string, metadata map<string,string>, ord long")
    said = '{"cases": [{"name": "Vụ một", "charges": ["Tội Bán X", "bán x", "lừa đảo"], "people": [{"name": "Lan", "charge": "tội bán x"}, {"name": "An", "charge": "cướp"}, {"name": "Bo"}]}]}'
    news = spark.createDataFrame([("n1", "a", {"title": "t"}, 0), ("n2", "b", {"title": "u"}, 1), ("n3", None, {}, 2)], "id string, content string, metadata map<string,string>, ord long")
    llm = lambda prompt: F.when(F.contains(prompt, F.lit("Tiêu đề: u\nNội dung:\nb")), said).otherwise("broken")
    articles = parse_articles(law)
    got = build.extract(news, build.known_crimes(articles), llm).filter("id = 'n2'").head()["cases"][0]
    assert got["charges"] == ["bán x"] and [p["charge"] for p in got["people"]] == ["bán x", "", ""]
    assert [r["id"] for r in build.pinned_first(news, "n2", 2).collect()] == ["n2", "n1"]
    nodes, edges = build.build_graph(law, news, llm, limit=1, pinned="n2")
    store = build.GraphStore(spark, str(tmp_path / "g"))
    store.save(nodes, edges)
    nodes, edges = store.load()
    facts = {(r["kind"], r["name"]): r["n"] for r in build.summary(nodes, edges).collect()}
    assert facts["node", "Case"] == 1 and facts["node", "Person"] == 3 and facts["edge", "CHARGED_WITH"] == 1 and facts["shared", "Crime"] == 1
    checks = build.self_check(nodes, edges, law.select(F.col("id").alias("doc_id")), "n2", "Lan bị tội gì?", "Điều 9", ("Tội Bán X", "bán x"))
    assert {r["name"]: r["passed"] for r in checks.collect()} == dict.fromkeys(("linking", "law", "news", "path", "context"), True)
    store.reset()
    assert graph.stats(*store.load()).head().asDict() == {"nodes": 0, "relationships": 0}


def test_report(spark, tmp_path):
    from tidegraph.operators import report

    questions = spark.createDataFrame([("q1", "hop", "Hỏi?", "Lan", ["lan"])], "question_id string, type string, question string, gold string, must_include array<string>")
    flat = spark.createDataFrame([("q1", " LAN \n", 1, 10, 2, 0.5, 1.5)], "question_id string, answer string, calls int, input_tokens int, output_tokens int, usd double, seconds double")
    rows = agent.benchmark(questions, {"flat": flat, "graph": flat.select("question_id", F.lit("no").alias("answer"))}, lambda p: F.when(F.contains(p, F.lit("Câu trả lời:  LAN")), '{"score": 2}').otherwise("?"))
    assert {r["pipeline"]: (r["recall"], r["judge"], r["input_tokens"]) for r in rows.collect()} == {"flat": (1.0, 2, 10), "graph": (0.0, 0, 0)}
    lines = report.report("T", flat.withColumn("pipeline", F.lit("flat")), rows, questions)
    report.write_report(lines, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n") == [
        "T", "", "== Indexing (one-off)", "pipeline  calls    in_tok  out_tok       USD  seconds", "flat          1        10        2   0.50000      1.5", "",
        "== Querying (mean per question)", "pipeline  recall  judge   in_tok  out_tok       USD  seconds", "flat        1.00   2.00       10        2   0.50000     1.50",
        "graph       0.00   0.00        0        0   0.00000     0.00", "", "== Per question", "--- q1 [hop] flat recall=1.00 judge=2 1.50s", "LAN",
        "--- q1 [hop] graph recall=0.00 judge=0 0.00s", "no", "",
    ]


def test_hops_write_only_nodes(spark, monkeypatch):
    """Edges are not written, and those that stand twice change nothing."""
    nodes, edges = built(spark)
    written, keep = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: written.append(df.columns) or keep(df))
    hops = graph.shortest_hops(edges.unionByName(edges), nodes.filter("doc_id = 'law1'"), nodes.filter("label = 'Case'")).collect()
    assert {r["key"]: r["hops"] for r in hops} == {"Vụ một": 2, "Vụ hai": 4}
    assert len(written) == 6 and all(set(c) <= {"label", "key", "hops"} for c in written)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_at_seeds_are_chosen_before_they_are_merged(spark):
    end = lambda x: F.col("id") % x
    rows = spark.range(50).select(*graph.edge("A", end(7), "R", "B", end(5), ord=F.col("id")))
    found = spark.createDataFrame([("q", "A", "3"), ("q", "B", "4"), ("r", "B", "9")], "question_id string, label string, key string")
    got = graph.touching(graph.merge_edges(rows), F.broadcast(found))
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == sorted({(str(i % 7), str(i % 5)) for i in range(50) if i % 7 == 3 or i % 5 == 4})
    semi = graph.at_ends(graph.merge_edges(rows), F.broadcast(found.select(F.col("label").alias("src_label"), F.col("key").alias("src"))), ["src_label", "src"])
    plan = plan_of(semi)
    assert "Aggregate" in plan.split("LeftSemi")[0] and "max(struct" not in plan.split("LeftSemi")[1]
    assert plan_of(got).count("LeftSemi") == 2


def test_context_finds_seeds_once(spark, monkeypatch):
    from tidegraph.operators import context as C

    nodes, edges = built(spark)
    kept, keep = [], C.kept
    monkeypatch.setattr(C, "kept", lambda df: kept.append(df.columns) or keep(df))
    assert context(nodes, edges, ask(spark, ("q", "Lan làm gì?", []))).head()["facts"]
    assert ["question_id", "label", "key"] in kept and ["question_id", *graph.EDGE] in kept


def test_seeds_make_lower_case_before_pairs(spark):
    nodes = spark.createDataFrame([("P", "1", "LAN", "d", None), ("P", "2", "no", None, ["x", "HUẾ"]), ("P", "3", "ab", None, None), ("P", "4", None, "e", None)], "label string, key string, name string, doc_id string, aliases array<string>")
    found = graph.seeds(nodes, ask(spark, ("q", "Lan, ab và Huế?", ["e"]), ("r", "ai?", None)))
    assert sorted(map(tuple, found.collect())) == [("q", "P", "1"), ("q", "P", "2"), ("q", "P", "4")]
    assert all("lower(" not in line for line in plan_of(found).split("\n") if "Join" in line)
