"""Graph facts for questions: seeds and their edges, then the legal basis of every case reached, ranked and bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import kept
from . import graph as G

_TEXTS = "array<string>"


def context(nodes: DataFrame, edges: DataFrame, questions: DataFrame, max_facts: int = 60) -> DataFrame:
    """questions (question_id, question, doc_ids): (question_id, facts), all questions in one plan.

    Order of facts: people named in the question, last found first; case summaries; clauses that the cases lead to;
    clauses asked for directly; other people; edges at the seeds. Edges have no order of their own and go by their ends.
    """
    if max_facts <= 0:
        return questions.select("question_id", F.array().cast(_TEXTS).alias("facts"))
    low = F.lower("question")
    q = questions.withColumn("all", X.asks_all_penalties("question")).withColumn("terms", X.find_terms("question")).withColumn("amounts", X.quantities("question"))
    q = q.withColumn("articles", X.article_refs("question")).withColumn("prevention", X.asks_prevention_law("question"))
    # seeds and their edges are asked for again and again: they are found once
    found = kept(G.seeds(nodes, questions.select("question_id", "question", "doc_ids")))
    beside = kept(G.touching(edges, found))
    view = lambda label: nodes.filter(F.col("label") == label)
    rel = lambda name: edges.filter(F.col("rel") == name)

    # cases: seeds, beside a seed, or of an amount asked for; if the question names people, theirs only
    is_case = found.filter("label = 'Case'").select("question_id", F.col("key").alias("case"))
    near = beside.select("question_id", F.explode(F.array(F.struct(F.col("src_label").alias("l"), F.col("src").alias("k")), F.struct(F.col("dst_label").alias("l"), F.col("dst").alias("k")))).alias("x"))
    # an edge at a seed leads to its other end; a case at either end is a seed itself or beside one
    near = near.filter("x.l = 'Case'").select("question_id", F.col("x.k").alias("case"))
    joined = F.replace(F.lower(F.concat("name", F.lit(" "), F.coalesce(F.element_at("props", "summary"), F.lit("")))), F.lit(" "), F.lit(""))
    amounts = view("Case").crossJoin(F.broadcast(q.select("question_id", "amounts"))).filter(F.exists("amounts", lambda a: F.contains(joined, a))).select("question_id", F.col("key").alias("case"))
    cases = is_case.unionByName(near).unionByName(amounts).distinct()
    said = lambda x: (F.length(x) >= 3) & F.contains(low, F.lower(x))
    names = view("Person").crossJoin(F.broadcast(questions.select("question_id", "question")))
    names = names.filter(said(F.col("name")) | F.exists(F.coalesce("aliases", F.array().cast(_TEXTS)), said)).select("question_id", F.col("key").alias("src"))
    named = names.join(rel("INVOLVED_IN"), "src").select("question_id", F.col("dst").alias("case")).distinct()
    has_named = named.select("question_id").distinct().withColumn("named", F.lit(True))
    cases = cases.join(has_named, "question_id", "left").join(named.withColumn("own", F.lit(True)), ["question_id", "case"], "left")
    cases = cases.filter("named is null or own").select("question_id", "case")
    about = cases.join(view("Case").select(F.col("key").alias("case"), "name", "doc_id", F.element_at("props", "summary").alias("summary")), "case")
    case_facts = about.select("question_id", F.lit(1).alias("g"), F.struct(F.col("doc_id").alias("a"), F.col("name").alias("b"), F.lit(0).alias("n"), F.lit("").alias("c")).alias("o"), X.case_fact(F.col("doc_id"), F.col("name"), F.col("summary")).alias("fact"))

    # people of those cases
    people = about.select("question_id", "doc_id", F.col("name").alias("case_name"), F.col("case").alias("dst")).join(rel("INVOLVED_IN").select("src", "dst", "props"), "dst")
    people = people.join(view("Person").select(F.col("key").alias("src"), F.col("name").alias("person"), "aliases"), "src").join(F.broadcast(questions.select("question_id", "question")), "question_id")
    p = lambda k: F.element_at("props", k)
    fact = X.person_fact(F.col("doc_id"), F.col("person"), p("role"), p("sentence"), p("charge"), F.col("case_name"))
    spoken = F.exists(F.concat(F.array("person"), F.coalesce("aliases", F.array().cast(_TEXTS))), lambda n: (n != "") & F.contains(low, F.lower(n)))
    people = people.select("question_id", F.coalesce(spoken, F.lit(False)).alias("spoken"), F.struct(F.col("person").alias("a"), F.col("doc_id").alias("b"), F.lit(0).alias("n"), F.col("case_name").alias("c")).alias("o"), fact.alias("fact"))
    person_facts = people.select("question_id", F.when(F.col("spoken"), 0).otherwise(4).alias("g"), "o", "fact")

    # clauses: Case - Crime - Article - Clause, edge to edge
    clause = view("Clause").select(F.col("key").alias("clause"), F.element_at("props", "number").cast("int").alias("number"), F.element_at("props", "text").alias("text"))
    article = view("Article").select(F.col("key").alias("article"), F.element_at("props", "title").alias("title"), F.element_at("props", "law").alias("law"))
    of_article = rel("HAS_CLAUSE").select(F.col("src").alias("article"), F.col("dst").alias("clause"))
    defines = rel("DEFINES").select(F.col("src").alias("article"), F.col("dst").alias("crime"))
    mentions = rel("MENTIONS").select(F.col("src").alias("clause"), F.col("dst").alias("substance"))
    involves = rel("INVOLVES").select(F.col("src").alias("case"), F.col("dst").alias("substance"))
    shared = involves.join(mentions, "substance").select("case", "clause").distinct().withColumn("shares", F.lit(True))
    substances = involves.groupBy("case").agg(F.sort_array(F.collect_list("substance")).alias("substances"))
    chain = cases.join(rel("CHARGED_WITH").select(F.col("src").alias("case"), F.col("dst").alias("crime")), "case").join(defines, "crime").join(of_article, "article").join(clause, "clause").join(article, "article")
    chain = chain.join(shared, ["case", "clause"], "left").join(F.broadcast(q.select("question_id", "all")), "question_id").filter(F.col("all") | (F.col("number") == 1) | F.coalesce("shares", F.lit(False)))
    chain = chain.join(substances, "case", "left").select("question_id", "article", "title", "number", "text", F.coalesce("substances", F.array().cast(_TEXTS)).alias("terms"), F.lit(2).alias("g")).distinct()

    # clauses of articles that the question names, of the prevention law, or of seeds unless people are named
    seeded = found.filter("label = 'Article'").select("question_id", F.col("key").alias("article"))
    seeded = seeded.unionByName(found.filter("label = 'Clause'").select("question_id", F.col("key").alias("clause")).join(of_article, "clause").select("question_id", "article"))
    seeded = seeded.join(has_named.select("question_id"), "question_id", "left_anti")
    asked = article.crossJoin(F.broadcast(q.select("question_id", "articles", "prevention"))).filter(F.array_contains("articles", F.col("article")) | (F.col("prevention") & (F.col("law") == "Luật PCMT"))).select("question_id", "article")
    direct = seeded.unionByName(asked).distinct().join(of_article, "article").join(clause, "clause").join(article, "article")
    direct = direct.join(defines.select("article").distinct().withColumn("defines", F.lit(True)), "article", "left").join(mentions.groupBy("clause").agg(F.collect_set("substance").alias("has")), "clause", "left")
    direct = direct.join(F.broadcast(q.select("question_id", "all", "terms")), "question_id")
    wanted = F.col("all") | F.col("defines").isNull() | (F.col("number") == 1) | F.coalesce(F.arrays_overlap("has", "terms"), F.lit(False))
    direct = direct.filter(wanted).select("question_id", "article", "title", "number", "text", "terms", F.lit(3).alias("g")).distinct()
    clauses = chain.unionByName(direct)
    body = X.relevant_paragraphs("text", "title", F.col("terms"))
    clause_facts = clauses.select("question_id", "g", F.struct(F.col("article").alias("a"), F.lit("").alias("b"), "number", F.array_join("terms", ",").alias("c")).alias("o"), X.clause_fact(F.col("article"), F.col("title"), F.col("number"), body).alias("fact"))

    # edges at the seeds, no clauses among them
    lines = beside.filter("src_label != 'Clause' and dst_label != 'Clause'")
    ends = lines.select(F.col("src_label").alias("label"), F.col("src").alias("key")).unionByName(lines.select(F.col("dst_label").alias("label"), F.col("dst").alias("key")))
    shown = G.at_ends(nodes, kept(ends.distinct()), ["label", "key"]).select("label", "key", F.coalesce("name", "key").alias("shown"))
    lines = lines.join(shown.select(F.col("label").alias("src_label"), F.col("key").alias("src"), F.col("shown").alias("from")), ["src_label", "src"])
    lines = lines.join(shown.select(F.col("label").alias("dst_label"), F.col("key").alias("dst"), F.col("shown").alias("to")), ["dst_label", "dst"])
    line = X.edge_fact(F.col("src_label"), F.col("from"), F.col("rel"), F.col("props"), F.col("dst_label"), F.col("to"))
    edge_facts = lines.select("question_id", F.lit(5).alias("g"), F.struct(F.concat_ws("|", "src_label", "src").alias("a"), F.col("rel").alias("b"), F.lit(0).alias("n"), F.concat_ws("|", "dst_label", "dst").alias("c")).alias("o"), line.alias("fact"))
    edge_facts = _first(edge_facts, max_facts)

    shape = "struct<a:string,b:string,n:int,c:string>"
    parts = [x.select("question_id", "g", F.col("o").cast(shape).alias("o"), "fact") for x in (person_facts, case_facts, clause_facts, edge_facts)]
    facts = G._union(parts).groupBy("question_id", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "fact"))), lambda x: x["fact"]).alias("facts"))
    # each named person went before those found earlier
    facts = facts.withColumn("facts", F.when(F.col("g") == 0, F.reverse("facts")).otherwise(F.col("facts")))
    facts = facts.groupBy("question_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", "facts"))), lambda x: x["facts"])).alias("facts"))
    out = questions.select("question_id").join(facts, "question_id", "left")
    return out.select("question_id", X.budget(F.coalesce("facts", F.array().cast(_TEXTS)), max_facts).alias("facts"))


def _first(df: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("o"))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
