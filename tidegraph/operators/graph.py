"""The property graph as two tables, and the questions asked of it.

nodes: label, key, name, doc_id, aliases, props; key is unique within a label. edges: src_label, src, rel, dst_label, dst,
props; at most one for (src, rel, dst). What is written later replaces what was written before, property by property:
`ord` says which is later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import kept

NODE = ("label", "key", "name", "doc_id", "aliases", "props")
EDGE = ("src_label", "src", "rel", "dst_label", "dst", "props")
NO_PROPS = "map<string,string>"


def _order(ord: Column | list[Column] | None) -> Column:
    """The place of a write as numbers that are compared one after the other."""
    parts = [F.lit(0)] if ord is None else ord if isinstance(ord, list) else [ord]
    return F.array(*[p.cast("long") for p in parts])


def node(label: str, key: Column, name: Column | None = None, doc_id: Column | None = None, aliases: Column | None = None, props: Column | None = None, ord: Column | None = None) -> list[Column]:
    """Columns of a node row; without a name the key is shown."""
    null = F.lit(None).cast("string")
    return [
        F.lit(label).alias("label"), key.cast("string").alias("key"), (null if name is None else name).alias("name"), (null if doc_id is None else doc_id).alias("doc_id"),
        (F.lit(None).cast("array<string>") if aliases is None else aliases).alias("aliases"), (F.lit(None).cast(NO_PROPS) if props is None else props).alias("props"),
        _order(ord).alias("ord"),
    ]


def edge(src_label: str, src: Column, rel: str, dst_label: str, dst: Column, props: Column | None = None, ord: Column | None = None) -> list[Column]:
    return [
        F.lit(src_label).alias("src_label"), src.cast("string").alias("src"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), dst.cast("string").alias("dst"),
        (F.lit(None).cast(NO_PROPS) if props is None else props).alias("props"), _order(ord).alias("ord"),
    ]


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row a label and key. Rows without props only assert that the node is there; of the others the last wins."""
    writes = F.col("props").isNotNull() | F.col("doc_id").isNotNull() | F.col("aliases").isNotNull()
    last = F.max(F.when(writes, F.struct("ord", F.struct("doc_id", "aliases", F.to_json("props").alias("props")).alias("v")))).alias("w")
    out = rows.groupBy("label", "key").agg(F.max_by("name", "ord").alias("name"), last)
    return out.select("label", "key", "name", F.col("w.v.doc_id").alias("doc_id"), F.col("w.v.aliases").alias("aliases"), F.from_json("w.v.props", NO_PROPS).alias("props"))


def merge_edges(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("ord", F.to_json("props").alias("props"))).alias("w")
    out = rows.groupBy("src_label", "src", "rel", "dst_label", "dst").agg(last)
    return out.select("src_label", "src", "rel", "dst_label", "dst", F.from_json("w.props", NO_PROPS).alias("props"))


def law_rows(articles: DataFrame, ord: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of parsed articles (id, law, title, doc_id, crime, clauses, ord)."""
    o = F.col(ord)
    clauses = articles.select(F.col("id").alias("article"), "doc_id", o.alias("ord"), F.explode("clauses").alias("c"))
    mentions = clauses.select("ord", F.col("c.id").alias("clause"), F.explode("c.substances").alias("name"))
    crimes = articles.filter("crime is not null")
    nodes = [
        articles.select(*node("Article", F.col("id"), None, F.col("doc_id"), None, F.create_map(F.lit("title"), F.col("title"), F.lit("law"), F.col("law")), o)),
        crimes.select(*node("Crime", F.col("crime"), F.col("crime"), ord=o)),
        clauses.select(*node("Clause", F.col("c.id"), None, F.col("doc_id"), None, F.create_map(F.lit("number"), F.col("c.number").cast("string"), F.lit("penalty"), F.col("c.penalty"), F.lit("text"), F.col("c.text")), F.col("ord"))),
        mentions.select(*node("Substance", F.col("name"), F.col("name"), ord=F.col("ord"))),
    ]
    edges = [
        crimes.select(*edge("Article", F.col("id"), "DEFINES", "Crime", F.col("crime"), ord=o)),
        clauses.select(*edge("Article", F.col("article"), "HAS_CLAUSE", "Clause", F.col("c.id"), ord=F.col("ord"))),
        mentions.select(*edge("Clause", F.col("clause"), "MENTIONS", "Substance", F.col("name"), ord=F.col("ord"))),
    ]
    return _union(nodes), _union(edges)


def case_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of docs (id, title, ord, cases): cases as parsed, their charges linked. Later documents, cases and people win."""
    each = docs.select(F.col("id").alias("doc_id"), "title", "ord", F.posexplode("cases").alias("i", "c"))
    name = F.coalesce(F.nullif("c.name", F.lit("")), F.col("title"), F.col("doc_id"))
    each = each.withColumn("name", name).withColumn("k", F.lit(0))
    empty = lambda x: F.coalesce(F.col(x), F.lit(""))
    people = each.select("name", "ord", "i", F.posexplode("c.people").alias("k", "p")).filter("p.name != ''")
    substances = each.select("name", "ord", "i", F.posexplode("c.substances").alias("k", "s")).filter("s.name != ''")
    charges = each.select("name", "ord", "i", "k", F.explode("c.charges").alias("crime"))
    places = each.filter("c.location != ''")
    o = [F.col("ord"), F.col("i"), F.col("k")]
    nodes = [
        each.select(*node("Case", F.col("name"), F.col("name"), F.col("doc_id"), None, F.create_map(F.lit("summary"), empty("c.summary"), F.lit("date"), empty("c.date"), F.lit("source_title"), empty("title")), o)),
        places.select(*node("Location", F.col("c.location"), F.col("c.location"), ord=o)),
        charges.select(*node("Crime", F.col("crime"), F.col("crime"), ord=o)),
        substances.select(*node("Substance", F.col("s.name"), F.col("s.name"), ord=o)),
        people.select(*node("Person", F.col("p.name"), F.col("p.name"), None, F.coalesce("p.aliases", F.array().cast("array<string>")), None, o)),
    ]
    edges = [
        places.select(*edge("Case", F.col("name"), "LOCATED_IN", "Location", F.col("c.location"), ord=o)),
        charges.select(*edge("Case", F.col("name"), "CHARGED_WITH", "Crime", F.col("crime"), ord=o)),
        substances.select(*edge("Case", F.col("name"), "INVOLVES", "Substance", F.col("s.name"), F.create_map(F.lit("amount"), F.col("s.amount")), o)),
        people.select(*edge("Person", F.col("p.name"), "INVOLVED_IN", "Case", F.col("name"), F.create_map(F.lit("role"), F.col("p.role"), F.lit("charge"), F.col("p.charge"), F.lit("sentence"), F.col("p.sentence")), o)),
    ]
    return _union(nodes), _union(edges)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(articles: DataFrame, cases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of both corpora; law first, so cases win where both write."""
    nodes, edges = law_rows(articles)
    if cases is not None:
        more = case_rows(cases)
        after = lambda rows, k: rows.withColumn("ord", F.concat(F.array(F.lit(k).cast("long")), "ord"))
        nodes, edges = (after(x, 0).unionByName(after(y, 1)) for x, y in zip((nodes, edges), more))
    return merge_nodes(nodes), merge_edges(edges)


def violations(rows: DataFrame) -> DataFrame:
    """Keys that more than one row of a label has."""
    return rows.groupBy("label", "key").agg(F.count("*").alias("n")).filter("n > 1")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("relationships")))  # one row each


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def seeds(nodes: DataFrame, questions: DataFrame, least: int = 3) -> DataFrame:
    """(question_id, label, key): nodes of the question's documents, or whose name or an alias the question holds.

    questions (question_id, question, doc_ids) are a stated set; each meets all nodes once.
    """
    # lower case is made once a name and once a question, not once a pair
    long = lambda x: F.length(x) >= least
    asked = questions.select("question_id", F.lower("question").alias("_asked"), "doc_ids")
    named = nodes.select("label", "key", "doc_id", F.when(long(F.col("name")), F.lower("name")).alias("_name"), F.transform(F.filter("aliases", long), F.lower).alias("_aliases"))
    inside = lambda x: F.contains("_asked", x)
    hit = F.coalesce(F.array_contains("doc_ids", F.col("doc_id")), F.lit(False)) | F.coalesce(inside(F.col("_name")), F.lit(False)) | F.coalesce(F.exists("_aliases", inside), F.lit(False))
    return named.crossJoin(F.broadcast(asked)).filter(hit).select("question_id", "label", "key")


def touching(edges: DataFrame, found: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """(question_id, edge): edges that begin or end at a seed, each once for a question."""
    kept = edges.filter(~F.col("src_label").isin(*skip) & ~F.col("dst_label").isin(*skip)) if skip else edges
    sides = []
    for ends in (["src_label", "src"], ["dst_label", "dst"]):
        at = found.select("question_id", F.col("label").alias(ends[0]), F.col("key").alias(ends[1]))
        sides.append(at.join(at_ends(kept, at, ends), ends).select("question_id", *EDGE))
    return sides[0].unionByName(sides[1]).dropDuplicates(["question_id", "src_label", "src", "rel", "dst_label", "dst"])


def at_ends(rows: DataFrame, some: DataFrame, ends: Sequence[str]) -> DataFrame:
    """Rows whose `ends` are among those of some. Few of these go below the merge that made the rows, which then merges only what is asked for."""
    return rows.join(some.select(*ends).distinct(), list(ends), "left_semi")


def first_edges(found: DataFrame, limit: int = 60) -> DataFrame:
    """Of `touching` edges the first `limit` of each question, by their ends."""
    w = Window.partitionBy("question_id").orderBy("src_label", "src", "rel", "dst_label", "dst")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def shortest_hops(edges: DataFrame, start: DataFrame, goal: DataFrame, most: int = 4) -> DataFrame:
    """(label, key, hops): goal nodes within `most` undirected edges of any start node, with the least number of them.

    Edges may stand more than once. They are read where they lie, each hop only those at a label that it starts from; the last
    hop only those that end at a label of the goal. What is written is the nodes that a hop reached first.
    """
    both = edges.select(F.col("src_label").alias("al"), F.col("src").alias("a"), F.col("dst_label").alias("bl"), F.col("dst").alias("b"))
    both = both.unionByName(both.select(F.col("bl").alias("al"), F.col("b").alias("a"), F.col("al").alias("bl"), F.col("a").alias("b")))
    goal = kept(goal.select("label", "key").distinct())
    labels = lambda df: [r["label"] for r in df.select("label").distinct().collect()]  # noqa: E731 a row a label
    wanted = labels(goal)
    seen = kept(start.select("label", "key").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, most + 1):
        near = both.filter(F.col("al").isin(labels(front)))
        near = near.filter(F.col("bl").isin(wanted)) if hop == most else near
        step = front.select(F.col("label").alias("al"), F.col("key").alias("a")).join(near, ["al", "a"]).select(F.col("bl").alias("label"), F.col("b").alias("key")).distinct()
        front = kept(step.join(seen, ["label", "key"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.join(goal, ["label", "key"]).groupBy("label", "key").agg(F.min("hops").alias("hops"))
