"""The graph from documents: extraction, limits, storage, and checks that what was built answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph
from .context import context
from .lawparse import known_crimes, news_prompt, parse_articles, parse_cases
from .linking import link, link_cases

NODE_SCHEMA = "label string, key string, name string, doc_id string, aliases array<string>, props map<string,string>"
EDGE_SCHEMA = "src_label string, src string, rel string, dst_label string, dst string, props map<string,string>"


class GraphStore:
    """Nodes and edges as tables in one folder that all executors see. A save replaces both."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        for df, name, schema in ((nodes, "nodes", NODE_SCHEMA), (edges, "edges", EDGE_SCHEMA)):
            df.select(*T.StructType.fromDDL(schema).names).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def load(self) -> tuple[DataFrame, DataFrame]:
        return tuple(self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") for name, schema in (("nodes", NODE_SCHEMA), ("edges", EDGE_SCHEMA)))

    def reset(self) -> None:
        """An empty graph."""
        self.save(self.spark.createDataFrame([], NODE_SCHEMA), self.spark.createDataFrame([], EDGE_SCHEMA))


def pinned_first(docs: DataFrame, pinned: str, limit: int, id: str = "id", order: str = "ord") -> DataFrame:
    """The first `limit` documents by `order`, the pinned one before all others."""
    return docs.orderBy(F.col(id) != pinned, order).limit(limit)


def extract(news: DataFrame, crimes: DataFrame, llm_fn: Callable[[Column], Column]) -> DataFrame:
    """news (id, content, metadata, ord) and `cases`, as the model names them, with charges linked to crimes (name, ord)."""
    answered = news_prompt(news, crimes).withColumn("answer", llm_fn(F.col("prompt"))).drop("prompt")
    return link_cases(parse_cases(answered), crimes)


def build_graph(law: DataFrame, news: DataFrame, llm_fn: Callable[[Column], Column], limit: int | None = None, pinned: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of law and news documents (id, content, metadata, ord); with a limit, of the first news only, the pinned one among them."""
    articles = parse_articles(law).join(law.select(F.col("id").alias("doc_id"), "ord"), "doc_id")
    some = pinned_first(news, pinned, limit) if limit else news
    cases = extract(some, known_crimes(articles), llm_fn).withColumn("title", F.coalesce(F.element_at("metadata", "title"), F.lit("")))
    return graph.build(articles, cases)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals, nodes by label, edges by type, and labels that have nodes without a document."""
    total = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(kind).alias("name"), "n")
    by = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    parts = [total(nodes, "nodes"), total(edges, "relationships"), by(nodes, "node", "label"), by(edges, "edge", "rel"), by(nodes.filter("doc_id is null"), "shared", "label")]
    return graph._union(parts)


def self_check(nodes: DataFrame, edges: DataFrame, law_ids: DataFrame, news_id: str, question: str, expected: str, spelling: tuple[str, str], most: int = 4) -> DataFrame:
    """(name, passed): whether a variant spelling links and a strange name does not, both corpora have nodes, a path of at most
    `most` edges joins them, and the question's facts hold what is expected. law_ids: (doc_id); spelling: (variant, name)."""
    spark = nodes.sparkSession
    known = spark.createDataFrame([(0, spelling[1])], "ord long, name string")
    tried = link(spark.createDataFrame([(spelling[0],), ("lừa đảo chiếm đoạt tài sản",)], "mention string"), known)
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias("passed")
    row = lambda df, name: df.select(F.lit(name).alias("name"), "passed")
    asked = spark.createDataFrame([("q", question, [news_id])], "question_id string, question string, doc_ids array<string>")
    ours = nodes.join(law_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    theirs = nodes.filter(F.col("doc_id") == news_id)
    linked = tried.agg(F.bool_and(F.when(F.col("mention") == spelling[0], F.col("linked").eqNullSafe(F.lit(spelling[1]))).otherwise(F.col("linked").isNull())).alias("passed"))
    parts = [
        row(linked, "linking"), row(ours.agg((F.count("*") > 0).alias("passed")), "law"), row(theirs.agg((F.count("*") > 0).alias("passed")), "news"),
        row(graph.shortest_hops(edges, ours, theirs, most).agg((F.count("*") > 0).alias("passed")), "path"),
        row(context(nodes, edges, asked).agg(yes(F.exists("facts", lambda f: F.contains(f, F.lit(expected))))), "context"),
    ]
    return graph._union(parts)
