"""The star schema as a property graph: demand and supply are two corpora, and parts, nations and brands join them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    doc = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    part = t("part")
    return G._union([
        t("customer").select(*G.node("Customer", F.col("c_custkey"), F.col("c_name"), doc("demand", "c_custkey"))),
        t("orders").select(*G.node("Order", F.col("o_orderkey"), None, doc("demand", "o_custkey"))),
        t("supplier").select(*G.node("Supplier", F.col("s_suppkey"), F.col("s_name"), doc("supply", "s_suppkey"))),
        part.select(*G.node("Part", F.col("p_partkey"), F.col("p_name"))),
        part.select(*G.node("Brand", F.col("p_brand"), F.col("p_brand"))),
        t("nation").select(*G.node("Nation", F.col("n_nationkey"), F.col("n_name"))),
        t("region").select(*G.node("Region", F.col("r_regionkey"), F.col("r_name"))),
    ])


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem")
    return G._union([
        t("orders").select(*G.edge("Customer", F.col("o_custkey"), "PLACED", "Order", F.col("o_orderkey"), F.create_map(F.lit("status"), F.col("o_orderstatus")))),
        lines.select(*G.edge("Order", F.col("l_orderkey"), "CONTAINS", "Part", F.col("l_partkey"), F.create_map(F.lit("qty"), F.col("l_quantity").cast("long").cast("string")), F.col("l_linenumber"))),
        lines.select(*G.edge("Supplier", F.col("l_suppkey"), "SUPPLIES", "Part", F.col("l_partkey"))),
        t("customer").select(*G.edge("Customer", F.col("c_custkey"), "FROM", "Nation", F.col("c_nationkey"))),
        t("supplier").select(*G.edge("Supplier", F.col("s_suppkey"), "BASED_IN", "Nation", F.col("s_nationkey"))),
        t("nation").select(*G.edge("Nation", F.col("n_nationkey"), "IN", "Region", F.col("n_regionkey"))),
        t("part").select(*G.edge("Part", F.col("p_partkey"), "OF_BRAND", "Brand", F.col("p_brand"))),
    ])


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return G.merge_nodes(node_rows(spark, sf_dir)), G.merge_edges(edge_rows(spark, sf_dir))


_TABLES = """
nodes as (
  select 'Customer' as label, c_custkey::varchar as key, c_name as name, 'demand:' || c_custkey as doc_id from customer
  union all select 'Order', o_orderkey::varchar, null, 'demand:' || o_custkey from orders
  union all select 'Supplier', s_suppkey::varchar, s_name, 'supply:' || s_suppkey from supplier
  union all select 'Part', p_partkey::varchar, p_name, null from part
  union all select distinct 'Brand', p_brand, p_brand, null from part
  union all select 'Nation', n_nationkey::varchar, n_name, null from nation
  union all select 'Region', r_regionkey::varchar, r_name, null from region),
edges as (
  select 'Customer' as src_label, o_custkey::varchar as src, 'PLACED' as rel, 'Order' as dst_label, o_orderkey::varchar as dst from orders
  union all select distinct 'Order', l_orderkey::varchar, 'CONTAINS', 'Part', l_partkey::varchar from lineitem
  union all select distinct 'Supplier', l_suppkey::varchar, 'SUPPLIES', 'Part', l_partkey::varchar from lineitem
  union all select 'Customer', c_custkey::varchar, 'FROM', 'Nation', c_nationkey::varchar from customer
  union all select 'Supplier', s_suppkey::varchar, 'BASED_IN', 'Nation', s_nationkey::varchar from supplier
  union all select 'Nation', n_nationkey::varchar, 'IN', 'Region', n_regionkey::varchar from nation
  union all select distinct 'Part', p_partkey::varchar, 'OF_BRAND', 'Brand', p_brand from part)"""
SQL, SQL_RECURSIVE = "with" + _TABLES, "with recursive" + _TABLES
