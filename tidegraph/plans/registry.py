"""Every query of the engine by name, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import agent, build, chunking, graph, lawparse, linking, metering, report, vectors
from ..operators.context import context
from ..operators.lawparse import parse_cases
from ..sources import documents, html
from . import star
from .tables import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- chunking

@_query("chunk_fixed", """
with n as (select doc_id, text, greatest(ceil((length(text) - 500) / 450.0), 0)::bigint as last from documents where length(text) > 0)
select doc_id, i::integer as chunk_idx, substring(text, (i * 450 + 1)::bigint, 500) as chunk
from (select doc_id, text, unnest(range(0, last + 1)) as i from n)""")
def chunk_fixed(spark, d):
    return chunking.rows(_t(spark, d, "documents"), chunking.FixedSizeChunker())


_SENTENCES = r"""
s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, E' \t\n\r\f\v'), '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)),
      lambda x: trim(x, E' \t\n\r\f\v')), lambda x: x <> '') as p from documents)"""


@_query("chunk_sentence", f"""
with {_SENTENCES}
select doc_id, i::integer as chunk_idx, array_to_string(p[i * 3 + 1:i * 3 + 3], ' ') as chunk
from (select doc_id, p, unnest(range(0, (len(p) + 2) // 3)) as i from s)""")
def chunk_sentence(spark, d):
    return chunking.rows(_t(spark, d, "documents"), chunking.SentenceChunker())


@_query("chunk_recursive")
def chunk_recursive(spark, d):
    return chunking.rows(_t(spark, d, "documents"), chunking.RecursiveChunker(chunk_size=800))


def _docs(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))


@_query("corpus_chunks")
def corpus_chunks(spark, d):
    return chunking.chunk_docs(_docs(spark, d), 800).select("id", "doc_id", F.element_at("metadata", "source").alias("source"), "content")


def _recursive_sql(size: int) -> str:
    """SQL of {n, t, h}: number and characters of a text's recursive chunks; h is what is held while pieces are merged."""
    state = lambda n, t, h: f"{{'n': {n}, 't': {t}, 'h': {h}}}"
    solid = lambda x: rf"regexp_matches({x}, '[^\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')"
    flushed = lambda a: f"case when {solid(f'{a}.h')} then {state(f'{a}.n + 1', f'{a}.t + length({a}.h)', repr(''))} else {state(f'{a}.n', f'{a}.t', repr(''))} end"
    none = state("0::bigint", "0::bigint", "''")

    def cut(x: str, k: int) -> str:
        if k == 4:
            pieces = f"list_filter(list_transform(range(0, length({x}), {size}), lambda i: substring({x}, i + 1, {size})), lambda w: {solid('w')})"
            return state(f"len({pieces})::bigint", f"coalesce(list_sum(list_transform({pieces}, lambda w: length(w))), 0)::bigint", "''")
        sep, a, piece = ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")[k], f"a{k}", f"x{k}.h"
        joined, f = f"case when {a}.h = '' then {piece} else {a}.h || {sep} || {piece} end", flushed(a)
        longer = f"list_transform([{cut(piece, k + 1)}], lambda c{k}: {state(f'({f}).n + c{k}.n', f'({f}).t + c{k}.t', repr(''))})[1]"
        step = f"case when length({joined}) <= {size} then {state(f'{a}.n', f'{a}.t', joined)} when length({piece}) <= {size} then {state(f'({f}).n', f'({f}).t', piece)} else {longer} end"
        pieces = f"list_concat([{none}], list_transform(string_split({x}, {sep}), lambda s{k}: {state('0::bigint', '0::bigint', f's{k}')}))"
        return f"list_transform([list_reduce({pieces}, lambda {a}, x{k}: {step})], lambda e{k}: {flushed(f'e{k}')})[1]"

    short = f"case when {solid('text')} then {state('1::bigint', 'length(text)::bigint', repr(''))} else {none} end"
    return f"case when length(text) <= {size} then {short} when length(text) > {size} then {cut('text', 0)} else {none} end"


@_query("chunk_compare", f"""
with {_SENTENCES},
f as (select doc_id, length(text) as n, greatest(ceil((length(text) - 200) / 200.0), 0)::bigint + 1 as k from documents where length(text) > 0),
b as (select doc_id, (len(p) + 2) // 3 as k, (list_sum(list_transform(p, lambda x: length(x))) + len(p) - (len(p) + 2) // 3) as n from s),
c as (select doc_id, {_recursive_sql(200)} as r from documents)
select doc_id, 'fixed_size' as strategy, k::bigint as n_chunks, round(n / k, 6) as avg_length from f
union all select doc_id, 'by_sentences', k::bigint, round(coalesce(n / nullif(k, 0), 0), 6) from b
union all select doc_id, 'recursive', r.n, round(coalesce(r.t / nullif(r.n, 0), 0), 6) from c""")
def chunk_compare(spark, d):
    out = chunking.ChunkingStrategyComparator().compare(_t(spark, d, "documents"))
    return out.select("doc_id", "strategy", "n_chunks", F.round("avg_length", 6).alias("avg_length"))


@_query("chunk_compare_all")
def chunk_compare_all(spark, d):
    return chunking.ChunkingStrategyComparator().compare(_t(spark, d, "documents")).drop("chunks")


# ---- embeddings and search

_MOCK = """list_reduce(list_concat([('0x' || right(md5(text), 8))::bigint::double], range(0, 64)::double[]),
  lambda a, x: ((a::bigint * 1664525 + 1013904223) % 4294967296)::double)"""


@_query("mock_embedding", """
with recursive g as (
  select doc_id, 0 as i, ('0x' || right(md5(text), 8))::bigint as s from documents
  union all select doc_id, i + 1, (s * 1664525 + 1013904223) % 4294967296 from g where i < 64),
v as (select doc_id, i, s / 4294967295.0::double * 2 - 1 as v from g where i > 0),
n as (select doc_id, sqrt(sum(v * v)) as n from v group by doc_id)
select doc_id, (i - 1)::integer as dim, round(v / n, 6) as value from v join n using (doc_id)""")
def mock_embedding(spark, d):
    out = _t(spark, d, "documents").select("doc_id", F.posexplode(vectors.MockEmbedder()("text")).alias("dim", "value"))
    return out.select("doc_id", "dim", F.round("value", 6).alias("value"))


def _vectors(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


_VEC = "v as (select vec_id, embedding::double[] as e, label from embeddings)"


@_query("vector_dot_topk", f"""
with {_VEC} select b.vec_id as vec_id, round(list_dot_product(a.e, b.e), 6) as score
from v a, v b where a.vec_id = 0 order by list_dot_product(a.e, b.e) desc, b.vec_id limit 10""")
def vector_dot_topk(spark, d):
    items = _vectors(spark, d)
    query = items.filter("seq = 0").select("embedding").head()[0]  # one vector
    return vectors.top_k(items, F.array(*map(F.lit, query)), 10).select(F.col("seq").alias("vec_id"), F.round("score", 6).alias("score"))


@_query("vector_cosine", f"""
with {_VEC} select b.vec_id as vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as similarity
from v a, v b where a.vec_id = 0""")
def vector_cosine(spark, d):
    items = _vectors(spark, d)
    query = items.filter("seq = 0").select("embedding").head()[0]
    return items.select(F.col("seq").alias("vec_id"), F.round(vectors.cosine("embedding", F.array(*map(F.lit, query))), 6).alias("similarity"))


@_query("vector_topk_batch", f"""
with {_VEC} select a.vec_id as query_id, b.vec_id as vec_id, row_number() over (partition by a.vec_id order by list_dot_product(a.e, b.e) desc, b.vec_id)::integer as rank
from v a, v b where a.vec_id % 50 = 0 qualify rank <= 5""")
def vector_topk_batch(spark, d):
    items = _vectors(spark, d)
    asked = items.filter("seq % 50 = 0").select(F.col("seq").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.top_k_batch(items.drop("label"), asked, 5).select("query_id", F.col("seq").alias("vec_id"), "rank")


@_query("vector_filtered_topk", f"""
with {_VEC} select b.vec_id as vec_id, b.label as label, round(list_dot_product(a.e, b.e), 6) as score
from v a, v b where a.vec_id = 0 and b.label = 3 order by list_dot_product(a.e, b.e) desc, b.vec_id limit 10""")
def vector_filtered_topk(spark, d):
    items = _vectors(spark, d)
    query = items.filter("seq = 0").select("embedding").head()[0]
    found = vectors.top_k(items.filter(F.col("label").eqNullSafe(F.lit(3))), F.array(*map(F.lit, query)), 10)
    return found.select(F.col("seq").alias("vec_id"), "label", F.round("score", 6).alias("score"))


def _filled(spark, d) -> vectors.EmbeddingStore:
    store = vectors.EmbeddingStore(spark)
    meta = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: v.isNotNull())
    store.add_documents(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), meta.alias("metadata"), "doc_id"), order="doc_id")
    return store


@_query("store_delete", "select doc_id, (row_number() over (order by doc_id))::bigint as seq from documents qualify doc_id not in (5, 7)")
def store_delete(spark, d):
    """What a store of all documents holds after two were deleted and one that is not there was asked for; numbers stay."""
    store = _filled(spark, d)
    found = [store.delete_document(x) for x in ("5", "7", "none")]
    if found != [True, True, False]:
        raise ValueError(found)
    return store.records.select(F.element_at("metadata", "doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"))


@_query("store_size", "select 'before' as at, count(*)::bigint as n from documents union all select 'after', count(*) filter (doc_id <> 5) from documents")
def store_size(spark, d):
    store = _filled(spark, d)
    before = store.get_collection_size()
    store.delete_document("5")
    return spark.createDataFrame([("before", before), ("after", store.get_collection_size())], "at string, n long")


# ---- text functions

@_query("normalize_name", r"""
select p_partkey, trim(regexp_replace(regexp_replace(lower('  "Tội  ' || p_name || '" '), '^\s*"|"\s*$', '', 'g'), '\s+', ' ', 'g')[5:]) as form from part""")
def normalize_name(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.normalize_name(F.concat(F.lit('  "Tội  '), F.col("p_name"), F.lit('" '))).alias("form"))


_TERMS = ("the", "Tion", "PARA", "les", "und")


@_query("find_terms", f"""
select doc_id, term from (select doc_id, lower(text) as t, unnest([{', '.join(repr(t) for t in _TERMS)}]) as term from documents) where contains(t, lower(term))""")
def find_terms(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(X.find_terms("text", _TERMS)).alias("term"))


@_query("quantity_extract", r"""
with q as (select o_orderkey, 'bắt ' || replace(round(o_totalprice, 1)::varchar, '.', ',') || ' KG và ' || (o_orderkey % 97)::varchar || 'gam' as t from orders)
select o_orderkey, unnest(list_transform(regexp_extract_all(t, '(?i)\d+(?:[.,]\d+)?\s*(?:kg|gam)\b'), lambda x: replace(lower(regexp_replace(x, '\s+', '', 'g')), ',', '.'))) as amount from q""")
def quantity_extract(spark, d):
    price = F.replace(F.round("o_totalprice", 1).cast("decimal(18,1)").cast("string"), F.lit("."), F.lit(","))
    said = F.concat(F.lit("bắt "), price, F.lit(" KG và "), (F.col("o_orderkey") % 97).cast("string"), F.lit("gam"))
    return _t(spark, d, "orders").select("o_orderkey", F.explode(X.quantities(said)).alias("amount"))


@_query("article_refs", "select o_orderkey, 'Điều ' || (o_orderkey % 300)::varchar || ' BLHS' as article from orders union all select o_orderkey, 'Điều ' || (o_orderkey % 7)::varchar || ' BLHS' from orders")
def article_refs(spark, d):
    said = F.concat(F.lit("theo Điều "), (F.col("o_orderkey") % 300).cast("string"), F.lit(" và điều  "), (F.col("o_orderkey") % 7).cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", F.explode(X.article_refs(said)).alias("article"))


@_query("slugify_url", "select page_id, coalesce(nullif(trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'document') as slug from pages")
def slugify_url(spark, d):
    return _t(spark, d, "pages").select("page_id", X.slugify("url").alias("slug"))


@_query("intent_flags", "select doc_id, contains(lower(text), 'tối đa') or contains(lower(text), 'cao nhất') as all_penalties, contains(lower(text), 'luật phòng') and contains(lower(text), 'chống ma túy') as prevention from documents")
def intent_flags(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.asks_all_penalties("text").alias("all_penalties"), X.asks_prevention_law("text").alias("prevention"))


@_query("link_entity_exact", "select p_partkey, p_name as linked from part")
def link_entity_exact(spark, d):
    parts = _t(spark, d, "part").select("p_partkey", "p_name")
    names = parts.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    said = parts.select("p_partkey", F.concat(F.lit(" Tội "), F.upper("p_name")).alias("mention"))
    return linking.link(said, names, fuzzy=False).select("p_partkey", "linked")


@_query("link_entity_fuzzy")
def link_entity_fuzzy(spark, d):
    """Misspelt brands against the brands."""
    parts = _t(spark, d, "part")
    names = parts.select(F.col("p_brand").alias("name")).distinct().withColumn("ord", F.xxhash64("name"))
    said = parts.select("p_partkey", F.concat(F.lower("p_brand"), F.lit("x")).alias("mention"))
    return linking.link(said, names).select("p_partkey", "mention", "linked")


_LAW = "'lời dẫn' || chr(10) || '1. Người nào mua bán [3] bị phạt tù từ ' || (o_orderkey % 9 + 1) || ' năm: a' || chr(10) || '2. Cocaine ' || o_orderkey || chr(10) || 'bị cảnh cáo.'"


def _law(spark, d) -> DataFrame:
    text = F.expr("concat('lời dẫn\\n1. Người nào mua bán [3] bị phạt tù từ ', o_orderkey % 9 + 1, ' năm: a\\n2. Cocaine ', o_orderkey, '\\nbị cảnh cáo.')")
    return _t(spark, d, "orders").select("o_orderkey", text.alias("body"))


@_query("segment_clauses", """
select o_orderkey, 1 as number, '1. Người nào mua bán  bị phạt tù từ ' || (o_orderkey % 9 + 1) || ' năm: a' as clause from orders
union all select o_orderkey, 2, '2. Cocaine ' || o_orderkey || chr(10) || 'bị cảnh cáo.' from orders""")
def segment_clauses(spark, d):
    out = _law(spark, d).select("o_orderkey", F.explode(X.segment_clauses(X.drop_footnotes("body"))).alias("clause"))
    return out.select("o_orderkey", X.clause_number(F.col("clause")).alias("number"), "clause")


@_query("penalty_extract", """
select o_orderkey, 1 as number, 'phạt tù từ ' || (o_orderkey % 9 + 1) || ' năm' as penalty from orders union all select o_orderkey, 2, '' from orders""")
def penalty_extract(spark, d):
    out = _law(spark, d).select("o_orderkey", F.explode(X.segment_clauses("body")).alias("clause"))
    return out.select("o_orderkey", X.clause_number(F.col("clause")).alias("number"), X.penalty("clause").alias("penalty"))


@_query("paragraph_select", """
select c_custkey, 'đầu ' || c_custkey || case when c_custkey % 2 = 0 then chr(10) || 'có Heroine' else '' end as body from customer""")
def paragraph_select(spark, d):
    text = F.expr("concat('đầu ', c_custkey, '\\n \\n', if(c_custkey % 2 = 0, 'có Heroine', 'không'), '\\n\\nhết')")
    return _t(spark, d, "customer").select("c_custkey", X.relevant_paragraphs(text, F.lit("Tội x"), F.array(F.lit("heroine"))).alias("body"))


@_query("json_cases", """
select event_id, 'case ' || user_id as name, json_extract_string(props, '$.k') as amount from events where event_id % 3 <> 0""")
def json_cases(spark, d):
    """Two of three answers hold a case, the third is broken."""
    answer = F.when(F.col("event_id") % 3 == 0, "{oops").otherwise(F.concat(F.lit('```json\n{"cases": [{"name": "case '), F.col("user_id").cast("string"), F.lit('", "substances": [{"name": "x", "amount": "'), F.get_json_object("props", "$.k"), F.lit('"}]}]}\n```')))
    out = parse_cases(_t(spark, d, "events").select("event_id", answer.alias("answer")))
    return out.select("event_id", F.explode("cases").alias("c")).select("event_id", "c.name", F.col("c.substances")[0]["amount"].alias("amount"))


# ---- graph over the star schema

@_query("graph_merge_nodes", f"{star.SQL} select label, key, name, doc_id from nodes")
def graph_merge_nodes(spark, d):
    return graph.merge_nodes(star.node_rows(spark, d)).select("label", "key", "name", "doc_id")


@_query("graph_merge_edges", f"{star.SQL} select src_label, src, rel, dst_label, dst from edges")
def graph_merge_edges(spark, d):
    return graph.merge_edges(star.edge_rows(spark, d)).select("src_label", "src", "rel", "dst_label", "dst")


@_query("graph_last_writer", """
select l_orderkey::varchar as src, l_partkey::varchar as dst, floor(l_quantity)::bigint::varchar as qty from lineitem
qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber desc, '{"qty":"' || floor(l_quantity)::bigint || '"}' desc) = 1""")
def graph_last_writer(spark, d):
    rows = star.edge_rows(spark, d).filter("rel = 'CONTAINS'")
    return graph.merge_edges(rows).select("src", "dst", F.element_at("props", "qty").alias("qty"))


@_query("graph_constraint_violations", "select 'Line' as label, l_orderkey::varchar as key, count(*)::bigint as n from lineitem group by l_orderkey having count(*) > 1")
def graph_constraint_violations(spark, d):
    return graph.violations(_t(spark, d, "lineitem").select(F.lit("Line").alias("label"), F.col("l_orderkey").cast("string").alias("key")))


@_query("graph_stats", f"{star.SQL} select (select count(*) from nodes)::bigint as nodes, (select count(*) from edges)::bigint as relationships")
def graph_stats(spark, d):
    return graph.stats(*star.build(spark, d))


@_query("nodes_by_label", f"{star.SQL} select label, count(*)::bigint as n from nodes group by label")
def nodes_by_label(spark, d):
    return graph.counts(star.build(spark, d)[0], "label")


@_query("edges_by_type", f"{star.SQL} select rel, count(*)::bigint as n from edges group by rel")
def edges_by_type(spark, d):
    return graph.counts(star.build(spark, d)[1], "rel")


@_query("nodes_per_doc", f"{star.SQL} select doc_id, count(*)::bigint as n from nodes where doc_id is not null group by doc_id")
def nodes_per_doc(spark, d):
    return graph.counts(star.build(spark, d)[0], "doc_id")


@_query("labels_without_doc", f"{star.SQL} select distinct label from nodes where doc_id is null")
def labels_without_doc(spark, d):
    return star.build(spark, d)[0].filter("doc_id is null").select("label").distinct()


@_query("entity_duplicates", "select lower(text) as form, count(*)::bigint as n, min(doc_id)::bigint as first_id from documents group by lower(text) having count(*) > 1")
def entity_duplicates(spark, d):
    return _t(spark, d, "documents").groupBy(F.lower("text").alias("form")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@_query("count_distinct_cases", "select p_brand, count(distinct l_orderkey)::bigint as n from lineitem join part on l_partkey = p_partkey group by p_brand")
def count_distinct_cases(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_brand")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("n"))


@_query("bridge_path", """
select c_nationkey, s_nationkey, count(*)::bigint as n from customer join orders on c_custkey = o_custkey join (select distinct l_orderkey, l_partkey from lineitem) a on o_orderkey = a.l_orderkey
join (select distinct l_partkey, l_suppkey from lineitem) b using (l_partkey) join supplier on s_suppkey = l_suppkey group by all""")
def bridge_path(spark, d):
    """Customer - Order - Part - Supplier, edge to edge; the part itself is not read."""
    lines = _t(spark, d, "lineitem")
    customer, supplier = _t(spark, d, "customer"), _t(spark, d, "supplier")
    placed = _t(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    bought = lines.select("l_orderkey", "l_partkey").distinct().join(placed, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey", "c_nationkey").agg(F.count("*").alias("b"))
    sold = lines.select("l_partkey", "l_suppkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey", "s_nationkey").agg(F.count("*").alias("s"))
    # counts meet, not rows: a part's paths are the product of its two sides
    return bought.join(sold, "l_partkey").groupBy("c_nationkey", "s_nationkey").agg(F.sum(F.col("b") * F.col("s")).alias("n"))


@_query("clause_filter", """
select l_orderkey, l_linenumber from lineitem l where l_linenumber = 1 or exists (select 1 from part where p_partkey = l_partkey and p_size = 1)""")
def clause_filter(spark, d):
    small = _t(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit"))
    out = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(small, "l_partkey", "left")
    return out.filter((F.col("l_linenumber") == 1) | F.coalesce("hit", F.lit(False))).select("l_orderkey", "l_linenumber")


@_query("case_semi", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def case_semi(spark, d):
    lines = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


@_query("unlinked_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def unlinked_anti(spark, d):
    pending = _t(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").select("c_custkey").join(pending, "c_custkey", "left_anti")


@_query("optional_match", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus in ('O', 'P')")
def optional_match(spark, d):
    orders = _t(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return _t(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", "o_orderkey")


@_query("pattern_collect", """
select o_orderkey, coalesce(string_agg(p_brand, ',' order by p_brand), '') as brands from orders left join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey group by o_orderkey""")
def pattern_collect(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    brands = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.sort_array(F.collect_list("p_brand")), ",").alias("brands"))
    return _t(spark, d, "orders").select("o_orderkey").join(brands, "o_orderkey", "left").select("o_orderkey", F.coalesce("brands", F.lit("")).alias("brands"))


@_query("shortest_path_hops", f"""
{star.SQL_RECURSIVE}, und as materialized (select src_label al, src a, dst_label bl, dst b from edges union all select dst_label, dst, src_label, src from edges),
h(label, key, hops) as (select 'Region', '0', 0 union select bl, b, hops + 1 from h join und on al = label and a = key where hops < 4)
select label, key, min(hops)::integer as hops from h where label in ('Customer', 'Supplier') group by all""")
def shortest_path_hops(spark, d):
    """From one region to customers and suppliers."""
    nodes = graph.merge_nodes(star.node_rows(spark, d))
    # paths are the same over rows of edges that are not merged
    return graph.shortest_hops(star.edge_rows(spark, d), nodes.filter("label = 'Region' and key = '0'"), nodes.filter(F.col("label").isin("Customer", "Supplier")))


@_query("text_containment_join", "select doc_id, item_id from documents join benchmark b on contains(lower(documents.text), lower(b.text)) and length(b.text) >= 3")
def text_containment_join(spark, d):
    return contains_join(_t(spark, d, "documents").select("doc_id", "text"), _t(spark, d, "benchmark").filter(F.length("text") >= 3))


def contains_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of docs (doc_id, text) and items (item_id, text) whose text they contain, letters of either case.

    A word inside an item, with white space on both sides, is a word of each text that contains the item; the longest such
    word of an item meets the texts' words, and what meets is verified. Only items of less than three words meet all texts.
    """
    low = F.lower("text")
    items = items.select("item_id", low.alias("item"))
    inner = F.expr(r"slice(split(item, '\\s+', -1), 2, greatest(0, size(split(item, '\\s+', -1)) - 2))")
    items = items.withColumn("word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    long, short = items.filter("word is not null and word != ''"), items.filter("word is null or word = ''").drop("word")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(low, r"\s+"))).alias("word"))
    met = words.join(long.select("item_id", "word"), "word").select("doc_id", "item_id").join(docs.select("doc_id", low.alias("low")), "doc_id").join(long.select("item_id", "item"), "item_id")
    found = met.filter(F.expr("contains(low, item)")).select("doc_id", "item_id")
    if short.isEmpty():
        return found
    return found.unionByName(docs.select("doc_id", low.alias("low")).join(short, F.expr("contains(low, item)")).select("doc_id", "item_id"))


_ASK = [("q0", "Who are Customer#7 and NATION_3?", ["supply:5"]), ("q1", "What of REGION_1?", [])]


def _asked(spark) -> DataFrame:
    return spark.createDataFrame(_ASK, "question_id string, question string, doc_ids array<string>")


_SEEDS = f"""{star.SQL}, q as (select * from (values {', '.join(f"('{i}', '{t}', {ids!r}::varchar[])" for i, t, ids in _ASK)}) as x(question_id, question, doc_ids)),
seeds as (select question_id, label, key from nodes, q where coalesce(list_contains(doc_ids, doc_id), false) or coalesce(length(name) >= 3 and contains(lower(question), lower(name)), false))"""


@_query("seed_nodes", f"{_SEEDS} select question_id, label, key from seeds")
def seed_nodes(spark, d):
    return graph.seeds(star.build(spark, d)[0], _asked(spark))


@_query("seed_facts", f"""{_SEEDS},
t as (select distinct question_id, e.src_label, e.src, e.rel, e.dst_label, e.dst from seeds s join edges e on (s.label = e.src_label and s.key = e.src) or (s.label = e.dst_label and s.key = e.dst)
      where e.src_label not in ('Order') and e.dst_label not in ('Order'))
select question_id, '(' || src_label || ': ' || coalesce(a.name, src) || ') -[' || rel || ']-> (' || dst_label || ': ' || coalesce(b.name, dst) || ')' as fact
from t join nodes a on a.label = src_label and a.key = src join nodes b on b.label = dst_label and b.key = dst""")
def seed_facts(spark, d):
    nodes, edges = star.build(spark, d)
    lines = graph.touching(edges, graph.seeds(nodes, _asked(spark)), ("Order",))
    shown = nodes.select("label", "key", F.coalesce("name", "key").alias("shown"))
    lines = lines.join(shown.select(F.col("label").alias("src_label"), F.col("key").alias("src"), F.col("shown").alias("a")), ["src_label", "src"])
    lines = lines.join(shown.select(F.col("label").alias("dst_label"), F.col("key").alias("dst"), F.col("shown").alias("b")), ["dst_label", "dst"])
    return lines.select("question_id", X.edge_fact(F.col("src_label"), F.col("a"), F.col("rel"), F.col("props"), F.col("dst_label"), F.col("b")).alias("fact"))


# ---- context, prompts, metering

@_query("context_budget")
def context_budget(spark, d):
    facts = _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("facts"))
    return facts.select("conv_id", F.posexplode(X.budget("facts", 6, 2000)).alias("place", "fact"))


@_query("ordered_distinct", "select o_custkey, o_orderpriority as value, row_number() over (partition by o_custkey order by min(o_orderkey))::integer as place from orders group by o_custkey, o_orderpriority")
def ordered_distinct(spark, d):
    return linking.ordered_distinct(_t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_custkey", F.col("o_orderpriority").alias("value"), "place")


@_query("fact_format", "select o_orderkey, '(Customer: ' || o_custkey || ') -[PLACED {status: ' || o_orderstatus || '}]-> (Order: ' || o_orderkey || ')' as fact from orders")
def fact_format(spark, d):
    props = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("note"), F.lit(""))
    return _t(spark, d, "orders").select("o_orderkey", X.edge_fact(F.lit("Customer"), F.col("o_custkey").cast("string"), F.lit("PLACED"), props, F.lit("Order"), F.col("o_orderkey").cast("string")).alias("fact"))


@_query("person_fact", """
select o_orderkey, '[' || o_custkey || '] c' || o_custkey || ': vai trò ' || o_orderstatus || '; mức án ' || case when o_orderkey % 2 = 0 then 'x' else 'chưa có trong nguồn' end || '; tội danh chưa rõ; vụ ''k''.' as fact from orders""")
def person_fact(spark, d):
    o = lambda c: F.col(c).cast("string")
    fact = X.person_fact(o("o_custkey"), F.concat(F.lit("c"), o("o_custkey")), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(""), F.lit(None).cast("string"), F.lit("k"))
    return _t(spark, d, "orders").select("o_orderkey", fact.alias("fact"))


def _store(spark, d) -> DataFrame:
    chunks = chunking.chunk_docs(_docs(spark, d), 800)
    return chunks.select(F.col("id").alias("seq"), "content", "metadata", vectors.MockEmbedder()(F.col("content")).alias("embedding"))


def _questions(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@_query("flat_prompt")
def flat_prompt(spark, d):
    """All of the benchmark's items are the questions; all chunks of all documents are searched."""
    return agent.KnowledgeBaseAgent(_store(spark, d), vectors.MockEmbedder()).answer(_questions(spark, d)).select("question_id", "prompt")


@_query("graph_prompt")
def graph_prompt(spark, d):
    nodes, edges = star.build(spark, d)
    asked = _questions(spark, d).withColumn("question", F.concat("question", F.lit(" Customer#7")))
    return agent.GraphRAGAgent(_store(spark, d), nodes, edges, vectors.MockEmbedder()).answer(asked).select("question_id", "prompt")


@_query("graph_context")
def graph_context(spark, d):
    nodes, edges = star.build(spark, d)
    return context(nodes, edges, _asked(spark)).select("question_id", F.posexplode("facts").alias("place", "fact"))


@_query("keyword_recall", "select conv_id, turn, round((contains(lower(text), 'the')::int + contains(lower(text), 'la')::int + contains(lower(text), 'zzz')::int) / 3.0, 6)::double as recall from conversations")
def keyword_recall(spark, d):
    words = F.array(*map(F.lit, ("The", "la", "ZZZ")))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.round(X.keyword_recall("text", words), 6).alias("recall"))


def _usage(spark, d) -> DataFrame:
    log = _t(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    model = F.when(F.col("turn") % 3 == 0, "openai/gpt-4o-mini").when(F.col("turn") % 3 == 1, "gpt-oss-20b").otherwise("nobody/unknown")
    return log.withColumn("model", model).withColumn("input_tokens", F.col("n")).withColumn("output_tokens", (F.col("n") / 4).cast("long"))


_USAGE = """u as (select conv_id, turn, role, length(text)::bigint as i, (length(text) // 4)::bigint as o,
 case turn % 3 when 0 then 0.15 when 1 then 0.075 else 0 end::double as pi, case turn % 3 when 0 then 0.6 when 1 then 0.3 else 0 end::double as po from conversations)"""


@_query("usage_price", f"with {_USAGE} select conv_id, turn, round((i * pi + o * po) / 1e6, 9) as usd from u")
def usage_price(spark, d):
    out = metering.priced(_usage(spark, d), metering.prices(spark))
    return out.select("conv_id", "turn", F.round("usd", 9).alias("usd"))


@_query("usage_by_pipeline", f"with {_USAGE} select role as pipeline, count(*)::bigint as calls, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, round(sum((i * pi + o * po) / 1e6), 6) as usd from u group by role")
def usage_by_pipeline(spark, d):
    log = metering.priced(_usage(spark, d), metering.prices(spark)).withColumn("calls", F.lit(1)).withColumn("seconds", F.lit(0.0)).withColumnRenamed("role", "pipeline")
    return metering.totals(log, "pipeline").select("pipeline", "calls", "input_tokens", "output_tokens", F.round("usd", 6).alias("usd"))


@_query("usage_delta", "select user_id, event_id, round(value - coalesce(lag(value) over (partition by user_id order by event_id), 0), 6) as usd from events")
def usage_delta(spark, d):
    zero = [F.lit(0).cast("long").alias(c) for c in ("calls", "input_tokens", "output_tokens")]
    log = _t(spark, d, "events").select("user_id", "event_id", F.col("value").alias("usd"), F.lit(0.0).alias("wall_seconds"), *zero)
    return metering.deltas(log, "user_id", "event_id").select("user_id", "event_id", F.round("usd", 6).alias("usd"))


@_query("usage_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by all")
def usage_windows(spark, d):
    from ..streaming.usage import windowed

    return windowed(_t(spark, d, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("provider_choice", "select 'groq' as provider")
def provider_choice(spark, d):
    rows = [(p, i, p in ("groq", "local")) for i, p in enumerate(metering.PROVIDERS)]
    return metering.choose_provider(spark.createDataFrame(rows, "provider string, rank int, usable boolean"))


# ---- pages

@_query("page_title", r"select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title from pages")
def page_title(spark, d):
    return _t(spark, d, "pages").select("page_id", html.title("html").alias("title"))


@_query("link_extract", r"select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) as link from pages")
def link_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(html.links("html")).alias("link"))


@_query("html_tag_strip", r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'), '(?s)<(?:sup.*?</sup|figure.*?</figure|table.*?</table)>', '', 'g'),
  '<br\s*/?>|</(?:p|div|h\d|li)>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') as body from pages""")
def html_tag_strip(spark, d):
    return _t(spark, d, "pages").select("page_id", html.strip_tags("html").alias("body"))


@_query("html_regex_text")
def html_regex_text(spark, d):
    return _t(spark, d, "pages").select("page_id", html.page_text("html").alias("body"))


@_query("html_parser_text")
def html_parser_text(spark, d):
    return _t(spark, d, "pages").select("page_id", html.parse("html").alias("x")).select("page_id", "x.title", F.col("x.text").alias("body"))


@_query("page_quality_gate", r"""
select page_id from (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'), '(?s)<(?:sup.*?</sup|figure.*?</figure|table.*?</table)>', '', 'g'),
  '<br\s*/?>|</(?:p|div|h\d|li)>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') as body from pages) where length(trim(body, E' \t\n\r\f\v')) >= 80""")
def page_quality_gate(spark, d):
    return documents.content_gate(_t(spark, d, "pages").select("page_id", html.strip_tags("html").alias("content"))).select("page_id")


@_query("page_metadata")
def page_metadata(spark, d):
    return documents.page_metadata(_t(spark, d, "pages").select("page_id", "url", html.title("html").alias("title"))).select("page_id", "doc_id", "title")


@_query("manifest", "select source as doc_id, arg_max('d/' || doc_id || '.md', doc_id) as file_path, '' as title, '' as source_url, '' as retrieved_at, '' as document_version, '' as license_or_permission from documents group by source")
def manifest(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("doc_id").alias("o"))
    return documents.manifest(documents.latest(rows, "o"))


@_query("front_matter_roundtrip", r"select doc_id::varchar as id, trim(text, E' \t\n\r\f\v') as content, source from documents")
def front_matter_roundtrip(spark, d):
    made = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("t").alias("title"), F.col("text").alias("body"), "source")
    raw = made.select(F.concat(F.lit("x/"), F.col("doc_id"), F.lit(".md")).alias("file"), documents.markdown(meta=("doc_id", "title", "source")).alias("value"))
    out = documents.parse_markdown(raw)
    return out.select("id", X.strip(F.regexp_replace("content", r"\A# t\n\n", "")).alias("content"), F.element_at("metadata", "source").alias("source"))


# ---- building, storing and reporting

@_query("graph_store_roundtrip", f"{star.SQL} select 'node' as kind, label as name, count(*)::bigint as n from nodes group by label union all select 'edge', rel, count(*) from edges group by rel "
        "union all select 'total', 'nodes', count(*) from nodes union all select 'total', 'relationships', count(*) from edges union all select 'shared', label, count(*) from nodes where doc_id is null group by label")
def graph_store_roundtrip(spark, d):
    store = build.GraphStore(spark, new_folder(spark, "graph"))
    store.save(*star.build(spark, d))
    return build.summary(*store.load())


@_query("pinned_first", "select c_custkey, c_name from customer order by c_custkey <> 77, c_custkey limit 20")
def pinned_first(spark, d):
    return build.pinned_first(_t(spark, d, "customer").select("c_custkey", "c_name"), "77", 20, "c_custkey", "c_custkey")


@_query("sorted_crimes", "select p_type as name, row_number() over (order by p_type)::bigint as ord from (select distinct p_type from part)")
def sorted_crimes(spark, d):
    return lawparse.known_crimes(_t(spark, d, "part").select(F.col("p_type").alias("crime")))


@_query("case_linking", """
select o_orderkey::varchar as id, case when o_orderkey % 2 = 0 then 'crime-a|crime-b' else 'crime-a' end as charges, case when o_orderkey % 3 = 0 then 'crime-b' else '' end as of_person from orders""")
def case_linking(spark, d):
    """Cases name charges in other spellings, twice, and unknown ones."""
    text = lambda x: F.concat(F.lit('{"cases": [{"name": "x", "charges": ["Tội Crime-A", "crime-a", "zzz"'), F.when(F.col(x) % 2 == 0, ', "CRIME-B"').otherwise(""), F.lit('], "people": [{"name": "p", "charge": "'), F.when(F.col(x) % 3 == 0, "tội crime-b").otherwise("qqq"), F.lit('"}]}]}'))
    raw = parse_cases(_t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), text("o_orderkey").alias("answer")))
    known = spark.createDataFrame([(1, "crime-a"), (2, "crime-b")], "ord long, name string")
    out = linking.link_cases(raw.drop("answer"), known, fuzzy=False).select("id", F.explode("cases").alias("c"))
    return out.select("id", F.array_join("c.charges", "|").alias("charges"), F.col("c.people")[0]["charge"].alias("of_person"))


@_query("seed_facts_limited", f"""{_SEEDS},
t as (select distinct question_id, e.src_label, e.src, e.rel, e.dst_label, e.dst from seeds s join edges e on (s.label = e.src_label and s.key = e.src) or (s.label = e.dst_label and s.key = e.dst))
select question_id, src_label, src, rel, dst_label, dst from t qualify row_number() over (partition by question_id order by src_label, src, rel, dst_label, dst) <= 60""")
def seed_facts_limited(spark, d):
    nodes, edges = star.build(spark, d)
    return graph.first_edges(graph.touching(edges, graph.seeds(nodes, _asked(spark))), 60).select("question_id", "src_label", "src", "rel", "dst_label", "dst")


@_query("label_prefix", f"{star.SQL} select label, key from nodes where starts_with(name, 'Customer#0000001') and doc_id is not null")
def label_prefix(spark, d):
    return star.build(spark, d)[0].filter(F.startswith("name", F.lit("Customer#0000001")) & F.col("doc_id").isNotNull()).select("label", "key")


def _measured(spark, d) -> DataFrame:
    """A line of usage for each turn, roles as pipelines."""
    log = metering.priced(_usage(spark, d), metering.prices(spark)).withColumnRenamed("role", "pipeline")
    return log.withColumn("calls", F.lit(1)).withColumn("seconds", F.col("n") / 8)


@_query("usage_means", f"""with {_USAGE} select role as pipeline, round(avg(i), 6) as input_tokens, round(avg((i * pi + o * po) / 1e6), 9) as usd, round(avg(case when i % 2 = 0 then 1.0 else 0.0 end), 6)::double as recall,
 round(avg(case when turn % 2 = 0 then 2 else 0 end), 6) as judge from u group by role""")
def usage_means(spark, d):
    """Every second turn has no judgement, which counts 0."""
    log = _measured(spark, d).withColumn("recall", (F.col("n") % 2 == 0).cast("double")).withColumn("judge", F.when(F.col("turn") % 2 == 0, 2))
    return metering.means(log).select("pipeline", F.round("input_tokens", 6).alias("input_tokens"), F.round("usd", 9).alias("usd"), F.round("recall", 6).alias("recall"), F.round("judge", 6).alias("judge"))


@_query("usage_composed", f"with {_USAGE} select 'index' as phase, count(*)::bigint as calls, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, round(sum((i * pi + o * po) / 1e6), 6) as usd from u where role in ('user', 'assistant')")
def usage_composed(spark, d):
    log = _measured(spark, d).withColumnRenamed("pipeline", "phase")
    return metering.composed(log, ["user", "assistant"], "index").select("phase", "calls", "input_tokens", "output_tokens", F.round("usd", 6).alias("usd"))


@_query("report_answers", """
select o_orderkey::varchar as question_id, 'flat' as pipeline, '--- ' || o_orderkey || ' [' || o_orderpriority || '] flat recall=' || case when o_orderstatus = 'F' then '1.00' else '0.00' end
  || ' judge=' || (o_orderkey % 3) || ' 0.25s' || chr(10) || o_orderstatus as line from orders""")
def report_answers(spark, d):
    orders = _t(spark, d, "orders").withColumn("question_id", F.col("o_orderkey").cast("string"))
    questions = orders.select("question_id", F.col("o_orderpriority").alias("type"), F.lit("?").alias("question"), F.concat(F.lit("g"), (F.col("o_orderkey") % 3).cast("string")).alias("gold"), F.array(F.lit("f")).alias("must_include"))
    answers = orders.select("question_id", F.concat(F.lit(" "), "o_orderstatus").alias("answer"), F.lit(0.25).alias("seconds"))
    judge = lambda p: F.concat(F.lit('{"score": '), F.regexp_extract(p, r"chuẩn: g(\d)", 1), F.lit("}"))
    return report.answer_lines(agent.benchmark(questions, {"flat": answers}, judge), questions)


@_query("clause_fact", "select p_partkey, '[' || p_partkey || ' - ' || p_name || '] khoản ' || p_size || ': ' || p_type as fact from part")
def clause_fact(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.clause_fact(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size"), F.col("p_type")).alias("fact"))


@_query("case_fact", "select s_suppkey, '[' || s_suppkey || '] Vụ việc ''' || s_name || ''': ' || s_nationkey as fact from supplier")
def case_fact(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", X.case_fact(F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_nationkey").cast("string")).alias("fact"))


@_query("law_pages", """
select 'blhs-dieu-' || o_orderkey as doc_id, 'Điều ' || o_orderkey || ' BLHS. ' || o_orderstatus as title, 'Điều ' || o_orderkey || '. ' || o_orderstatus || chr(10) || 'by ' || o_custkey as body from orders
union all select 'blhs-dieu-7' || o_orderkey, 'Điều 7' || o_orderkey || ' BLHS. z', 'Điều 7' || o_orderkey || '. z' || chr(10) || 'end' from orders""")
def law_pages(spark, d):
    """A page of two articles with footnotes and notes from each order."""
    page = F.expr("""concat('<i>no</i><div class="mw-parser-output"><p>intro</p><h3>Điều ', o_orderkey, '. ', o_orderstatus, '</h3><p>by ', o_custkey, '</p><p>↑ note</p><h3>Điều 7', o_orderkey,
        '. z</h3><p>end</p><p>Ghi chú</p><p>gone</p></div><div class="printfooter">Điều 3. no')""")
    pages = _t(spark, d, "orders").select(F.lit("u").alias("url"), F.lit("BLHS").alias("law"), F.lit("v").alias("version"), page.alias("html"))
    return html.law_pages(pages).select("doc_id", "title", "body")


@_query("news_pages", """
select 'news-' || o_orderkey as doc_id, 'ma túy & ' || o_orderstatus as title, 'lead' || chr(10) || chr(10) || repeat('y', 400) || chr(10) || chr(10) || repeat('z', 41) as body from orders where o_orderkey % 3 <> 0""")
def news_pages(spark, d):
    """A page of news from each order; every third is too short."""
    page = F.expr("""concat('<h1 data-role="title">ma túy &amp; ', o_orderstatus, '</h1><h2 data-role="sapo">lead</h2><div data-role="content"><p>', repeat('y', if(o_orderkey % 3 = 0, 200, 400)),
        '</p><p>short</p><p class="k">', repeat('z', 41), '</p></div><div class="detail-author-bot"><p>', repeat('w', 90), '</p>')""")
    pages = _t(spark, d, "orders").select(F.expr("concat('/a-', o_orderkey, '.htm')").alias("path"), F.lit("u").alias("url"), page.alias("html"))
    return html.news_pages(pages, "ma túy").select("doc_id", "title", "body")


@_query("metadata_extra", "select page_id, case when page_id % 2 = 0 then page_id::varchar end as publisher, case when page_id % 3 = 0 then 'v' else 'not-stated' end as document_version from pages")
def metadata_extra(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "url", F.lit("").alias("title"), F.expr("if(page_id % 2 = 0, cast(page_id as string), '')").alias("publisher"), F.expr("if(page_id % 3 = 0, 'v', null)").alias("document_version"))
    out = documents.page_metadata(pages, ("publisher", "document_version"))
    return out.select("page_id", F.element_at("extra", "publisher").alias("publisher"), "document_version")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, embed, search, prompt."""
    return flat_prompt(spark, sf_dir)
