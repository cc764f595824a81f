"""Benchmark decontamination by winnowing, in Spark expressions only.

A document is cut into words; every run of K words is hashed, and of any W = SPAN - K + 1 hashes in a row the
smallest is kept. Any span of SPAN words holds W such hashes, so whatever text holds the span keeps the same one of
them: two texts that share SPAN words share a fingerprint. A fingerprint stands for the run of spans that it is the
smallest of. Fingerprints of documents meet those of the benchmark; each meeting is extended to the spans of its run,
which are compared with the item windows word by word, so a false meeting costs time and never changes the result. Items shorter than SPAN words are one window of their own
length L: for each L that occurs in the benchmark the run length is L and every hash is kept.

The benchmark side is broadcast only after its row count is found to be under BROADCAST_ROWS; beyond that the same
joins shuffle. Documents are keyed by (doc_id, hash of the text), so repeated rows and null ids are judged alike.

Cases: a null or wordless text has no words, no hits; an empty benchmark leaves all clean; several items may hold the
same window, all are named; other columns pass through `decontaminate` (names starting with `_d_` are taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fits_broadcast, table

SPAN, K = 10, 5
BROADCAST_ROWS = 200_000
_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _worded(df: DataFrame, *keep: str) -> DataFrame:
    """keep, the words w and their number n."""
    cut = F.split(ascii_lower(F.coalesce("text", F.lit(""))), _CUT)
    # only the first and the last piece can be empty
    out = df.select(*keep, cut.alias("_s")).withColumn(
        "w", F.expr("slice(_s, if(_s[0] = '', 2, 1), greatest(0, size(_s) - if(_s[0] = '', 1, 0) - if(size(_s) > 1 and _s[size(_s) - 1] = '', 1, 0)))")
    )
    return out.withColumn("n", F.size("w")).drop("_s")


def _hashes(k: int) -> str:
    return f"transform(sequence(0, n - {k}), i -> xxhash64({', '.join(f'w[i + {j}]' if j else 'w[i]' for j in range(k))}))"


def _selected(span: int) -> str:
    """SQL over w and n: the winnowed fingerprints as structs (p, q, h): h is the smallest hash of each span p to q."""
    k = min(K, span) if span == SPAN else span
    wide = span - k + 1
    if wide == 1:
        body = "transform(h, (x, i) -> struct(i as p, i as q, x as h))"
    else:
        low = f"least({', '.join(f'get(h, i + {j})' if j else 'get(h, i)' for j in range(wide))})"
        mins = f"transform(sequence(0, greatest(size(h) - {wide}, 0)), i -> {low})"
        first = "filter(sequence(0, size(m) - 1), i -> i = 0 or m[i] != m[i - 1])"
        runs = "transform(f, (i, j) -> struct(i as p, coalesce(get(f, j + 1), size(m)) - 1 as q, m[i] as h))"
        body = f"transform(array({mins}), m -> transform(array({first}), f -> {runs})[0])[0]"
    return f"if(n < {span}, array(), transform(array({_hashes(k)}), h -> {body})[0])"


def _windows(bench: DataFrame) -> DataFrame:
    """(item_id, len, win): every window of every item as one string of words."""
    items = _worded(bench, "item_id").filter("n > 0")
    return items.select(
        "item_id",
        F.expr(f"least(n, {SPAN})").alias("len"),
        F.explode(F.expr(f"array_distinct(transform(sequence(0, n - least(n, {SPAN})), i -> array_join(slice(w, i + 1, least(n, {SPAN})), ' ')))")).alias("win"),
    )


def _near(df: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(small) if few else small


def hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, _d_t, n_hit, items): of documents with a hit; _d_t is the hash of the text."""
    spark = docs.sparkSession
    windows = _windows(bench)
    few = fits_broadcast(windows, BROADCAST_ROWS)
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most SPAN values
    if not lengths:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _d_t bigint, n_hit bigint, items array<string>")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_d_t"), "text")
    met = None
    for span in lengths:
        prints = _worded(bench, "item_id").filter(f"n >= {span}" if span == SPAN else f"n = {span}")
        prints = prints.select(F.explode(F.expr(_selected(span))).alias("f")).select(F.col("f.h").alias("h")).distinct()
        own = _worded(keyed, "doc_id", "_d_t").select("doc_id", "_d_t", F.explode(F.expr(_selected(span))).alias("f"))
        own = own.select("doc_id", "_d_t", F.lit(span).alias("len"), F.col("f.p").alias("p"), F.col("f.q").alias("q"), F.col("f.h").alias("h"))
        own = own.join(_near(own, prints, few), "h", "left_semi").drop("h")
        met = own if met is None else met.unionByName(own)
    # meetings of one document; a struct is three numbers, and there are no more of them than fingerprints in its text
    met = met.groupBy("doc_id", "_d_t").agg(F.collect_set(F.struct("len", "p", "q")).alias("met"))
    starts = "flatten(transform(met, m -> transform(sequence(m.p, m.q), s -> struct(m.len as len, s as s))))"
    # every text that met, once, with its words; documents without a meeting are dropped in the join
    texts = keyed.join(met.withColumnRenamed("doc_id", "_d_id").withColumnRenamed("_d_t", "_d_u"), F.expr("doc_id <=> _d_id and _d_t = _d_u"))
    texts = texts.dropDuplicates(["doc_id", "_d_t"])
    spread = _worded(texts, "doc_id", "_d_t", "met").select("doc_id", "_d_t", "w", F.explode(F.expr(starts)).alias("x"))
    spread = spread.select("doc_id", "_d_t", "x", F.expr("array_join(slice(w, x.s + 1, x.len), ' ')").alias("win"))
    by_window = windows.groupBy("len", "win").agg(F.collect_set(F.col("item_id").cast("string")).alias("of"))
    found = spread.withColumn("len", F.col("x.len")).join(_near(spread, by_window, few), ["len", "win"])
    spans = found.groupBy("doc_id", "_d_t").agg(
        F.sort_array(F.collect_set(F.struct(F.col("x.s").alias("s"), F.col("x.len").alias("len")))).alias("x"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("of")))).alias("items"),
    )
    covered = "aggregate(x, struct(0L as n, 0L as e), (a, y) -> struct(a.n + greatest(0L, y.s + y.len - greatest(a.e, y.s)) as n, greatest(a.e, cast(y.s + y.len as bigint)) as e)).n"
    return spans.select("doc_id", "_d_t", F.expr(covered).alias("n_hit"), "items")


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the rows that share a window with the benchmark."""
    bad = hits(docs, bench).select(F.col("doc_id").alias("_d_id"), "_d_t")
    keyed = docs.withColumn("_d_u", F.xxhash64("text"))
    return keyed.join(bad, F.expr("doc_id <=> _d_id and _d_u = _d_t"), "left_anti").drop("_d_u")


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    counted = _worded(docs.select("doc_id", "text", F.xxhash64("text").alias("_d_u")), "doc_id", "_d_u").select("doc_id", "_d_u", "n")
    found = hits(docs, bench).withColumnRenamed("doc_id", "_d_id")
    out = counted.join(found, F.expr("doc_id <=> _d_id and _d_u = _d_t"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
ls as (select distinct l from bw),
dw as (
  select rid, l, i, array_to_string(w[i:i + l - 1], ' ') as win
  from (select rid, w, l, unnest(range(1, len(w) - l + 2)) as i from d, ls where len(w) >= l)),
h as (select rid, i, dw.l, item_id from dw join bw on dw.l = bw.l and dw.win = bw.win),
p as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + l)) as p from h) group by rid),
s as (select rid, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(p.n, 0)::bigint as n_hit, coalesce(s.n, 0)::bigint as n_items,
       sha256(coalesce(s.items, '')) as items_sha256, coalesce(p.n, 0) > 0 as contaminated
from d left join p using (rid) left join s using (rid)
"""
