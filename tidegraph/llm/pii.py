"""Personal data by bootstrapped contextual extraction, in Spark expressions only.

Seeds are what four patterns find (email, ip, card, phone) and, as `secret`, long runs of lower-case hexadecimal digits. Each
seed and each other identifier-shaped token (it holds a digit) is an instance that meets lexical patterns: the word before it
with the signs between, that word alone, the two words before it, the word after it, and both sides. Spark scores the
graph of patterns and instances in rounds until no instance becomes known: a pattern is trusted for a kind when at least SUPPORT distinct known
instances of that kind meet it and they are at least PRECISION of all distinct instances that meet it; an unknown
instance becomes known when the trusted patterns of one kind that meet it leave a doubt, the product of (1 - precision),
of at most DOUBT. All occurrences of what became known are spans of that kind. Base spans always stay.

Every count is a grouped aggregate over all documents; nothing is collected. Spans are in code points, end exclusive.
Neighbours are taken from the whole text before and after an instance, however far they stand.

Cases: null and empty texts have no spans; very long runs of letters, digits or signs cost linear time (the patterns
are possessive or bounded); repeated rows are each reported; an empty table gives none; other columns pass through
`redact` (names starting with `_p_` are taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

KINDS = ("email", "ip", "card", "phone")
#: In the order of spans: the base kinds, then what only this method names.
ALL = (*KINDS, "secret")
SUPPORT, PRECISION, DOUBT = 5, 0.8, 0.1
BLOCK = 256
#: A pattern longer than this goes by its digest.
PATTERN = 64

_LOCAL = "[A-Za-z0-9._%+-]"
#: The same matches as the plain patterns: a run is entered at its start or where the last match ended, never inside.
_BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap conditions without which a pattern cannot match.
_MAYBE = {
    "email": "instr(_p_t, '@') > 0",
    "ip": r"_p_t rlike '[0-9]\\.[0-9]++\\.[0-9]'",
    "card": "_p_t rlike '[0-9](?:[ -]?[0-9]){15}'",
    "phone": "instr(_p_t, '+') > 0",
}
_VALID = {
    "email": "true",
    "ip": r"not exists(split(x, '\\.'), p -> not (p rlike '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$'))",
    "card": "aggregate(transform(array(translate(x, ' -', '')), d -> transform(sequence(1, length(d)), i -> transform(array(cast(substring(d, -i, 1) as int)),"
    " v -> if(i % 2 = 1, v, if(v > 4, 2 * v - 9, 2 * v)))[0]))[0], 0, (a, v) -> a + v) % 10 = 0",
    "phone": "length(regexp_replace(x, '[^0-9]', '')) between 8 and 15",
}
_TOKEN = r"(?<![A-Za-z0-9._%+@/-])[A-Za-z._%+@/-]*+[0-9][A-Za-z0-9._%+@/-]*+"
_SECRET = "if(x rlike '^[0-9a-f]{32,}$' and x rlike '[a-f]', 'secret', '')"
_SPAN = "array<struct<kind:string,s:int,e:int,inst:string,pats:array<string>>>"
#: From where an instance stands outwards: signs, a word, signs, a word.
_NEAR = r"^([^\p{L}\p{N}]*+)([\p{L}\p{N}]*+)[^\p{L}\p{N}]*+([\p{L}\p{N}]*+)"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _patterns() -> str:
    """SQL over the text before (reversed) and after an instance, p and q: the lexical patterns that it meets."""
    word = lambda x: f"lower(translate({x}, '123456789', '000000000'))"
    signs = lambda x: f"regexp_replace({x}, {_lit('[ \\t-\\r]+')}, ' ')"
    near = lambda side, k: f"regexp_extract({side}, {_lit(_NEAR)}, {k})"
    l1, l2, r1 = word(f"reverse({near('p', 2)})"), word(f"reverse({near('p', 3)})"), word(near("q", 2))
    found = f"struct({l1} as l1, {signs(f'reverse({near("p", 1)})')} as lp, {l2} as l2, {signs(near('q', 1))} as rp, {r1} as r1)"
    all_of = (
        "array(if(l1 = '', null, concat('L ', l1, lp)), if(l1 = '', null, concat('W ', l1)), if(l2 = '', null, concat('T ', l2, ' ', l1, lp)),"
        " if(r1 = '', null, concat('R ', rp, r1)), if(l1 = '' or r1 = '', null, concat('B ', l1, lp, '_', rp, r1)))"
    )
    for name in ("l1", "lp", "l2", "rp", "r1"):
        all_of = all_of.replace(f"{name}", f"f.{name}")
    return f"transform(transform(array({found}), f -> filter({all_of}, z -> z is not null))[0], z -> if(length(z) > {PATTERN}, sha2(z, 256), z))"


def _found(kind: str, pattern: str, maybe: str, valid: str) -> str:
    """SQL over _p_t: the valid matches as structs (kind, s, e, inst, pats), pats the patterns that they meet. kind: SQL over x."""
    # where matches start: sums over blocks of BLOCK first, then within them, so that no long list is copied for each match
    step = "(u, v) -> struct(u.p + v as p, concat(u.o, array(u.p)) as o)"
    total = f"aggregate(slice(a, k * {BLOCK} + 1, {BLOCK}), 0, (u, v) -> u + v)"
    sums = f"aggregate(transform(sequence(0, (size(a) - 1) div {BLOCK}), k -> {total}), struct(0 as p, cast(array() as array<int>) as o), {step}).o"
    within = f"flatten(transform({sums}, (c, k) -> aggregate(slice(a, k * {BLOCK} + 1, {BLOCK}), struct(c as p, cast(array() as array<int>) as o), {step}).o))"
    lengths = f"transform(transform(array(transform(m, (x, i) -> length(g[i]) + length(x))), a -> {within})[0], (c, i) -> c + length(g[i]))"
    sides = "struct(reverse(concat(coalesce(get(m, i - 1), ''), g[i])) as p, concat(g[i + 1], coalesce(get(m, i + 1), '')) as q)"
    pats = f"transform(array({sides}), y -> {_patterns().replace('(p,', '(y.p,').replace('(q,', '(y.q,')})[0]"
    each = f"transform(m, (x, i) -> if({valid}, struct({kind} as kind, o[i] as s, o[i] + length(x) as e, x as inst, {pats} as pats), null))"
    body = f"filter(transform(array({lengths}), o -> {each})[0], y -> y is not null)"
    cut = f"transform(array(split(_p_t, {_lit(pattern)}, -1)), g -> if(size(m) = 0, cast(array() as {_SPAN}), {body}))[0]"
    return f"if({maybe}, transform(array(regexp_extract_all(_p_t, {_lit(pattern)}, 0)), m -> {cut})[0], cast(array() as {_SPAN}))"


def spans(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """docs with `_p_id` (of the row), `_p_base` and `_p_more`: seeds, and other identifier-shaped tokens; written once."""
    out = docs.withColumn("_p_t", F.coalesce("text", F.lit(""))).drop(*without)
    base = "concat(" + ", ".join(_found(f"'{k}'", _BASE[k], _MAYBE[k], _VALID[k]) for k in KINDS) + ")"
    more = _found(_SECRET, _TOKEN, "_p_t rlike '[0-9]'", "true")
    out = out.withColumn("_p_base", F.expr(base)).withColumn("_p_all", F.expr(more))
    # spans of a kind are sorted and apart: the last that starts before a token ends is found by halving
    halve = "aggregate(sequence(1, 31), struct(0 as lo, size(a) as hi), (c, i) -> if(c.lo >= c.hi, c, if(a[(c.lo + c.hi) div 2].s < y.e, struct(cast((c.lo + c.hi) div 2 + 1 as int) as lo, c.hi as hi), struct(c.lo as lo, cast((c.lo + c.hi) div 2 as int) as hi)))).lo"
    out = out.withColumn("_p_by", F.expr(f"filter(transform(array({', '.join(map(repr, KINDS))}), k -> filter(_p_base, z -> z.kind = k)), a -> size(a) > 0)"))
    clear = f"filter(_p_all, y -> not exists(_p_by, a -> coalesce(get(a, {halve} - 1).e > y.s, false)))"
    out = out.withColumn("_p_more", F.expr(clear)).drop("_p_all", "_p_by", "_p_t").withColumn("_p_id", F.monotonically_increasing_id())
    return materialise(out, "pii-spans")


def discovered(found: DataFrame) -> DataFrame:
    """(inst, kind): what the trusted patterns make known, beyond the seeds."""
    both = found.select(F.explode(F.concat("_p_base", "_p_more")).alias("x"))
    meets = both.select("x.kind", "x.inst", F.explode("x.pats").alias("pat")).distinct()
    meets = materialise(meets, "pii-meets")
    known = meets.limit(0).select("inst", F.col("kind").alias("got"))  # kinds that the rounds have given
    while True:
        now = meets.join(known, "inst", "left").withColumn("kind", F.when(F.col("kind") == "", F.coalesce("got", F.lit(""))).otherwise(F.col("kind"))).drop("got")
        by = now.groupBy("pat", "kind").agg(F.count("*").alias("n"))
        trusted = by.groupBy("pat").agg(F.sum("n").alias("all"), F.max(F.when(F.col("kind") != "", F.struct("n", "kind"))).alias("best"))
        trusted = trusted.filter(f"best.n >= {SUPPORT} and best.n >= {PRECISION} * all").select("pat", F.col("best.kind").alias("to"), (F.col("best.n") / F.col("all")).alias("sure"))
        votes = now.filter("kind = ''").join(trusted, "pat").groupBy("inst", "to").agg(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9)))).alias("doubt"))
        new = votes.groupBy("inst").agg(F.min(F.struct("doubt", "to")).alias("x")).filter(F.exp("x.doubt") <= DOUBT).select("inst", F.col("x.to").alias("got"))
        new = materialise(new, "pii-known")
        if new.isEmpty():
            break
        known = known.union(new)
    return known.withColumnRenamed("got", "kind")


def extract(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """docs (less some columns), `_p_base` and `_p_spans`: seeds, and all spans in the order of kind, then start."""
    found = spans(docs, without)
    new = discovered(found)
    place = "array_sort(transform({}, x -> struct(case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(ALL)) + " end as k, x.s as s, x.e as e, x.kind as kind)))"
    seeds = "filter(_p_more, x -> x.kind != '')"
    if new.isEmpty():
        out = found.withColumn("_p_add", F.expr(seeds))
    else:
        add = found.select("_p_id", F.explode(F.expr("filter(_p_more, x -> x.kind = '')")).alias("x")).select("_p_id", "x", F.col("x.inst").alias("inst")).join(new, "inst")
        add = add.groupBy("_p_id").agg(F.collect_list(F.expr("struct(kind, x.s as s, x.e as e, x.inst as inst, x.pats as pats)")).alias("_p_add"))
        out = found.join(add, "_p_id", "left").withColumn("_p_add", F.expr(f"concat({seeds}, coalesce(_p_add, cast(array() as {_SPAN})))"))
    return (
        out.withColumn("_p_spans", F.expr(place.format("concat(_p_base, _p_add)")))
        .withColumn("_p_base", F.expr(place.format("_p_base"))).drop("_p_id", "_p_more", "_p_add")
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans become one."""
    columns = docs.columns
    merged = """aggregate(array_sort(transform(_p_spans, x -> struct(x.s as s, x.e as e, x.kind as kind))), cast(array() as array<struct<s:int,e:int,kind:string>>),
        (a, x) -> if(size(a) > 0 and element_at(a, -1).e > x.s,
            concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, x.e) as e, element_at(a, -1).kind as kind))), concat(a, array(x))))"""
    out = extract(docs).withColumn("_p_m", F.expr(merged))
    pieces = "transform(_p_m, (x, i) -> concat(substring(text, coalesce(get(_p_m, i - 1).e, 0) + 1, x.s - coalesce(get(_p_m, i - 1).e, 0)), '[', upper(x.kind), ']'))"
    tail = "substring(text, element_at(_p_m, -1).e + 1)"
    out = out.withColumn("text", F.expr(f"if(size(_p_m) = 0, text, concat(array_join({pieces}, ''), {tail}))"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.expr("size(_p_m) > 0"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "documents").select("doc_id", "text"), without=("text",))
    count = lambda k: F.expr(f"cast(size(filter(_p_base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    more = [F.expr("cast(size(_p_spans) as bigint)").alias("n_spans"), F.expr("cast(size(_p_spans) - size(_p_base) as bigint)").alias("n_found")]
    return out.select("doc_id", *[count(k) for k in KINDS], *more, F.sha2(F.expr(text.format("_p_base")), 256).alias("base_sha256"), F.expr(text.format("_p_spans")).alias("spans"))
