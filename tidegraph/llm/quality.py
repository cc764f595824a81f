"""Quality rules as a short-circuit cascade, in Spark expressions only.

Rules are independent predicates that reject a document. A sample of about ROWS rows, drawn from all of the table, gives
each rule's cost (seconds a row) and selectivity (share rejected); the cascade asks the rules in falling order of rejection
per cost, in one CASE, so that a costly expression is evaluated only for rows that the cheaper ones let pass. The order
changes the work and `rejected_by`, never the verdict.

Cases: a null text has no words and fails `short`; an empty text likewise; repeated rows are judged each on its own;
an empty table gives an empty result; other columns pass through `apply_rules` untouched but for `rejected_by`, which it
replaces, and through `passing` whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACES = " \t\n\x0b\f\r"
#: SQL over a column t (text, not null); the words of a text, none of them empty.
WORDS = r"if(length(btrim(t, ' \t\n\u000B\u000C\r')) = 0, array(), split(btrim(t, ' \t\n\u000B\u000C\r'), '[ \\t\\n\\x0B\\f\\r]+'))"
LINES = r"filter(split(t, '\n', -1), x -> x rlike '[^ \\t\\n\\x0B\\f\\r]')"
#: Window starts, sorted, whose three words occur at least twice. The sort runs over longs (hash above, position
#: below); members of a run of equal hashes are then told apart by their words, so the result is exact.
_RUNS = (
    "sort_array(transform(sequence(0, n - 3), i -> coalesce(shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | cast(i as bigint), 0L)))"
)
_NEAR = (
    "transform(filter(k, (x, j) -> (j > 0 and shiftright(x, b) = shiftright(get(k, j - 1), b))"
    " or (j < size(k) - 1 and shiftright(x, b) = shiftright(get(k, j + 1), b))), x -> cast(x & (shiftleft(1L, b) - 1) as int))"
)
_SAME = "sort_array(transform(c, p -> struct(concat_ws(' ', w[p], w[p + 1], w[p + 2]) as g, p as p)))"
_TWICE = (
    "sort_array(transform(filter(s, (x, j) -> (j > 0 and x.g = get(s, j - 1).g)"
    " or (j < size(s) - 1 and x.g = get(s, j + 1).g)), x -> x.p))"
)
_COVERED = "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1), x + 3) - x)), 0L, (a, x) -> a + x)"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Words in three-word windows found at least twice in the text.
REPEATED = f"if(n < 4, 0L, {_let('k', _RUNS, _let('c', _NEAR, f'if(size(c) = 0, 0L, ' + _let('s', _SAME, _let('p', _TWICE, _COVERED)) + ')'))})"


@dataclass(frozen=True)
class Rule:
    """rejects: SQL over t (text), w (words), n (their number), b (bits that hold a position)."""

    name: str
    rejects: str


#: Thresholds are parameters; these are production's.
RULES = (
    Rule("short", "n < 50"),
    Rule("symbols", "10 * regexp_count(t, '[#*$%&|<>]') > n"),
    Rule("shouting", "10 * regexp_count(t, '!!') > n"),
    Rule("word_length", "length(array_join(w, '')) not between 2 * n and 15 * n"),
    Rule("repeated_lines", _let("l", LINES, "100 * (size(l) - size(array_distinct(l))) > 50 * size(l)")),
    Rule("repeated_windows", f"100 * {REPEATED} > 50 * n"),
)


#: The same verdicts where the base figures are there already: columns of `figures`.
KNOWN = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("shouting", "10 * regexp_count(_q_t, '!!') > n_words"),
    Rule("word_length", "word_chars not between 2 * n_words and 15 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * _q_lines"),
)


def _bound(sql: str, text: str = "text") -> str:
    """sql over t, w, n, b as one over the column of texts. Bound as lambda variables: as columns, a filter on the result would
    be pushed down and spell them out at each use."""
    for name, value in (("b", "cast(length(bin(n)) as int)"), ("n", "size(w)"), ("w", WORDS), ("t", f"coalesce(`{text}`, '')")):
        sql = _let(name, value, sql)
    return sql


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


#: Rows that the sample is drawn for, evaluations of a rule in one timing, and timings, of which the shortest counts.
ROWS, EVALUATIONS, TIMINGS = 2000, 4000, 3


def measure(docs: DataFrame, rules=RULES, prepare=None, rows: int = ROWS, seed: int = 7) -> list[Measured]:
    """Cost (seconds a row) and selectivity of each rule, most rejection per cost first.

    The sample is drawn row by row from all of docs, at the share that gives `rows` of them, or all rows where there are no
    more. A rule's time is that of a job that asks it, less that of the same job with a rule that costs nothing, so that
    starting jobs and reading the sample count for none; a small sample is asked repeatedly. prepare: docs -> columns that
    the rules are over, its cost is no rule's; else rules are over t, w, n, b. Ties keep the order of `rules`; so does an empty table.
    """
    total = docs.count()
    sample = docs if total <= rows else docs.sample(rows / total, seed)
    if prepare is None:
        sample = sample.select(F.expr(_bound("struct(t, w, n, b)")).alias("_q"))
        ask = lambda sql: _let("x", "_q", _of_struct(sql))
    else:
        sample, ask = prepare(sample), lambda sql: sql
    sample = sample.cache()
    try:
        n = sample.count()
        if not n:
            return [Measured(r.name, 0.0, 0.0) for r in rules]
        times = -(-EVALUATIONS // n)
        asked = sample.withColumn("_q_i", F.explode(F.sequence(F.lit(1), F.lit(times))))

        def timed(sql: str) -> tuple[float, int]:
            best, hits = None, 0
            for _ in range(TIMINGS):  # the first compiles
                began = time.perf_counter()
                hits = asked.agg(F.sum(F.expr(f"cast(({ask(sql)}) as int)"))).head()[0] or 0
                took = time.perf_counter() - began
                best = took if best is None else min(best, took)
            return best, hits

        nothing, _ = timed("_q_i < 0" if prepare else "n < 0")
        found = []
        for r in rules:
            took, hits = timed(r.rejects)
            found.append(Measured(r.name, max(took - nothing, 0.0) / (n * times), hits / (n * times)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda m: -m.gain)


def _of_struct(sql: str) -> str:
    """sql over t, w, n, b as one over a struct x of them."""
    for name in "bnwt":
        sql = _let(name, f"x.{name}", sql)
    return sql


def _cascade(rules, order: list[str]) -> str:
    """The first rule, in the order, that rejects: CASE asks no rule after it."""
    by = {r.name: r.rejects for r in rules}
    return "case " + " ".join(f"when {by[x]} then '{x}'" for x in order) + " end" if order else "cast(null as string)"


def _verdict(docs: DataFrame, rules, order: list[str] | None) -> str:
    return _bound(_cascade(rules, order if order is not None else [m.name for m in measure(docs, rules)]))


def apply_rules(docs: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """docs and `rejected_by`: the first rule, in cascade order, that rejects the row, else null."""
    return docs.withColumn("rejected_by", F.expr(_verdict(docs, rules, order)))


def passing(docs: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects; columns of any name pass."""
    return docs.filter(F.expr(f"{_verdict(docs, rules, order)} is null"))


def figures(docs: DataFrame) -> DataFrame:
    """Per row the base figures, the text and its number of lines."""
    lines = _let("l", LINES, "struct(size(l) as lines, size(l) - size(array_distinct(l)) as dup)")
    all_of = f"struct(t, n, length(array_join(w, '')) as chars, regexp_count(t, '[#*$%&|<>]') as symbols, {lines} as l, {REPEATED} as again)"
    out = docs.select("doc_id", F.expr(_bound(all_of)).alias("_q"))
    return out.select(
        "doc_id", F.col("_q.n").cast("long").alias("n_words"), F.col("_q.chars").cast("long").alias("word_chars"),
        F.col("_q.symbols").cast("long").alias("n_symbols"), F.col("_q.l.dup").cast("long").alias("n_dup_lines"),
        F.col("_q.again").cast("long").alias("n_repeat_words"), F.col("_q.t").alias("_q_t"), F.col("_q.l.lines").alias("_q_lines"),
    )


FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per row: the base figures and the verdict. Rows that fail the base are not asked further; the others meet the rest of
    the rules, in the form that uses the figures, measured in that form."""
    order = order if order is not None else [m.name for m in measure(docs, KNOWN, lambda d: figures(d).filter(f"not ({FAILED})"))]
    verdict = F.when(F.expr(FAILED), "base").otherwise(F.expr(_cascade(KNOWN, order)))
    return figures(docs).withColumn("base_failed", F.expr(FAILED)).withColumn("kept", verdict.isNull()).drop("_q_t", "_q_lines")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
l as (
  select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select rid, i from g qualify count(*) over (partition by rid, g) > 1),
c as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from r) group by rid),
m as (
  select d.doc_id, d.t, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from d join l using (rid) left join c using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or 10 * len(regexp_extract_all(t, '!!')) > n_words
            or word_chars not between 2 * n_words and 15 * n_words or 100 * n_dup_lines > 50 * n_lines) as kept
from f
"""
