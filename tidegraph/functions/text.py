r"""Column functions over text.

Patterns carry (?U), for Unicode classes, and (?d), for \n as the only line end, where they use \s, \w, \b, ^ or $.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SUBSTANCES = ("Heroine", "Cocaine", "Methamphetamine", "Amphetamine", "MDMA", "XLR-11", "Ketamine", "cần sa", "thuốc phiện", "côca")
QUOTES = "\"'“”"
CRIME_PREFIX = "tội "
CRIME_TITLE = "Tội "
ALL_PENALTIES = ("tối đa", "cao nhất")
PREVENTION_LAW = ("luật phòng", "chống ma túy")
CLAUSE_HEAD = r"^\d+\.\s"
PENALTY = r"(?U)\bbị ((?:phạt|tù|cảnh cáo).+?)(?::|$)"
TWO_SUBSTANCES = "có 02 chất ma túy"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """White space of any kind off both ends. Only a text that begins or ends with some is searched through."""
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    cut = lambda t: F.when(F.rlike(ends(t), F.lit(r"(?U)\s")), F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")).otherwise(t)
    return F.transform(F.array(_c(x)), cut)[0]


def strip_chars(x: Column | str, chars: str) -> Column:
    return F.btrim(_c(x), F.lit(chars))


def collapse(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\s+", " ")


def normalize_name(x: Column | str, prefix: str = CRIME_PREFIX) -> Column:
    """Strip, strip quotes, lower, collapse white space, drop one prefix, strip; nothing between the quotes and the prefix."""
    low = collapse(F.lower(strip_chars(strip(x), QUOTES)))
    cut = F.when(F.startswith(low, F.lit(prefix)), F.substring(low, F.lit(len(prefix) + 1), F.length(low))).otherwise(low)
    return strip(cut)


def find_terms(x: Column | str, terms: Sequence[str] = SUBSTANCES) -> Column:
    """Terms that the text contains, whatever the case, in the order given; a term within another counts too."""
    low = F.lower(_c(x))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t)))


def drop_footnotes(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\[\d+\]", "")


def quantities(x: Column | str) -> Column:
    """Masses named in a text, as number and unit in one, with a decimal point: '1,5 kg' gives '1.5kg'."""
    found = F.regexp_extract_all(_c(x), F.lit(r"(?iuU)(\d+(?:[.,]\d+)?\s*(?:kg|gam)\b)"), F.lit(1))
    return F.transform(found, lambda q: F.replace(F.lower(F.regexp_replace(q, r"(?U)\s+", "")), F.lit(","), F.lit(".")))


def article_refs(x: Column | str, template: str = "Điều {} BLHS") -> Column:
    head, tail = template.split("{}")
    return F.transform(F.regexp_extract_all(_c(x), F.lit(r"(?U)[Đđ]iều\s+(\d+)"), F.lit(1)), lambda n: F.concat(F.lit(head), n, F.lit(tail)))


def asks_all_penalties(x: Column | str) -> Column:
    low = F.lower(_c(x))
    return F.contains(low, F.lit(ALL_PENALTIES[0])) | F.contains(low, F.lit(ALL_PENALTIES[1]))


def asks_prevention_law(x: Column | str) -> Column:
    low = F.lower(_c(x))
    return F.contains(low, F.lit(PREVENTION_LAW[0])) & F.contains(low, F.lit(PREVENTION_LAW[1]))


def segment_clauses(body: Column | str) -> Column:
    """Stretches that begin with a number, a full stop and white space at a line's start; what comes before is dropped."""
    pieces = F.split(_c(body), rf"(?mdU)(?={CLAUSE_HEAD})")
    return F.transform(F.filter(pieces, lambda p: F.rlike(p, F.lit(rf"(?U)\A{CLAUSE_HEAD[1:]}"))), strip)


def clause_number(clause: Column) -> Column:
    return F.regexp_extract(clause, r"(?U)\A(\d+)\.", 1).cast("int")


def penalty(clause: Column | str) -> Column:
    """The punishment that the first line names, without a closing full stop; empty if none."""
    line = F.regexp_extract(_c(clause), r"(?s)\A([^\n\r\x0B\f\x1C-\x1E\x85  ]*)", 1)
    return F.regexp_replace(F.regexp_extract(line, PENALTY, 1), r"\.+\z", "")


def relevant_paragraphs(text: Column | str, title: Column | str, terms: Column) -> Column:
    """Of an offence: the first paragraph and those that name a term or two substances, a line each; else the text."""
    parts = F.split(_c(text), r"(?U)\n\s*\n")
    chosen = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.exists(terms, lambda t: F.contains(F.lower(p), F.lower(t))) | F.contains(F.lower(p), F.lit(TWO_SUBSTANCES)))
    return F.when(F.startswith(_c(title), F.lit(CRIME_TITLE)), F.array_join(F.concat(F.slice(parts, 1, 1), chosen), "\n")).otherwise(_c(text))


def keyword_recall(answer: Column | str, keywords: Column | str) -> Column:
    """Share of keywords in the answer, whatever the case; null if there are none."""
    low = F.lower(_c(answer))
    return F.size(F.filter(_c(keywords), lambda k: F.contains(low, F.lower(k)))) / F.nullif(F.size(_c(keywords)), F.lit(0))


def strip_fences(x: Column | str) -> Column:
    """A text inside a fenced block, without the fences."""
    inner = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?s)\A```[^\n]*(?:\n|\z)", ""), r"(?s)\A(.*)```.*\z", "$1")
    return F.transform(F.array(strip(x)), lambda t: F.when(F.startswith(t, F.lit("```")), strip(inner(t))).otherwise(t))[0]


def slugify(x: Column | str) -> Column:
    slug = strip_chars(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "-"), "-")
    return F.when(slug == "", "document").otherwise(slug)


def yaml_value(x: Column | str) -> Column:
    """A quoted front-matter value."""
    escaped = F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def edge_fact(src_label: Column, src: Column, rel: Column, props: Column, dst_label: Column, dst: Column) -> Column:
    """(A: a) -[REL {k: v}]-> (B: b); empty properties are left out, the others go by key."""
    kept = F.array_sort(F.map_entries(F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != ""))))
    inner = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    braces = F.when(inner == "", "").otherwise(F.concat(F.lit(" {"), inner, F.lit("}")))
    return F.concat(F.lit("("), src_label, F.lit(": "), src, F.lit(") -["), rel, braces, F.lit("]-> ("), dst_label, F.lit(": "), dst, F.lit(")"))


def case_fact(doc_id: Column, name: Column, summary: Column) -> Column:
    return F.concat(F.lit("["), doc_id, F.lit("] Vụ việc '"), name, F.lit("': "), F.coalesce(summary, F.lit("None")))


def person_fact(doc_id: Column, name: Column, role: Column, sentence: Column, charge: Column, case: Column) -> Column:
    given = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    return F.concat(
        F.lit("["), doc_id, F.lit("] "), name, F.lit(": vai trò "), F.coalesce(role, F.lit("None")), F.lit("; mức án "), given(sentence, "chưa có trong nguồn"),
        F.lit("; tội danh "), given(charge, "chưa rõ"), F.lit("; vụ '"), case, F.lit("'."),
    )


def clause_fact(article: Column, title: Column, number: Column, text: Column) -> Column:
    return F.concat(F.lit("["), article, F.lit(" - "), title, F.lit("] khoản "), number.cast("string"), F.lit(": "), text)


def fill(template: str, **slots: Column) -> Column:
    """The template with a column in each of its slots, which are names in braces; other braces stay."""
    pieces = re.split(rf"\{{({'|'.join(slots)})\}}", template)
    return F.concat(*[slots[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces)])


def numbered(items: Column | str) -> Column:
    """'[1] first', blank line, '[2] second' and so on."""
    return F.array_join(F.transform(_c(items), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def budget(facts: Column | str, most: int = 60, chars: int = 9000) -> Column:
    """Facts in order, each once; one that would pass `chars` in all is skipped, and the rest go on until `most` are taken."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))
    take = lambda s, f: (F.size(s["out"]) < most) & (s["n"] + F.length(f) <= chars)
    step = lambda s, f: F.when(take(s, f), F.struct(F.concat(s["out"], F.array(f)).alias("out"), (s["n"] + F.length(f)).alias("n"))).otherwise(s)
    return F.aggregate(F.array_distinct(_c(facts)), empty, step, lambda s: s["out"])
