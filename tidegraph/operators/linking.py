"""Free-text mentions onto canonical names: exact by normal form, else by the closest match."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shipping import ship
from ..functions.text import normalize_name
from ..plans.tables import kept

ship(__name__)

CUTOFF = 0.8


def normal_forms(known: DataFrame, name: str = "name", order: str = "ord", normalize: Callable[[Column], Column] = normalize_name) -> DataFrame:
    """(form, original, place): of names with one form the last spelling, at the place of the first."""
    out = known.select(normalize(F.col(name)).alias("form"), F.col(name).alias("original"), F.col(order).alias("ord"))
    return out.groupBy("form").agg(F.max_by("original", "ord").alias("original"), F.min("ord").alias("place"))


def link(mentions: DataFrame, known: DataFrame, mention: str = "mention", name: str = "name", order: str = "ord", fuzzy: bool = True, normalize: Callable[[Column], Column] = normalize_name) -> DataFrame:
    """mentions and `linked`, the canonical name or null. Only distinct mentions without an exact match are compared.

    Names go to the workers SLICE at a time; the best of all slices counts.
    """
    forms = normal_forms(known, name, order, normalize)
    keyed = mentions.withColumn("_form", normalize(F.col(mention)))
    exact = keyed.join(forms.select(F.col("form").alias("_form"), F.col("original").alias("_exact")), "_form", "left")
    if not fuzzy:
        return exact.withColumn("linked", F.when(F.col("_form") != "", F.col("_exact"))).drop("_form", "_exact")
    open_forms = exact.filter("_exact is null and _form is not null and _form != ''").select("_form").distinct()
    open_forms = open_forms.repartition(TASKS, "_form")  # few and short, but each takes long
    slices, near = -(-forms.count() // SLICE), None
    for k in range(slices):  # so many names at a time are compared with all open forms
        some = [r["form"] for r in forms.filter(F.pmod(F.xxhash64("form"), F.lit(slices)) == k).select("form").collect()]
        found = open_forms.withColumn("x", _closest(some)("_form")).filter("x.form is not null")
        near = found if near is None else near.unionByName(found)
    if near is None:
        return exact.withColumn("linked", F.when(F.col("_form") != "", F.col("_exact"))).drop("_form", "_exact")
    best = near.groupBy("_form").agg(F.max("x")["form"].alias("form")).join(forms.select("form", F.col("original").alias("_near")), "form").drop("form")
    out = exact.join(best, "_form", "left")
    return out.withColumn("linked", F.when(F.col("_form") != "", F.coalesce("_exact", "_near"))).drop("_form", "_exact", "_near")


#: Names that go to the workers at a time, and tasks that compare.
SLICE, TASKS = 20_000, 64


def _closest(names: list[str]):
    """forms -> (ratio, form) of the closest name, of equally close ones the greatest."""
    cutoff = CUTOFF

    @F.pandas_udf("ratio double, form string")
    def of(forms: pd.Series) -> pd.DataFrame:
        import difflib

        import numpy as np

        def counts(text: str):
            return np.bincount(np.array([ord(c) % 64 for c in text], np.int64), minlength=64).astype(np.int32)

        all_counts, lengths = np.array([counts(n) for n in names]), np.array([len(n) for n in names])
        rows = []
        for form in forms:
            # characters in common bound the ratio from above; the most promising names come first, and what can't reach the best is left out
            bound = 2.0 * np.minimum(all_counts, counts(form)).sum(axis=1) / (lengths + len(form))
            may = np.flatnonzero(bound >= cutoff)
            best, match = (None, None), difflib.SequenceMatcher()
            match.set_seq2(form)
            for i in may[np.argsort(-bound[may], kind="stable")]:
                if best[0] is not None and bound[i] < best[0]:
                    break
                match.set_seq1(names[i])
                ratio = match.ratio()
                if ratio >= cutoff and (best[0] is None or (ratio, names[i]) > best):
                    best = ratio, names[i]
            rows.append(best)
        return pd.DataFrame(rows, columns=["ratio", "form"])

    # else a filter on what it gives goes below the distinct, and every mention is compared
    return of.asNondeterministic()


def link_entity(name: str, known: list[str], spark, fuzzy: bool = True) -> str | None:
    """One mention against a list of names."""
    mentions = spark.createDataFrame([(name,)], "mention string")
    table = spark.createDataFrame([(i, n) for i, n in enumerate(known)], "ord long, name string")
    return link(mentions, table, fuzzy=fuzzy).head()["linked"]


def case_charges(cases: DataFrame, known: DataFrame, case: str = "case_id", charges: str = "charges", fuzzy: bool = True) -> DataFrame:
    """(case, charges): sorted distinct linked charges; those that link to nothing go."""
    each = cases.select(case, F.explode(charges).alias("mention"))
    linked = link(each, known, fuzzy=fuzzy).groupBy(case).agg(F.sort_array(F.collect_set("linked")).alias("charges"))
    return cases.select(case).join(linked, case, "left").select(case, F.coalesce("charges", F.array().cast("array<string>")).alias("charges"))


def link_cases(docs: DataFrame, known: DataFrame, fuzzy: bool = True) -> DataFrame:
    """docs (id, cases): of each case the charges become sorted distinct names, unknown ones go; each person's charge becomes its name or empty.

    Every different mention is linked once; if these are few they are one map for all documents, else what a document's mentions link
    to comes back to it as a map of its own.
    """
    none = F.array().cast("array<string>")
    of_people = lambda c: F.transform(F.coalesce(c["people"], F.array()), lambda p: F.coalesce(p["charge"], F.lit("")))
    named = F.flatten(F.transform("cases", lambda c: F.concat(F.coalesce(c["charges"], none), of_people(c))))
    each = docs.select(F.col("id").alias("_id"), F.explode(F.array_distinct(named)).alias("mention")).filter("mention is not null and mention != ''")
    linked = kept(link(each.select("mention").distinct(), known, fuzzy=fuzzy).filter("linked is not null").select("mention", "linked"))
    some = linked.limit(FEW + 1).collect()
    if len(some) <= FEW:  # one map serves all documents, which then stay where they lie
        found = docs.withColumn("_map", F.create_map(*[F.lit(x) for r in some for x in (r["mention"], r["linked"])]).cast("map<string,string>"))
    else:
        maps = each.distinct().join(linked, "mention").groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("mention", "linked"))).alias("_map"))
        found = docs.join(maps, docs["id"] == maps["_id"], "left").drop("_id")
    name = lambda m: F.element_at(F.coalesce("_map", F.create_map().cast("map<string,string>")), m)
    charges = lambda c: F.sort_array(F.array_distinct(F.filter(F.transform(F.coalesce(c["charges"], none), name), lambda x: x.isNotNull())))
    people = lambda c: F.transform(c["people"], lambda p: p.withField("charge", F.coalesce(name(p["charge"]), F.lit(""))))
    return found.withColumn("cases", F.transform("cases", lambda c: c.withField("charges", charges(c)).withField("people", people(c)))).drop("_map")


#: So many different mentions that link to a name go with every document as one map.
FEW = 100


def ordered_distinct(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, values): each value once, at its first place."""
    first = df.groupBy(by, value).agg(F.min(order).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_o"))
    return first.withColumn("place", rank).drop("_o")
