"""URL filters: rules where one fits, else host word segmentation and naive Bayes.

A rule names a host and the start of a path; it fits the host and all subdomains, and the longest that fits decides.
URLs that no rule fits are judged by a model trained here. Host labels and path parts are cut into words by a unigram
Viterbi search: word counts come from the titles of all pages, a word of c occurrences costs -log(c / total), an unknown
stretch of n letters is charged as one word of probability 10 / (total * 10^n). Multinomial naive Bayes with add-one
smoothing scores the words; it learns from the URLs that rules have judged, all of them, counted by Spark. Without a
judged URL of each class, or at equal scores, the verdict is allow.

Sizes: the vocabulary is the most frequent words, the token table the most frequent tokens, in whole classes of equal counts, at
most WORDS and TOKENS of them; both are parameters of the model and bound what is shipped. Counts cover all rows.

Cases: a null URL or one without `://` has empty host and path; other characters stay as they are; very long hosts are
segmented in time linear in their length (times that of the longest word known); repeated rows are each judged; an empty table gives none;
other columns pass through `judge` (names host, path, rule, verdict are taken).
"""

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, kept_by_worker, ship, table

ship(__name__)
#: (rule, verdict): host, then the start of the path from its first slash.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: UNKNOWN: letters that one unknown word may have, where no known word is longer.
WORDS, TOKENS, UNKNOWN = 50_000, 50_000, 24


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return ascii_lower(rest[0]), rest[1]


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages, host, path and rule, the longest that fits."""
    host, path = parts(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, start = rule.split("/", 1)
        fits = ((F.col("host") == name) | F.endswith("host", F.lit(f".{name}"))) & F.startswith("path", F.lit("/" + start))
        found = F.when(fits, rule).otherwise(found)
    return out.withColumn("rule", found)


def _frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of counts with the largest n, as many whole classes of equal n as make at most `most` rows: told by the sizes of
    the classes, so that no task sends more than its share of them."""
    sizes = sorted(((r["n"], r["rows"]) for r in counts.groupBy(F.col(n).alias("n")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for value, rows in sizes:
        if total + rows > most:
            break
        least, total = value, total + rows
    return counts.filter(F.col(n) >= least) if least is not None else counts.limit(0)


def word_counts(pages: DataFrame, words: int = WORDS) -> tuple[dict[str, int], int]:
    """The most frequent words of all titles, and the number of all words."""
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>([^<]*)", 1))
    each = pages.select(F.explode(F.split(title, r"(?U)[^\p{L}]+")).alias("w")).filter("w != ''").groupBy("w").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n")).head()[0] or 0
    return {r["w"]: r["n"] for r in _frequent(each, "n", words).collect()}, total


class Segmenter:
    def __init__(self, counts: dict[str, int], total: int) -> None:
        total = max(total, 1)
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max([UNKNOWN, *map(len, counts)])
        self.unknown = [0.0] + [math.log(total) - math.log(10) + n * math.log(10) for n in range(1, self.longest + 1)]

    def words(self, text: str) -> list[str]:
        """The cheapest cut of one run of letters; of equally cheap ones, that with the longest last words."""
        cost, unknown, best, back = self.cost, self.unknown, [0.0], [0]
        for end in range(1, len(text) + 1):
            least, at = math.inf, end - 1
            for begin in range(max(0, end - self.longest), end):
                c = best[begin] + cost.get(text[begin:end], unknown[end - begin])
                if c < least:
                    least, at = c, begin
            best.append(least)
            back.append(at)
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        import re

        out = []
        for mark, text in (("h", host), ("p", path.lower())):
            for piece in re.findall(r"[^\W\d_]+|\d+", text):
                out += [mark + w for w in ([piece] if piece[0].isdigit() else self.words(piece))]
        return out


def _tokens(spark: SparkSession, model) -> "callable":
    key_of_model = f"urls-{uuid.uuid4().hex}"

    @F.pandas_udf("array<string>")
    def of(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cut = kept_by_worker(key_of_model, lambda: Segmenter(*model.value))
        kept: dict[tuple[str, str], list[str]] = {}
        for hosts, paths in rows:
            out = []
            for key in zip(hosts, paths):
                if key not in kept:
                    if len(kept) > 100_000:
                        kept.clear()
                    kept[key] = cut.tokens(*key)
                out.append(kept[key])
            yield pd.Series(out)

    return of


def train(judged: DataFrame, tokens: int = TOKENS) -> tuple[dict[str, tuple[int, int]], tuple[int, int], tuple[int, int]]:
    """judged: (verdict, tokens). Counts (allow, block) of tokens, of all tokens and of URLs."""
    is_block = F.col("verdict") == "block"
    docs = judged.agg(F.sum((~is_block).cast("long")), F.sum(is_block.cast("long"))).head()
    each = judged.select(is_block.alias("b"), F.explode("tokens").alias("t")).groupBy("t").agg(F.sum((~F.col("b")).cast("long")).alias("a"), F.sum(F.col("b").cast("long")).alias("b"))
    sums = each.agg(F.sum("a"), F.sum("b")).head()
    kept = _frequent(each.withColumn("n", F.col("a") + F.col("b")), "n", tokens).collect()
    return {r["t"]: (r["a"], r["b"]) for r in kept}, (sums[0] or 0, sums[1] or 0), (docs[0] or 0, docs[1] or 0)


def score(tokens: list[str], counts: dict, sums: tuple[int, int], docs: tuple[int, int]) -> float:
    """Log odds of block against allow; tokens never seen in training say nothing."""
    if not docs[0] or not docs[1]:
        return 0.0
    size, total = len(counts), math.log(docs[1] / docs[0])
    for t in tokens:
        if t in counts:
            a, b = counts[t]
            total += math.log((b + 1) / (sums[1] + size)) - math.log((a + 1) / (sums[0] + size))
    return total


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (with url and html), host, path, rule and verdict."""
    spark = pages.sparkSession
    ruled = with_rules(pages.drop("html"), rules)
    verdict = F.create_map(*[F.lit(x) for r in rules for x in r])[F.col("rule")] if rules else F.lit(None).cast("string")
    words = spark.sparkContext.broadcast(word_counts(pages))
    cut = _tokens(spark, words)
    model = spark.sparkContext.broadcast(train(ruled.filter("rule is not null").select(verdict.alias("verdict"), cut("host", "path").alias("tokens"))))

    @F.pandas_udf("boolean")
    def blocks(rows: pd.Series) -> pd.Series:
        return pd.Series([score(list(t), *model.value) > 0 for t in rows])

    out = ruled.withColumn("_u_block", blocks(cut("host", "path")))
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("_u_block"), "block").otherwise("allow"))).drop("_u_block")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
