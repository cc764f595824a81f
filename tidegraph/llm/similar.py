"""Texts whose sets of word shingles have a Jaccard similarity of at least a threshold: exact, by prefix filtering.

Each text becomes a sketch: the number of its different shingles, the first members of its set in one order for all sets
(rare ones first, ties by hash), and a bitmap of parities, bit i telling whether an odd number of its hashes end in i.
Two sets of similarity s share one of their first members, so sets meet by these; what sizes and places of the shared
member rule out goes no further. Two bitmaps, folded to the shorter, differ in no more bits than the sets differ in
members, which rules out nearly all that is left without a look at the sets. Only then are texts fetched and their sets compared.

Groups that are joined already (texts of one group) are not compared again: where many meet, one of each size class is
compared with the others first, and the rest only across the components that this makes. Nothing is capped. Which shingles
count as rare is told by a sample; a wrong guess costs time, no pair.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, discard, fits_broadcast, forget, materialise, ship

ship(__name__)

#: One in SAMPLE different texts tells which shingles are common: the COMMON most frequent of those seen more than SEEN times.
SAMPLE, COMMON, SEEN = 16, 1 << 18, 3
#: Bytes of a batch that goes back to the JVM; ids of texts to fetch that are broadcast.
OUT, ASKED = 1 << 21, 1_000_000
_WORDS = 1 << 16
#: Pairs for each row that may be left when the rounds end in which one text of each size class is compared with the others.
FEW = 8
#: Words of 64 bits of the short bitmap that travels with each first member.
SHORT = 4
_SHORT = [f"s{i}" for i in range(SHORT)]


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included: words are split at the six ASCII spaces, A-Z lower-cased; fewer words are one shingle."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    out = np.empty(n, np.uint64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _WORDS):  # in stretches, so that a very long text takes bounded memory
        some = words[k : k + _WORDS + shingle - 1]
        line = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1]).tolist()
        ends = ends[min(shingle, len(some)) - 1 :].tolist()
        out[k : k + len(ends)] = [digest(line[a:b], 42) for a, b in zip(begins, ends)]
    return out


def parities(members: np.ndarray) -> bytes:
    """The bitmap of a set: the next power of two of twice its size in bits, 64 at least."""
    bits = max(64, 1 << (2 * len(members) - 1).bit_length())
    return np.packbits(np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def short_parities(members: np.ndarray) -> np.ndarray:
    """The bitmap of a set in SHORT words."""
    return np.packbits(np.bincount((members % np.uint64(64 * SHORT)).astype(np.int64), minlength=64 * SHORT) & 1, bitorder="little").view("<i8")


def differ(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer folded to the shorter: at most the members that only one set has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """Of a set of n: how many of its first members, in any one order for all sets, hold one that is shared with each set at
    least so similar; and how many if the other set is no smaller and shows the members of the first number."""
    return n - math.ceil(similarity * n - 1e-9) + 1, n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1


def common_shingles(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (t, text): (token, n) of the frequent shingles of a sample of different texts, at most COMMON."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for text in batch.column(0):
                found = np.unique(shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["token"])

    some = docs.filter(F.expr(f"pmod(t, {SAMPLE}) = 0")).dropDuplicates(["t"]).select("text").mapInArrow(make, "token long")
    return some.groupBy("token").agg(F.count("*").alias("n")).filter(f"n > {SEEN}").orderBy(F.desc("n"), "token").limit(COMMON)


class Sketcher:
    """(members, bitmap, short bitmap, rare, prefix) of a text. tokens, counts: the common shingles, sorted, and how often they were seen."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, similarity: float) -> None:
        self.tokens, self.counts, self.similarity = tokens, counts, similarity

    def __call__(self, hashes: np.ndarray) -> tuple[int, bytes, np.ndarray, int, np.ndarray]:
        members = np.unique(hashes)
        if not len(members):
            return 0, b"", np.zeros(SHORT, np.int64), 0, np.zeros(0, np.int64)
        signed = members.view(np.int64)
        often = np.zeros(len(members), np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, signed), len(self.tokens) - 1)
            often = np.where(self.tokens[at] == signed, self.counts[at], 0)
        probe, _ = prefix_sizes(len(members), self.similarity)
        order = np.lexsort((signed, often))[:probe]
        return len(members), parities(members), short_parities(members), int((often[order] == 0).sum()), signed[order]


def _rows(sketches: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(token, t, pos, g, n, idx, s0, s1, ...) of the first members that more than one text has. groups (t, g, n, s0, s1, ...)."""
    each = sketches.select("t", "rare", F.posexplode("prefix").alias("pos", "token")).select("token", "t", "pos", (F.col("pos") < F.col("rare")).alias("rare"))
    cols = ["token", "t", "pos"]
    by = Window.partitionBy("token")  # few rows each: what is frequent is known to be shared and does not pass here
    rare = each.filter("rare").select(*cols).withColumn("lo", F.min("t").over(by)).withColumn("hi", F.max("t").over(by)).filter("lo != hi")
    shared = rare.select(*cols).unionByName(each.filter("not rare").select(*cols)).dropDuplicates(["token", "t"])
    idx = F.expr(f"pos < n - ceil({2 * similarity / (1 + similarity)!r}D * n - 1e-9D) + 1").alias("idx")
    return shared.join(groups, "t").select(*cols, "g", "n", idx, *_SHORT)


def _mixed(rows: DataFrame) -> DataFrame:
    """rows whose token is in more than one group; counted before rows meet, so that no token gathers in a task."""
    shared = rows.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo != hi").select("token")
    return rows.join(shared, "token")


def _may_meet(left: DataFrame, right: DataFrame, keys: list[str], similarity: float, also: str) -> DataFrame:
    """Pairs (a, b) of different groups, (ga, gb), that share a token, whose sizes and places of it allow the similarity."""
    x = left.select(*keys, *[F.col(c).alias(f"{c}1") for c in ("t", "g", "n", "pos", "idx", *_SHORT)])
    y = right.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("t", "g", "n", "pos", "idx", *_SHORT)])
    near = f"least(n1, n2) >= {similarity}D * greatest(n1, n2) - 1e-6D"
    # a shared member, those before it in both, those after it in both: all that can be shared
    room = f"1 + least(pos1, pos2) + least(n1 - pos1, n2 - pos2) - 1 >= {similarity}D / (1 + {similarity}D) * (n1 + n2) - 1e-6D"
    bits = " + ".join(f"bit_count({c}1 ^ {c}2)" for c in _SHORT)
    near += f" and {bits} <= {(1 - similarity) / (1 + similarity)!r}D * (n1 + n2) + 1e-6D"
    found = x.join(y, keys).filter(f"g1 != g2 and {near} and {room} and {also}")
    return found.selectExpr("least(t1, t2) as a", "greatest(t1, t2) as b", "if(t1 < t2, g1, g2) as ga", "if(t1 < t2, g2, g1) as gb").distinct()


def _asked(df: DataFrame, pairs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A row of df, as a table, for each id t in pairs; these are broadcast where there are at most ASKED."""
    asked = materialise(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct(), "similar-asked")
    own = materialise(df.join(F.broadcast(asked) if fits_broadcast(asked, ASKED) else asked, "t", "left_semi").select(*columns).dropDuplicates(["t"]), name)
    discard(asked)
    return own


def _weight(df: DataFrame, name: str) -> int:
    """How many rows of 64 bytes, as `apart` counts them, the rows of df, a table, with a column of that name make up."""
    found = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(name)).alias("size")).head()
    return found["n"] + (found["size"] or 0) // 64


def _alike(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b), of groups, of the pairs (a, b, ga, gb) whose sets are at least so similar."""

    def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = batch.column(4).to_pylist(), batch.column(6).to_pylist()
            keep = [
                differ(x.as_buffer(), y.as_buffer()) <= (1 - similarity) / (1 + similarity) * (p + q) + 1e-6
                for x, p, y, q in zip(batch.column(5), n1, batch.column(7), n2)
            ]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:4]], names=["a", "b", "ga", "gb"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # of the side that comes sorted

        def members(t: int, text: pa.Scalar) -> np.ndarray:
            if t not in held:
                if sum(map(len, held.values())) > 1 << 20:
                    held.clear()
                held[t] = np.unique(shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle))
            return held[t]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), batch.column(5)):
                p, q = members(a, x), members(b, y)
                met = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(met + 1e-9 >= similarity * (len(p) + len(q) - met))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[2:4]], names=["a", "b"])

    pairs = materialise(pairs, "similar-pairs")
    # near copies pack so well in files that the planner would broadcast many times the bytes it reckons with
    bits = _asked(sketches, pairs, ["t", "n", "bits"], "similar-bits")
    rows = _weight(bits, "bits")
    left, right = (apart(bits.select(F.col("t").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")), rows) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb", "na", "bitsa", "nb", "bitsb")
    near = materialise(both.mapInArrow(room, "a long, b long, ga long, gb long"), "similar-near")
    own = _asked(texts, near, ["t", "text"], "similar-own")
    rows = _weight(own, "text")
    left, right = (apart(own.select(F.col("t").alias(k), F.col("text").alias(x)), rows) for k, x in (("a", "x"), ("b", "y")))
    full = near.join(left, "a").join(right, "b")
    found = materialise(full.select("a", "b", "ga", "gb", "x", "y").mapInArrow(same, "a long, b long"), "similar-found")
    discard(pairs, bits, near, own)
    return found


def similar(sketches: DataFrame, texts: DataFrame, groups: DataFrame, components, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of groups that, with what they chain, join all groups that have texts with sets at least so similar.

    sketches (t, n, bits, short, rare, prefix), at least one row for each t; texts (t, text), at least one row for each t; groups (t, g), one
    row for each t; components: (nodes, edges, name) -> (fp, root). No pair is left out but those whose groups are joined already.
    """
    short = [F.col("short")[i].alias(c) for i, c in enumerate(_SHORT)]
    sizes = groups.join(sketches.select("t", "n", *short).dropDuplicates(["t"]), "t")
    sizes = materialise(sizes, "similar-sizes")
    first = materialise(_rows(sketches, sizes, similarity), "similar-rows")
    rows = materialise(_mixed(first), "similar-tokens")
    discard(sizes, first)
    names = materialise(groups.select(F.col("g").alias("fp")).distinct(), "similar-groups")
    many = names.count()

    # each text with one other of its size class under each token, round by round others, while this leaves half the pairs or less;
    # links of later rounds are those of what earlier ones have joined, named by its least group
    links, rest, now, k = None, rows, math.inf, 0
    while True:
        banded = rest.withColumn("band", F.expr("cast(floor(ln(n) / ln(1.25D)) as int)")).withColumn("by", F.xxhash64("t", F.lit(k)))
        heads = banded.groupBy("token", "band").agg(F.min(F.struct("by", "t", "g", "n", "pos", "idx", *_SHORT)).alias("x")).select("token", "band", "x.*")
        found = _alike(_may_meet(banded, heads, ["token", "band"], similarity, "t1 != t2"), sketches, texts, shingle, similarity)
        links = found if links is None else links.union(found)
        tops = materialise(components(names, links, "similar-first").select(F.col("fp").alias("g"), "root"), "similar-tops")
        if k:
            discard(rest, sizes)
        rest = materialise(_mixed(rows.join(apart(tops, many), "g").drop("g").withColumnRenamed("root", "g")), "similar-rest")
        discard(tops)
        sizes = materialise(rest.groupBy("token", "g").agg(F.count("*").alias("c")), "similar-sizes")
        left = sizes.groupBy("token").agg(F.sum("c").alias("n"), F.max("c").alias("most")).agg(F.sum(F.expr("n * (n - most)")).alias("pairs"), F.sum("n").alias("rows")).head()
        before, now = now, left["pairs"] or 0
        if now <= FEW * (left["rows"] or 0) or 2 * now > before:
            break
        k += 1
    # of two in different groups at least one is not in the token's largest
    largest = sizes.groupBy("token").agg(F.max(F.struct("c", "g")).alias("x")).select("token", F.col("x.g").alias("most"))
    few = rest.join(largest, "token").filter("g != most").drop("most")
    return links.union(_alike(_may_meet(few, rest, ["token"], similarity, "if(n1 < n2 or (n1 = n2 and t1 < t2), idx1, idx2)"), sketches, texts, shingle, similarity))
