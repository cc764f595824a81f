"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits: bit i is set if more than half of a text's shingle hashes have it. Two that differ in at
most RADIUS = 3 bits differ in at most one bit in one of their two 32-bit halves. In a half, the anchors are the
codewords of the perfect Hamming code of 31 bits (each word has exactly one codeword within the covering radius 1),
taken with the last bit as it is. Each fingerprint is at home at its nearest anchor and is replicated to every other
anchor that lies within the covering radius plus the threshold left to the half (1 + 1): 17 in all for each half.
Whoever is within one bit of a fingerprint in the half is replicated to that fingerprint's home, so no link is lost;
comparison is per anchor, between those at home and the replicas, on all 64 bits.

A dense group of near copies would still be compared pair by pair, so the links of up to two bits are first made
through hubs: two fingerprints differ in at most two bits exactly if some word is within one bit of both. Each
fingerprint names its 65 words, and members of a word link to the least one: a group costs its size, not its square.
(All words are the anchors of that covering, its radius is 0, and half the threshold is left to either side.) The anchors
of halves then give only links between different components of that graph: an anchor that knows one component is left
out, and a crowded one is split by the same covering over the quarters of the other half.

Components are found by hooking and pointer jumping over (node, least neighbour) tables, written to the shared folder
each round. Nothing is collected; equal fingerprints are one node.

Cases: a null or wordless text has fingerprint zero, which links like any other; fewer words than a shingle make one
shingle; ties (bit set in exactly half) give 0; repeated rows keep one component; a null doc_id is never the least
unless all are null; an empty table gives none; other columns pass through `keep_one` (names starting with `_s_` are
taken).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SHIPPED, apart, discard, forget, materialise, ship, table
from .similar import OUT, Sketcher, common_shingles, shingle_hashes, similar

ship(__name__)

RADIUS, SHINGLE = 3, 3
#: Members of an anchor beyond which it is split by a covering of the other half.
CROWD = 256
#: Shingles hashed and summed at a time, so that a very long text takes bounded memory.
BATCH = 1 << 13


def fingerprint_of(hashes: np.ndarray) -> int:
    """Of the hashes of a text's shingles."""
    total, n = np.zeros(64, np.int64), len(hashes)
    for k in range(0, n, BATCH):
        h = np.ascontiguousarray(hashes[k : k + BATCH], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a text in UTF-8; without words, zero."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with `_s_fp`, the fingerprint as a signed 64-bit integer; the text goes. Texts are taken one by one."""
    rest = docs.drop("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], "_s_fp"])

    schema = T.StructType([*rest.schema.fields, T.StructField("_s_fp", T.LongType())])
    return docs.select(*[F.col(f"`{c}`") for c in rest.columns], "text").mapInArrow(of, schema)


def _anchors(x: str, width: int) -> str:
    """SQL over x, a word of `width` bits (a power of two): its anchors as structs (home, at), the home first, then those one step further.

    Anchors are the codewords of the Hamming code of width - 1 bits, with the last bit as it is. Its parity check's column for bit i
    is i + 1, so the syndrome of a word is the XOR of those of its set bits.
    """
    n = width - 1
    checks = [sum(1 << i for i in range(n) if (i + 1) >> k & 1) for k in range(n.bit_length())]
    low = f"({x} & {(1 << n) - 1}L)"
    syndrome = " + ".join(f"shiftleft(cast(bit_count({low} & {m}L) & 1 as int), {k})" for k, m in enumerate(checks))
    fix = "(a.x ^ if(a.s = 0, 0L, shiftleft(1L, a.s - 1)))"
    # codewords two bits away: bits i and j whose columns XOR to the syndrome, other than the home's own bit
    two = f"transform(filter(sequence(1, {n}), i -> a.s != 0 and i < (i ^ a.s) and i != a.s), i -> struct(false as home, a.x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ a.s) - 1) as at))"
    home = f"array(struct(true as home, {fix} as at), struct(false as home, {fix} ^ {1 << n}L as at))"
    return f"transform(array(struct({x} as x, {syndrome} as s)), a -> concat({home}, {two}))[0]"


def _part(x: str, k: int, width: int) -> str:
    """SQL of the k-th word of `width` bits in x."""
    return f"(shiftrightunsigned({x}, {k * width}) & {(1 << width) - 1}L)"


def _links(members: DataFrame) -> DataFrame:
    """(a, b): roots of members (fp, root) with fingerprints of at most RADIUS differing bits under one anchor, where roots differ.

    Anchors whose members all have one root, as those of a dense group have, are left out whole. Where more than CROWD meet, they are
    told apart by the other half: as it differs in at most RADIUS bits, one of its two quarters differs in at most one, so the same
    covering over a quarter loses no link and splits the anchor into some thousand.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_half = ", ".join(f"transform({_anchors(_part('fp', h, 32), 32)}, y -> struct({h} as half, y.home as home, y.at as at))" for h in (0, 1))
    spread = members.repartition(parts, "fp").select("fp", "root", F.explode(F.expr(f"concat({of_half})")).alias("x")).select("fp", "root", "x.half", "x.home", "x.at")
    cell = Window.partitionBy("half", "at")
    mixed = spread.withColumn("least", F.min("root").over(cell)).withColumn("most", F.max("root").over(cell)).withColumn("n", F.count("*").over(cell))
    mixed = materialise(mixed.filter("least != most").drop("least", "most"), "simhash-anchors")
    calm = mixed.filter(f"n <= {CROWD}").select("fp", "root", "half", "at", "home", F.lit(-1).alias("quarter"), F.lit(0).cast("long").alias("sub"))
    of_quarter = ", ".join(f"transform({_anchors(_part('other', q, 16), 16)}, y -> struct({q} as quarter, y.home as home, y.at as at))" for q in (0, 1))
    full = mixed.filter(f"n > {CROWD}").withColumn("other", F.expr(f"if(half = 0, {_part('fp', 1, 32)}, {_part('fp', 0, 32)})"))
    full = full.select("fp", "root", "half", "at", "home", F.explode(F.expr(f"concat({of_quarter})")).alias("y"))
    full = full.select("fp", "root", "half", "at", F.expr("home and y.home").alias("home"), "y.quarter", F.col("y.at").alias("sub"))
    every, by = calm.unionByName(full), ["half", "at", "quarter", "sub"]
    rows = mixed.agg(F.sum(F.expr(f"if(n <= {CROWD}, 1, 18)")).alias("rows")).head()["rows"] or 0  # a quarter has 9 anchors at most
    home = every.filter("home").select(*by, F.col("fp").alias("a"), F.col("root").alias("ra"))
    there = every.select(*by, F.col("fp").alias("b"), F.col("root").alias("rb"))
    links = home.join(apart(there, rows), by).filter(f"ra != rb and bit_count(a ^ b) <= {RADIUS}")
    return links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _components(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(fp, root): the least fingerprint of each node's component. edges: (a, b), each once, in any direction.

    Large-star and small-star rounds: each keeps the components, makes no rows more, and shows whether all are stars already. What a
    round has read is deleted; up to SHIPPED rows are not told apart again, which would deal them out once more.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), f"{name}-edges")
    rows = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most")), f"{name}-low")
        if low.filter("m < a and m != most").isEmpty():  # each is the least of all it meets, or meets one, that is less
            break
        large = edges.join(apart(low.select(F.col("a").alias("b"), F.least("a", "m").alias("m")), 2 * rows), "b").select("a", F.col("m").alias("b"))
        large = materialise(large, f"{name}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(least, rows), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b")
        small = materialise(small if rows <= SHIPPED else small.distinct(), f"{name}-small")
        discard(edges, low, large)
        edges = small
    discard(edges)
    tops = low.filter("m < a").select(F.col("a").alias("fp"), F.col("m").alias("root"))
    return nodes.join(apart(tops, rows), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(prints: DataFrame) -> DataFrame:
    """(fp, root) of each distinct value of the column fp."""
    nodes = materialise(prints.select("fp").distinct(), "simhash-nodes")
    parts, rows = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count()
    nodes = nodes.repartition(parts, "fp")  # few bytes, that become 65 times as many
    words = nodes.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word"))
    hubs = words.groupBy("word").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b < most").drop("most")
    # only members of shared words go on: few, unless there are many near copies
    near = words.join(apart(hubs, 65 * rows), "word").select(F.col("fp").alias("a"), "b").filter("a != b")
    first = materialise(_components(nodes, near, "simhash-two"), "simhash-first")
    joined = _components(first.select(F.col("root").alias("fp")).distinct(), _links(first), "simhash-three")
    return first.join(apart(joined.select(F.col("fp").alias("root"), F.col("root").alias("top")), rows), "root").select("fp", F.col("top").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without text, `_s_fp`, `_s_root` (a name of the component) and `_s_component`: the least doc_id reachable over links of RADIUS bits."""
    prints = materialise(fingerprints(docs, shingle), "simhash-prints")
    tops = components(prints.select(F.col("_s_fp").alias("fp")))
    # ids of equal fingerprints meet first, then those of a component
    least = prints.groupBy("_s_fp").agg(F.min("doc_id").alias("id")).withColumnRenamed("_s_fp", "fp")
    rows = prints.count()
    least = tops.join(apart(least, rows), "fp")
    of_top = least.groupBy("root").agg(F.min("id").alias("_s_component"))
    named = materialise(tops.join(apart(of_top, rows), "root").select(F.col("fp").alias("_s_fp"), F.col("root").alias("_s_root"), "_s_component"), "simhash-named")
    return prints.join(apart(named, named.count()), "_s_fp")


def _sketches(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """docs (doc_id, t, text): (doc_id, t, _s_fp) of each row and, in the first row of each t in a task, its sketch (see `similar`)."""
    spark = docs.sparkSession
    often = common_shingles(docs.select("t", "text"), shingle).toArrow().sort_by("token")
    known = spark.sparkContext.broadcast((often["token"].to_numpy(), often["n"].to_numpy()))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sketch, prints = Sketcher(*known.value, similarity), {}
        names = ["doc_id", "t", "_s_fp", "n", "bits", "short", "rare", "prefix"]
        kinds = [None, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            kinds[0], out, size = batch.schema.types[0], [], 0
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if t in prints:
                    out.append((d, t, prints[t], None, None, None, None, None))
                else:
                    hashes = shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle)
                    if len(prints) > 1 << 16:
                        prints.clear()
                    prints[t] = fingerprint_of(hashes)
                    n, bits, short, rare, prefix = sketch(hashes)
                    out.append((d, t, prints[t], n, bits, short, rare, prefix))
                    size += len(bits) + 8 * len(prefix)
                if size > OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, t long, _s_fp long, n int, bits binary, short array<long>, rare int, prefix array<long>"
    return docs.select("doc_id", "t", "text").mapInArrow(make, schema)


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """The rows of docs with the least (doc_id, hash of the text) of each component; a null doc_id comes last, and of rows that
    repeat both one stays.

    Components are those of fingerprints and, unless similarity is None, of texts at least so similar.
    """
    keyed = docs.withColumn("_s_t", F.xxhash64("text"))
    made = materialise(_sketches(keyed.select("doc_id", F.col("_s_t").alias("t"), "text"), shingle, similarity or 0.8), "simhash-sketches")
    tops = materialise(components(made.select(F.col("_s_fp").alias("fp"))), "simhash-tops")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    # the first row of each text, then of each fingerprint's component
    texts = materialise(made.groupBy("t", "_s_fp").agg(F.min(place).alias("x")).join(tops.withColumnRenamed("fp", "_s_fp"), "_s_fp").select("t", F.col("root").alias("g"), "x"), "simhash-texts")
    best = texts.groupBy("g").agg(F.min("x").alias("x"))
    if similarity is not None:
        # every different text goes on, with its component's name
        links = similar(made.filter("prefix is not null"), keyed.select(F.col("_s_t").alias("t"), "text"), texts.select("t", "g"), _components, shingle, similarity)
        tops = _components(best.select(F.col("g").alias("fp")), links, "simhash-components")
        best = best.join(tops, F.col("g") == F.col("fp")).groupBy("root").agg(F.min("x").alias("x"))
    best = materialise(best.select(F.col("x.none").alias("_s_none"), F.coalesce("x.doc_id", F.lit(0)).alias("_s_d"), F.col("x.t").alias("_s_u")), "simhash-best")
    same = keyed.withColumn("_s_none", F.col("doc_id").isNull()).withColumn("_s_d", F.coalesce("doc_id", F.lit(0))).withColumnRenamed("_s_t", "_s_u")
    kept = same.join(best, ["_s_none", "_s_d", "_s_u"], "left_semi")
    if not made.groupBy("doc_id", "t").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["_s_none", "_s_d", "_s_u"])
    return kept.drop("_s_none", "_s_d", "_s_u")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("_s_fp"), 16, "0")).alias("fingerprint"), F.col("_s_component").alias("component_id"))
