"""Embeddings, similarity and exact vector search."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship
from ..functions.text import _c
from ..plans.tables import in_order

ship(__name__)

# Fixed values that results depend on: the generator's constants and the models' names.
MULTIPLIER, INCREMENT, MASK = 1664525, 1013904223, 0xFFFFFFFF
LOCAL_EMBEDDING_MODEL = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"
OPENAI_EMBEDDING_MODEL = "text-embedding-3-small"
GEMINI_EMBEDDING_MODEL = "gemini-embedding-001"
EMBEDDING_PROVIDER_ENV = "EMBEDDING_PROVIDER"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Over the shorter of the two."""
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


class MockEmbedder:
    """A unit vector made from the text's MD5 by a linear congruential generator of 32 bits."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def raw(self, text: Column | str) -> Column:
        """Before it is brought to length 1. Only the digest's low 32 bits outlive the first step; after i steps the state is
        a_i * seed + c_i modulo 2^32, so the steps need not follow each other. The seed is halved, that no product passes 2^49."""
        seed = F.conv(F.right(F.md5(_c(text).cast("binary")), F.lit(8)), 16, 10).cast("long")
        a, c, steps = 1, 0, []
        for _ in range(self.dim):
            a, c = a * MULTIPLIER & MASK, (c * MULTIPLIER + INCREMENT) & MASK
            steps.append(F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")))
        mask, half = F.lit(MASK).cast("long"), F.lit(0xFFFF).cast("long")

        def state(s: Column, x: Column) -> Column:
            high = F.shiftleft((x["a"] * F.shiftright(s, 16)).bitwiseAND(half), 16)
            return (x["a"] * s.bitwiseAND(half) + high + x["c"]).bitwiseAND(mask) / F.lit(float(MASK)) * 2 - 1

        return F.transform(F.array(seed), lambda s: F.transform(F.array(*steps), lambda x: state(s, x)))[0]

    def __call__(self, text: Column | str) -> Column:
        def unit(v: Column) -> Column:
            norm = F.sqrt(_sum(F.transform(v, lambda x: x * x)))
            by = F.array(F.when(norm == 0, 1.0).otherwise(norm))  # once a vector, not once an element
            return F.transform(by, lambda n: F.transform(v, lambda x: x / n))[0]

        return F.transform(F.array(self.raw(text)), unit)[0]


class ModelEmbedder:
    """An embedder backed by a model: `load()` runs once in each worker and gives a function from texts to vectors."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> None:
        self.load = load

    def __call__(self, text: Column | str) -> Column:
        import pandas as pd

        load = self.load

        def embed(batches):
            model = load()
            for batch in batches:
                yield pd.Series([[float(x) for x in v] for v in model(batch.tolist())])

        from collections.abc import Iterator

        embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(embed, "array<double>")(_c(text))


def _sentence_transformer(name: str):
    def load():
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        return lambda texts: model.encode(texts, normalize_embeddings=True).tolist()

    return load


def _openai(name: str):
    def load():
        from openai import OpenAI

        client = OpenAI()
        return lambda texts: [x.embedding for x in client.embeddings.create(model=name, input=texts).data]

    return load


def _gemini(name: str):
    def load():
        import os

        from google import genai

        key = os.getenv("GEMINI_API_KEY") or os.getenv("GOOGLE_API_KEY")
        if not key:
            raise RuntimeError("GEMINI_API_KEY or GOOGLE_API_KEY must be set")
        client = genai.Client(api_key=key)
        return lambda texts: [client.models.embed_content(model=name, contents=t).embeddings[0].values for t in texts]

    return load


def LocalEmbedder(model_name: str = LOCAL_EMBEDDING_MODEL) -> ModelEmbedder:
    return ModelEmbedder(_sentence_transformer(model_name))


def OpenAIEmbedder(model_name: str = OPENAI_EMBEDDING_MODEL) -> ModelEmbedder:
    return ModelEmbedder(_openai(model_name))


def GeminiEmbedder(model_name: str = GEMINI_EMBEDDING_MODEL) -> ModelEmbedder:
    return ModelEmbedder(_gemini(model_name))


def top_k(items: DataFrame, query: Column, k: int, order: str = "seq") -> DataFrame:
    """The k items of largest dot product with one query vector; ties keep `order`."""
    if k < 0:
        raise ValueError("k must not be negative")
    return items.withColumn("score", dot("embedding", query)).orderBy(F.desc("score"), order).limit(k)


#: Queries that go to the workers at a time, and rows of a tile of scores.
QUERIES, TILE = 16_384, 2_048


def top_k_batch(items: DataFrame, queries: DataFrame, k: int, order: str = "seq", by: str = "query_id", blocks: int = 64) -> DataFrame:
    """queries (query_id, query): each query's k best items. The queries are a stated set and go to the workers QUERIES at a time;
    a task holds the k best rows of each query and passes on nothing else, so what is ranked at the end is k rows a query and task.
    Items are dealt over `blocks` tasks, with 0 blocks they stay where they lie."""
    if k < 0:
        raise ValueError("k must not be negative")
    dealt = items.repartition(blocks, order) if blocks else items
    asked = queries.select(by, F.col("query").cast("array<double>").alias("query"))
    parts = [f for f in items.schema if f.name != "embedding"]
    schema = T.StructType([*parts, asked.schema[by], T.StructField("score", T.DoubleType())])
    sent = dealt.select(*[f.name for f in parts], F.col("embedding").cast("array<double>").alias("embedding"))
    slices, met = max(1, -(-asked.count() // QUERIES)), None
    for s in range(slices):
        some = (asked if slices == 1 else asked.filter(F.pmod(F.xxhash64(by), F.lit(slices)) == s)).toArrow().combine_chunks()
        found = sent.mapInArrow(_nearest(some, k, order, by), schema)
        met = found if met is None else met.unionByName(found)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def _vectors(column):
    """(matrix filled up with zeros, lengths, places of null elements) of an Arrow column of lists; a null list has length -1."""
    import numpy as np
    import pyarrow.compute as pc

    n = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    flat, width = column.flatten(), max(0, int(n.max(initial=0)))
    inside = np.arange(width) < n[:, None]
    matrix, empty = np.zeros((len(n), width)), np.zeros((len(n), width), bool)
    matrix[inside] = np.asarray(pc.fill_null(flat, 0.0))
    empty[inside] = np.asarray(flat.is_null())
    return matrix, n, empty


def _nearest(asked, k: int, order: str, by: str):
    """Batches of items to the rows that are among a query's k best of the task, with query and score.

    A matrix product rules out what cannot be among the best, with a bound of its rounding; the rest is summed in the order of `dot`.
    """
    ids, (wanted, sizes, gaps) = asked.column(by).combine_chunks(), _vectors(asked.column("query").combine_chunks())

    def scores(a, n, empty, i, q):
        """(kind, score) of pairs: 2 for not a number, 1 for a number, 0 for null."""
        import numpy as np

        least = np.minimum(n[i], sizes[q])
        total, null = np.zeros(len(i)), least < 0
        with np.errstate(all="ignore"):
            for d in range(min(a.shape[1], wanted.shape[1])):
                total = np.where(d < least, total + a[i, d] * wanted[q, d], total)
                null |= (d < least) & (empty[i, d] | gaps[q, d])
        kind = np.where(null, 0, np.where(np.isnan(total), 2, 1))
        return kind, np.where(kind == 1, total, 0.0)

    def near(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        many, held = len(ids), None
        # the best so far, a row a query: kind (-1 for none), score, and place among the rows held
        kinds, best, rows = np.full((many, k), -1), np.zeros((many, k)), np.zeros((many, k), np.int64)
        length = np.sqrt((wanted * wanted).sum(axis=1))
        plain_queries = bool((sizes >= 0).all() and not gaps.any() and np.isfinite(wanted).all() and (length < 1e100).all())
        for batch in batches:
            if not (batch.num_rows and many and k):
                continue
            a, n, empty = _vectors(batch.column("embedding"))
            own = pa.Table.from_batches([batch.drop_columns(["embedding"])])
            before = 0 if held is None else held.num_rows
            held = own if held is None else pa.concat_tables([held, own])
            code = np.empty(held.num_rows, np.int64)
            code[np.asarray(pc.sort_indices(held.column(order), null_placement="at_start"))] = np.arange(held.num_rows)
            # of equal vectors only the first k can be among the best
            mark = np.ascontiguousarray(np.column_stack([a + 0.0, empty, n])).view(np.uint64)
            first = np.lexsort((code[before:], *mark.T))
            new = np.r_[True, (mark[first][1:] != mark[first][:-1]).any(axis=1)]
            at = np.arange(len(first))
            use = np.sort(first[at - np.maximum.accumulate(np.where(new, at, 0)) < k])
            norm = np.sqrt((a * a).sum(axis=1))
            plain = plain_queries and bool((n >= 0).all() and not empty.any() and np.isfinite(a).all() and (norm < 1e100).all())
            width = min(a.shape[1], wanted.shape[1])
            for j in range(0, many, TILE):
                for u in range(0, len(use), TILE):
                    i, q = use[u : u + TILE], np.arange(j, min(many, j + TILE))
                    if plain:
                        about = wanted[q, :width] @ a[i, :width].T
                        slack = 16 * (width + 2) * 2.0**-52 * length[q] * norm[i].max() + 1e-290
                        full = kinds[q, k - 1]
                        floor = np.where(full == 2, np.inf, np.where(full == 1, best[q, k - 1], -np.inf)) - slack
                        if len(i) > k and (full < 1).any():  # the k-th of the tile is a floor as well
                            floor = np.maximum(floor, np.partition(about, -k, axis=1)[:, -k] - 2 * slack)
                        y, x = np.nonzero(about >= floor[:, None])
                    else:
                        y, x = (v.ravel() for v in np.indices((len(q), len(i))))
                    for z in range(0, len(y), 1 << 18):
                        qs, xs = q[y[z : z + (1 << 18)]], i[x[z : z + (1 << 18)]]
                        kind, score = scores(a, n, empty, xs, qs)
                        hit = np.unique(qs)
                        old = np.repeat(hit, k), kinds[hit].ravel(), best[hit].ravel(), rows[hit].ravel()
                        qs, kind, score, row = (np.concatenate(v) for v in zip(old, (qs, kind, score, xs + before)))
                        by_rank = np.lexsort((code[row], -score, -kind, qs))
                        qs, kind, score, row = qs[by_rank], kind[by_rank], score[by_rank], row[by_rank]
                        begin = np.searchsorted(qs, hit)
                        pick = begin[:, None] + np.arange(k)  # every query has k old places
                        kinds[hit], best[hit], rows[hit] = kind[pick], score[pick], row[pick]
            keep, place = np.unique(rows[kinds >= 0], return_inverse=True)
            held = held.take(pa.array(keep)).combine_chunks()
            rows[kinds >= 0] = place
            rows[kinds < 0] = 0
        if held is None:
            return
        q, r = np.nonzero(kinds >= 0)
        kind, score = kinds[q, r], best[q, r]
        score = pa.array(np.where(kind == 2, np.nan, score), pa.float64(), mask=kind == 0, from_pandas=False)
        for z in range(0, len(q), 10_000):
            some = slice(z, z + 10_000)
            out = held.take(pa.array(rows[q, r][some])).append_column(by, ids.take(pa.array(q[some]))).append_column("score", score[some])
            yield from out.combine_chunks().to_batches()

    return near


class EmbeddingStore:
    """Documents (id, content, metadata) with their vectors, in order of insertion."""

    def __init__(self, spark: SparkSession, embedding_fn: Callable[[Column], Column] | None = None, collection_name: str = "documents") -> None:
        self.spark, self.embed, self.collection_name = spark, embedding_fn or MockEmbedder(), collection_name
        self.records: DataFrame | None = None
        self.next = 0

    def add_documents(self, docs: DataFrame, order: str = "id") -> None:
        """Append; numbers go on from all that were ever added, deleted ones too."""
        made = in_order(docs, order, "seq", self.next)
        meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
        own = F.create_map(F.lit("doc_id"), F.coalesce(F.element_at(meta, "doc_id"), F.col("id")))
        made = made.select(
            F.concat("id", F.lit("#"), F.col("seq").cast("string")).alias("id"), "content",
            F.map_concat(F.map_filter(meta, lambda k, v: k != "doc_id"), own).alias("metadata"), self.embed(F.col("content")).alias("embedding"), "seq",
        )
        self.next += docs.count()
        self.records = made if self.records is None else self.records.unionByName(made)

    def search(self, query: str, top_k: int = 5) -> DataFrame:
        return self.search_with_filter(query, top_k)

    def search_with_filter(self, query: str, top_k: int = 3, metadata_filter: Mapping[str, str | None] | None = None) -> DataFrame:
        """Only records whose metadata has every value asked for; a missing key equals None."""
        if self.records is None:
            return self.spark.createDataFrame([], "id string, content string, metadata map<string,string>, score double")
        rows = self.records
        for key, value in (metadata_filter or {}).items():
            rows = rows.filter(F.element_at("metadata", key).eqNullSafe(F.lit(value).cast("string")))
        found = globals()["top_k"](rows, self.embed(F.lit(query)), top_k)
        return found.select("id", "content", "metadata", "score", "seq").orderBy(F.desc("score"), "seq").drop("seq")

    def get_collection_size(self) -> int:
        return 0 if self.records is None else self.records.count()

    def delete_document(self, doc_id: str) -> bool:
        """Whether any record had that doc_id."""
        if self.records is None:
            return False
        own = F.element_at("metadata", "doc_id").eqNullSafe(F.lit(doc_id))
        found = not self.records.filter(own).isEmpty()
        self.records = self.records.filter(~own)
        return found
