"""Text segmentation: arrays of chunks as Column expressions, and the same as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c, strip

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_NONE = "array<string>"


class FixedSizeChunker:
    """Windows of chunk_size characters, each `overlap` into the one before; the last is the first that reaches the end."""

    def __init__(self, chunk_size: int = 500, overlap: int = 50) -> None:
        self.chunk_size, self.overlap = chunk_size, overlap

    def chunks(self, text: Column | str) -> Column:
        text, size, step = _c(text), self.chunk_size, self.chunk_size - self.overlap
        if step == 0:
            raise ValueError("chunk_size must differ from overlap")
        if step < 0:  # no window begins
            return F.when(F.length(text).between(1, size), F.array(text)).otherwise(F.array().cast(_NONE))
        last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
        return F.when(F.length(text) > 0, cut).otherwise(F.array().cast(_NONE))


class SentenceChunker:
    """Groups of sentences, joined by a space; a sentence ends at . ! or ? before white space."""

    def __init__(self, max_sentences_per_chunk: int = 3) -> None:
        self.size = max(1, max_sentences_per_chunk)

    def chunks(self, text: Column | str) -> Column:
        n = self.size
        parts = F.filter(F.transform(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), strip), lambda x: x != "")

        def group(p: Column) -> Column:
            starts = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / n).cast("int"))
            return F.when(F.size(p) > 0, F.transform(starts, lambda i: F.array_join(F.slice(p, i * n + 1, F.lit(n)), " "))).otherwise(F.array().cast(_NONE))

        return F.transform(F.array(parts), group)[0]


class RecursiveChunker:
    """Pieces by the first separator, merged while they fit; one that is too long is cut by the separators that are left."""

    def __init__(self, separators: Sequence[str] | None = None, chunk_size: int = 500) -> None:
        self.separators, self.chunk_size = tuple(SEPARATORS if separators is None else separators), chunk_size

    def chunks(self, text: Column | str) -> Column:
        text = _c(text)
        kept = F.filter(self._cut(text, self.separators), lambda c: F.rlike(c, F.lit(r"(?U)\S")))
        return F.when(F.length(text) > 0, kept).otherwise(F.array().cast(_NONE))

    def _cut(self, text: Column, separators: tuple[str, ...]) -> Column:
        size = self.chunk_size
        if not separators or separators[0] == "":
            longer = FixedSizeChunker(size, 0).chunks(text)
        else:
            longer = self._merge(text, separators[0], separators[1:])
        return F.when(F.length(text) <= size, F.array(text)).otherwise(longer)

    def _merge(self, text: Column, sep: str, rest: tuple[str, ...]) -> Column:
        size = self.chunk_size
        literal = "".join(f"[{c}]" if c not in "\n^\\" else {"\n": "\\n", "^": "\\^", "\\": "\\\\"}[c] for c in sep)
        start = F.struct(F.array().cast(_NONE).alias("out"), F.lit("").alias("held"))
        flushed = lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["held"])))

        def step(s: Column, piece: Column) -> Column:
            joined = F.when(s["held"] == "", piece).otherwise(F.concat(s["held"], F.lit(sep), piece))
            return (
                F.when(F.length(joined) <= size, F.struct(s["out"].alias("out"), joined.alias("held")))
                .when(F.length(piece) <= size, F.struct(flushed(s).alias("out"), piece.alias("held")))
                .otherwise(F.struct(F.concat(flushed(s), self._cut(piece, rest)).alias("out"), F.lit("").alias("held")))
            )

        return F.aggregate(F.split(text, literal, -1), start, step, flushed)


STRATEGIES = {
    "fixed_size": lambda size: FixedSizeChunker(size, 0),
    "by_sentences": lambda size: SentenceChunker(),
    "recursive": lambda size: RecursiveChunker(chunk_size=size),
}


class ChunkingStrategyComparator:
    """Number and mean length of chunks of each document under each strategy."""

    def compare(self, docs: DataFrame, chunk_size: int = 200, key: str = "doc_id", text: str = "text", strategies: Sequence[str] = tuple(STRATEGIES)) -> DataFrame:
        out = docs.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), STRATEGIES[s](chunk_size).chunks(text).alias("chunks")) for s in strategies])).alias("x"))
        lengths = F.transform("x.chunks", lambda c: F.length(c).cast("double"))
        mean = F.aggregate(lengths, F.lit(0.0), lambda a, n: a + n) / F.greatest(F.size("x.chunks"), F.lit(1))
        return out.select(key, "x.strategy", F.size("x.chunks").cast("long").alias("n_chunks"), mean.alias("avg_length"), F.col("x.chunks").alias("chunks"))


def rows(df: DataFrame, chunker, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_idx, chunk) from 0 on."""
    return df.select(key, F.posexplode(chunker.chunks(text)).alias("chunk_idx", "chunk"))


def chunk_docs(docs: DataFrame, chunk_size: int = 500) -> DataFrame:
    """docs (id, content, metadata) to chunks of the same shape: id `doc#i`, the document's metadata with doc_id its id."""
    out = docs.select(F.col("id").alias("doc_id"), "metadata", F.posexplode(RecursiveChunker(chunk_size=chunk_size).chunks("content")).alias("chunk_idx", "content"))
    own = F.create_map(F.lit("doc_id"), F.col("doc_id"))
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "doc_id")
    return out.select(F.concat("doc_id", F.lit("#"), F.col("chunk_idx").cast("string")).alias("id"), "content", F.map_concat(rest, own).alias("metadata"), "doc_id", "chunk_idx")
