"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word the encoding of that prefix ends in one token only, so storing that last token for every
prefix is enough. A suffix automaton over the vocabulary (Aho-Corasick) gives the tokens that end at a position, the
longest first; the first whose left neighbour, the stored last token of the prefix before it, is compatible is the
one. Two tokens are compatible if the merges, run on their joined text, would leave the border between them: this is
tested by undoing merges from both sides in rank order. Back-pointers from the end give the exact ids.

The tokenizer's file is a parameter; the driver reads it and ships it (a vocabulary is of bounded size). Texts are cut
at white space, which no word of this kind of tokenizer crosses, and what a piece gives is kept in caches of bounded
size; they only save time.

Cases: null and empty texts have no ids and decode to the empty string; special tokens written in a text are encoded
as themselves, as the library does; very long words take linear memory; repeated rows are each encoded; other columns
pass through `encode` (the name `ids` is taken).
"""

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_by_worker, ship, table

ship(__name__)
#: Entries of a cache before it starts anew.
CACHE = 250_000
#: Bytes of ids of a batch that goes back to the JVM.
OUT = 1 << 22
_SPACES = "\t-\r \x85\xa0  -     　"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


_BEYOND, _LOOSE = re.compile("[^\x00-\u024f]"), re.compile(r"(?<![^\W\d_])[.,]\s")
_ODD, _SPACE = re.compile("[\x1c-\x1f]"), re.compile(f"[{_SPACES}]+")


def stretches(text: str) -> list[str]:
    """The stretches of text between white space, which no token crosses; Latin text in lower case, with a comma or full
    stop after a letter apart, as the tokenizer takes them: so that fewer of them differ."""
    if _ODD.search(text):  # white space to split(), not to the library
        return [x for x in _SPACE.split(text) if x]
    if not _BEYOND.search(text) and not _LOOSE.search(text):
        text = text.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n").replace(",\n", " ,\n")
    return text.split()


class Encoder:
    """One tokenizer file with word ends, lower-casing and byte-level symbols."""

    def __init__(self, spec: str) -> None:
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        model = json.loads(spec)
        vocab, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        bytes_of = _byte_chars()
        self.token = [""] * (max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.token[i] = t
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for t, i in self.special.items():
            self.token[i] = t
        # a symbol is a byte, or a byte that ends a word: one character below U+0100 or from there on
        text: dict[int, str] = {}
        for c, b in bytes_of.items():
            text[vocab[c]], text[vocab[c + end]] = chr(b), chr(256 + b)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {i: -1 for i in text}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            l, r, i = vocab[a], vocab[b], vocab[a + b]
            self.joined[l, r] = rank
            if i not in self.rank:
                self.rank[i], self.parts[i], text[i] = rank, (l, r), text[l] + text[r]
        self.automaton = ahocorasick.Automaton()
        for i, s in text.items():
            # a token that the merges never leave as it is cannot be the last of a prefix
            if i not in self.parts or self._compatible(*self.parts[i], upto=self.rank[i]):
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces: dict[str, tuple] = {}
        self.chunks: dict[str, tuple[bytes, bytes]] = {}

    def _compatible(self, a: int, b: int, upto: int | None = None) -> bool:
        """Whether a then b stay two tokens. upto: merges of this rank and later don't count."""
        rank, parts, joined = self.rank, self.parts, self.joined
        limit = 1 << 60 if upto is None else upto
        while True:
            made = joined.get((a, b))
            if made is not None and made < limit:
                return False
            # undo the later of the merges that made the two; what is made later than `limit` was not there then
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer, normalised."""
        raw = word.encode()
        s = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        last: list[int | None] = [None] * (len(s) + 1)
        back = [0] * (len(s) + 1)
        fits = self.fits
        for at, (i, n) in self.automaton.iter(s):
            if last[at + 1] is not None:
                continue
            begin = at + 1 - n
            if begin:
                before = last[begin]
                if before is None:
                    continue
                key = before << 20 | i
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > CACHE:
                        fits.clear()
                    ok = fits[key] = self._compatible(before, i)
                if not ok:
                    continue
            last[at + 1], back[at + 1] = i, begin
        ids, k = [], len(s)
        while k:
            ids.append(last[k])
            k = back[k]
        return ids[::-1]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        import struct

        ids: list[int] = []
        if chunk.isascii():
            pieces = self.word.findall(chunk.lower())
        else:  # which letters are lower case, composed or letters at all is the library's to say, for its version of Unicode
            norm = self.library.normalizer.normalize_str(chunk)
            pieces = [norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        for piece in pieces:
            got = self.pieces.get(piece)
            if got is None:
                got = self.encode_word(piece)
                if len(piece) < 64 and piece != chunk:  # else the stretch is kept
                    if len(self.pieces) >= CACHE // 4:
                        self.pieces.clear()
                    self.pieces[piece] = tuple(got)
            ids.extend(got)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.token[i] for i in ids]).encode()

    def chunked(self, text: str | None) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits) and decoded text of each stretch of the text, in order."""
        if not text:
            return []
        if self.marks and "<|" in text and self.marks.search(text):
            out = []
            for part in self.marks.split(text):
                if part in self.special:
                    out.append((self.special[part].to_bytes(4, "little"), part.encode()))
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[tuple[bytes, bytes]]:
        chunks, out = self.chunks, []
        for w in stretches(text):
            got = chunks.get(w)
            if got is None:
                got = self._chunk(w)
                if len(w) < 64:
                    if len(chunks) >= CACHE:
                        chunks.clear()
                    chunks[w] = got
            out.append(got)
        return [x for x in out if x[0]] if not all([x[0] for x in out]) else out

    def encode(self, text: str | None) -> bytes:
        return b"".join([x[0] for x in self.chunked(text)])

    def decode(self, ids) -> str:
        return " ".join([self.token[i] for i in ids])


def encoder(spec: str) -> Encoder:
    """One for each worker and vocabulary."""
    return kept_by_worker("bpe" + hashlib.sha256(spec.encode()).hexdigest(), lambda: Encoder(spec))


def _shipped(spark: SparkSession, path: str | None):
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs and `ids`, array<int>."""
    spec = _shipped(docs.sparkSession, path)
    at = docs.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec.value)
        for batch in batches:
            begin, parts, size = 0, [], 0
            for i, t in enumerate(batch.column(at)):
                parts.append(e.encode(t.as_py()))
                size += len(parts[-1])
                if size > OUT or i == batch.num_rows - 1:
                    ends = np.cumsum([0, *(len(x) // 4 for x in parts)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(parts)).columns, ids], names=[*batch.schema.names, "ids"])
                    begin, parts, size = i + 1, [], 0
        e.chunks, e.pieces = {}, {}

    return docs.mapInArrow(of, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """df and `decoded`, string."""
    spec = _shipped(df.sparkSession, path)

    @F.pandas_udf("string")
    def of(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(spec.value)
        for batch in rows:
            yield pd.Series([None if x is None else e.decode(x) for x in batch])

    return df.withColumn("decoded", of(ids))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts, ids and decoded texts stay in the worker."""
    spec = _shipped(docs.sparkSession, path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec.value)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                got = e.chunked(t.as_py())
                ids = b"".join([x[0] for x in got])
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b" ".join([x[1] for x in got])).hexdigest()))
            n, ids, words = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(words, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(of, T.StructType([docs.schema["doc_id"], *(T.StructField(k, v) for k, v in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))]))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
