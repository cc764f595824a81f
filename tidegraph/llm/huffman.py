"""Token ids in a compact file: canonical length-limited Huffman codes, decoded by table in independent blocks.

Counts of ids over the whole corpus give code lengths of at most LIMIT bits (package-merge); canonical codes need only
the lengths, which each file carries. A file is a run of segments; in a segment, blocks of BLOCK ids each begin at a
bit offset that the segment lists, so blocks are decoded apart from one another: here all blocks of a segment at once,
one id of each at a time, by one lookup in a table of 2^LIMIT entries.

Files hold ascending ranges of doc_id. Ids are made once and stored, counted from there, and the range exchange carries them. Each file is written under a
name of its own and renamed when whole, so a task that runs again leaves no half file; the manifest has a row a file.

Cases: null and empty texts have the end id only; a null doc_id sorts first; equal doc_ids sort by their ids; an empty table
gives no files; a text longer than a segment goes on in the next one; columns other than doc_id and text are not kept.

Layout, little-endian: 4 bytes "TGH1", u32 LIMIT, u32 n, n code lengths of a byte; segments; index of segment offsets,
u64 each; u64 number of segments; 4 bytes "TGH1". Segment: u32 ids, u32 pieces, u64 bits, u32 blocks; u64 bit offset of
each block; pieces (i64 doc_id, u32 ids, u8 flags: 1 goes on from the last segment, 2 null doc_id); the bits.
"""

import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _SPACE, vocabulary_path
from .common import kept_by_worker, scratch, ship, table

ship(__name__)
LIMIT, BLOCK, SEGMENT, END = 18, 256, 1 << 20, 2
CACHE = 450_000
SLICE = 8 << 20
MAGIC = b"TGH1"
#: Latin letters whose lower case is one of them too.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af\u2c65\u2c66"
#: A text without a match is Latin letters, white space and single commas and full stops: in lower case, with those apart, its words are the tokenizer's.
_OTHER = f"[^{_LATIN} \n,.]|[,.][,.]"
#: A text without a match has the same ids in lower case: "<" may begin a special token, other letters are the library's to change.
_CASED = f"[^{_LATIN}\t-\r -;=-~]"
#: A word without a match is cut as the tokenizer cuts it: into letters, single digits and the rest.
_UNCUT = f"[^{_LATIN}!-&(-;=-~]"
#: White space beyond ASCII, and what is near it.
_BLANK = "[\x85\xa0\u1680\u180e\u2000-\u206f\u3000]"
_CUTS = re.compile(f"[{_LATIN}]+|[0-9]|\n|[!-&(-/:;=-@\\[-`{{-~]+")
_PIECE = np.dtype([("doc", "<i8"), ("n", "<u4"), ("flags", "u1")])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most `limit` bits, 0 for ids that never occur (package-merge)."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < len(leaves))
        merged = both[at]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    active = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:active].sum())
        lengths[order[:n]] += 1
        active = 2 * (active - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each `limit` bits that may lie ahead: the id, and how many of them are its."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    reach = np.int64(1) << (limit - lengths[order].astype(np.int64))
    ids, sizes = np.repeat(order, reach), np.repeat(lengths[order], reach)
    rest = (1 << limit) - len(ids)
    return np.pad(ids, (0, rest)).astype(np.uint32), np.pad(sizes, (0, rest), constant_values=1).astype(np.int64)


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """The bits, their number, and where each block begins."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    begins = ends - n
    word, bit = begins >> 5, (begins & 31).astype(np.uint64)
    value = codes[ids] << (np.uint64(64) - n.astype(np.uint64) - bit)
    bits = int(ends[-1]) if len(ends) else 0
    size = (bits >> 5) + 2
    # bits of different ids never meet, so sums are unions; each is below 2^32 and exact in a double
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return words.astype(">u4").tobytes()[: (bits + 7) // 8], bits, begins[::BLOCK]


def unpack(data: bytes, n: int, blocks: np.ndarray, ids: np.ndarray, sizes: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, out = blocks.astype(np.int64).copy(), np.zeros((len(blocks), BLOCK), np.uint32)
    mask = np.uint32((1 << limit) - 1)
    most = len(ahead) * 8 - 1
    for k in range(min(BLOCK, n)):
        if k == n % BLOCK and k:  # the last block may be shorter
            at, full = at[: n // BLOCK], n // BLOCK
        else:
            full = len(at)
        look = (ahead[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & mask
        out[:full, k] = ids[look]
        at = np.minimum(at + sizes[look], most)
    return out.reshape(-1)[:n]


class _Ids:
    """Ids of texts by the library, word by distinct word of a batch; pieces of Latin words that are new to the worker go in one call.
    Of words known, the half of CACHE that batches asked for most is kept when there is no room for more."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        # for pieces in lower case, composed and apart: the same merges, without looking for words again
        self.words = Tokenizer.from_str(spec)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # of another kind of vocabulary all words go to the library as they are
        ids = self.words.encode("ab 1 2 .; c\u00e9", add_special_tokens=False).ids
        self.cuts = ids == self.library.encode("Ab12.;C\u00c9", add_special_tokens=False).ids and self.ends[ids].sum() == 5
        self.cuts = self.cuts and all("<" in t.content for t in self.library.get_added_tokens_decoder().values())
        # a row for each word known, the next one for a word looked up: where its ids begin, how many they are, how many batches had it
        self._reset([], np.zeros(0, np.int64))

    def _reset(self, words: list[str], rows: np.ndarray) -> None:
        """Keep words, which are at these rows. The first two rows stay: no ids, and the end of a text, which a line feed stands for."""
        self.flat, ends = self._ids(np.append([0, 1], rows)) if words else (np.array([END], f"<u{self.width}"), np.array([0, 1]))
        self.sizes = np.diff(ends, prepend=0)
        self.first = ends - self.sizes
        self.hits = np.append([0, 0], self.hits[rows] // 2) if words else np.zeros(2, np.int64)
        self.rows: defaultdict[str, int] = defaultdict(None, zip(["", "\n", *words], range(len(ends))))
        self.rows.default_factory = self.rows.__len__

    def _forget(self) -> None:
        worth = np.where(self.sizes > 16, 0, self.hits)[2:]  # long words take room and seldom come again
        keep = np.sort(np.lexsort((np.arange(len(worth)), worth))[len(worth) - min(CACHE // 2, np.count_nonzero(worth)) :])
        words = list(self.rows)
        self._reset([words[k] for k in (keep + 2).tolist()], keep + 2)

    def _ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows, flat, and where each row's end."""
        n = self.sizes[rows]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[rows] - ends + n, n) + np.arange(n.sum())], ends

    def _set(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.first[rows], self.sizes[rows] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])

    def _learn(self, words: list[str], odd: np.ndarray, known: int) -> None:
        """Ids of words, which are at the rows from `known` on, and of the pieces that those not odd are cut into."""
        plain, own = list(compress(words, (~odd).tolist())), known + np.nonzero(~odd)[0]
        pieces = _CUTS.findall("\n".join(plain).lower())
        at = np.fromiter(map(self.rows.__getitem__, pieces), np.int64, len(pieces))
        more = len(self.rows) - known
        self.first, self.sizes, self.hits = (np.pad(x, (0, more)) for x in (self.first, self.sizes, self.hits))
        # a word that is its own first piece has no other one
        border = at == 1
        of = np.cumsum(border)
        made = at[np.append(0, np.nonzero(border)[0] + 1)] != own if plain else np.zeros(0, bool)
        new = np.ones(more, bool)
        new[: len(words)] = ~odd
        new[own[made] - known] = False
        if new.any():  # each is one word to the tokenizer, so it has one token that ends a word, its last
            names = chain(words, [*islice(reversed(self.rows), more - len(words))][::-1])
            ids = np.array(self.words.encode_batch_fast([" ".join(compress(names, new.tolist()))], add_special_tokens=False)[0].ids, np.int64)
            sizes = np.diff(np.nonzero(self.ends[ids])[0], prepend=-1)
            if len(sizes) != np.count_nonzero(new):
                raise ValueError(f"{len(sizes)} ends of words for {np.count_nonzero(new)} pieces")
            self._set(known + np.nonzero(new)[0], ids, sizes)
        if made.any():
            some = made[of] & ~border
            sizes = np.bincount(of[some], self.sizes[at[some]], len(plain))[made].astype(np.int64)
            self._set(own[made], self._ids(at[some])[0], sizes)
        if odd.any():
            got = [e.ids for e in self.library.encode_batch_fast([*compress(words, odd.tolist())], add_special_tokens=False)]
            self._set(known + np.nonzero(odd)[0], np.array([*chain(*got)], np.int64), np.array([len(ids) for ids in got]))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word, and where each text's words end."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        cased = pc.match_substring_regex(texts, _CASED)
        beyond = texts.filter(cased)
        if pc.any(pc.match_substring_regex(beyond, "[\x1c-\x1f]")).as_py():  # white space to Arrow, not to the library
            words = pa.array([[x for x in _SPACE.split(t) if x] for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        else:
            if self.cuts:
                low = pc.utf8_lower(texts)
                apart = pc.replace_substring(pc.replace_substring(low, ",", " , "), ".", " . ")
                texts = pc.if_else(cased, texts, pc.if_else(pc.match_substring_regex(texts, _OTHER), low, apart))
            words = (pc.utf8_split_whitespace if pc.any(pc.match_substring_regex(beyond, _BLANK)).as_py() else pc.ascii_split_whitespace)(texts)
        ends = np.asarray(words.offsets)[1:].astype(np.int64) - np.asarray(words.offsets)[0]
        of = words.flatten().dictionary_encode()
        distinct, known = of.dictionary.to_numpy(zero_copy_only=False).tolist(), len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))
        new = rows >= known
        if new.any():
            odd = pc.match_substring_regex(of.dictionary.filter(pa.array(new)), _UNCUT if self.cuts else "")
            self._learn([*compress(distinct, new.tolist())], odd.to_numpy(zero_copy_only=False), known)
        self.hits[rows] += 1
        return rows[np.asarray(of.indices)], ends

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end id, and where each text's end."""
        known = len(self.rows)
        at, ends = self._words(texts)
        flat, upto = self._ids(np.insert(at, ends, 1))
        if 2 * len(self.rows) - known > CACHE or len(self.flat) > 16 * CACHE:  # no room for as many new ones
            self._forget()
        return flat, upto[ends + np.arange(len(ends))]


def _vocabulary(spec: str) -> dict[str, int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec).get_vocab(with_added_tokens=True)


def _ids(spec) -> _Ids:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept_by_worker(f"ids{zlib.crc32(spec.value.encode())}", lambda: _Ids(spec.value))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of about SLICE bytes each: what is made of a text takes many times its size."""
    step = max(1, int(batch.num_rows * SLICE / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def tokenised(docs: DataFrame, spec) -> DataFrame:
    """(doc_id, ids) written once, ids as bytes of 16 bits each, or 32 if the vocabulary is larger."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _ids(spec)
        for batch in (part for whole in batches for part in _slices(whole)):
            flat, stops = of(batch.column(1))
            wide = of.width
            ends = np.concatenate([[0], stops * wide])
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary())], names=["doc_id", "ids"])

    out, path = docs.mapInArrow(make, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])), scratch(docs.sparkSession, "huffman-ids")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def counts(ids: DataFrame, wide: int) -> np.ndarray:
    """How often each id occurs in all documents; a task gives at most a row for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.binary())
            if not len(column):
                continue
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
            got = np.bincount(np.frombuffer(column.buffers()[2], f"<u{wide}", (ends[-1] - ends[0]) // wide, ends[0]), minlength=len(total))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total += got
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write(docs: DataFrame, folder: str, path: str | None = None, files: int | None = None) -> list[tuple[str, int]]:
    """Write (doc_id, text) as files in ascending doc_id order: (file, ids in it) of each, in that order."""
    spark = docs.sparkSession
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    wide = 2 if max(_vocabulary(spec.value).values()) < 1 << 16 else 4
    made = tokenised(docs.select("doc_id", "text"), spec)
    lengths = code_lengths(counts(made, wide))
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        (sizes, codes), part = shared.value, TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        name, offsets, total = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tgh", [], 0
        held, pieces, n = [], [], 0
        out = None

        def flush() -> None:
            nonlocal held, pieces, n
            data, bits, blocks = pack(np.concatenate(held), sizes, codes)
            offsets.append(out.tell())
            out.write(struct.pack("<IIQI", n, len(pieces), bits, len(blocks)) + blocks.astype("<u8").tobytes() + np.array(pieces, _PIECE).tobytes() + data)
            held, pieces, n = [], [], 0

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_buffer(), f"<u{wide}")
                if out is None:
                    out = store.open_output_stream(f"{name}.part")
                    out.write(MAGIC + struct.pack("<II", LIMIT, len(sizes)) + sizes.tobytes())
                total += len(ids)
                for k in range(0, len(ids), SEGMENT):
                    some = ids[k : k + SEGMENT]
                    held.append(some)
                    pieces.append((doc or 0, len(some), (k > 0) + 2 * (doc is None)))
                    n += len(some)
                    if n >= SEGMENT:
                        flush()
        if out is not None:
            if n:
                flush()
            out.write(np.array(offsets, "<u8").tobytes() + struct.pack("<Q", len(offsets)) + MAGIC)
            out.close()
            store.move(f"{name}.part", name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([total], pa.int64())], names=["part", "file", "ids"])

    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first()
    dealt = made.repartitionByRange(files, order, F.xxhash64("ids")).sortWithinPartitions(order, "ids")
    rows = dealt.mapInArrow(save, "part int, file string, ids long").collect()  # a row a file
    return [(r["file"], r["ids"]) for r in sorted(rows, key=lambda r: r["part"])]


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    starts, at = [], 0
    for name, n in files:
        starts.append((name, at))
        at += n
    listed = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"]):
                with store.open_input_file(name) as f:
                    size = f.size()
                    f.seek(size - 12)
                    (segments,) = struct.unpack("<Q", f.read(8))
                    f.seek(size - 12 - 8 * segments)
                    ends = [*np.frombuffer(f.read(8 * segments), "<u8").tolist(), size - 12 - 8 * segments]
                    f.seek(4)
                    limit, n = struct.unpack("<II", f.read(8))
                    ids, sizes = decode_table(np.frombuffer(f.read(n), np.uint8), limit)
                    rows, pending = [], None
                    for a, b in zip(ends, ends[1:]):
                        f.seek(a)
                        raw = f.read(b - a)
                        n, n_pieces, _, n_blocks = struct.unpack_from("<IIQI", raw)
                        blocks = np.frombuffer(raw, "<u8", n_blocks, 20)
                        pieces = np.frombuffer(raw, _PIECE, n_pieces, 20 + 8 * n_blocks)
                        got = unpack(raw[20 + 8 * n_blocks + _PIECE.itemsize * n_pieces :], n, blocks, ids, sizes, limit).astype("<u4").tobytes()
                        k = 0
                        for doc, m, flags in pieces.tolist():
                            some = got[4 * k : 4 * (k + m)]
                            k += m
                            if flags & 1:
                                pending[2] += m
                                pending[3] = zlib.crc32(some, pending[3])
                            else:
                                if pending:
                                    rows.append(pending)
                                pending = [None if flags & 2 else doc, start, m, zlib.crc32(some)]
                            start += m
                        if len(rows) > 10_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows + [pending])

    return listed.mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})


def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "huffman")
    return read(spark, folder, write(table(spark, sf_dir, "documents"), folder))
