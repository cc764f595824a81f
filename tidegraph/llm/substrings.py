"""Removal of repeated substrings of SPAN bytes, by merging Burrows-Wheeler transforms of shards.

A byte goes if a SPAN-byte string that covers it also starts earlier: in a document with a smaller doc_id, or further up in
the same one. Strings are those of the input.

How: every SPAN-byte string is named by the least hash of the K-byte strings in it, so equal strings have equal names
wherever they stand; consecutive strings of one name form a segment. Names that stand once in the corpus are ruled out first:
each task sends its different names, sorted into buckets, and a bucket tells which of them others have too. Only segments of
such names go on, from each task one of equal ones, to the bucket of their name, where equal ones become one string, held by
the first of them. What is left, names with different segments or with repeats inside one, is a collection of strings; they
are dealt to shards, as they come from the tasks. Each shard's suffixes are put in order and give its transform: for each
suffix, in order, the symbol before it and the place of the suffix that this makes (its LF mapping). The transforms are
merged by refining their interleave: from an interleave of all suffixes by their first h bytes, a stable pass over the
symbols before them makes the interleave by the first h + STEP; no suffixes are compared, and shards keep their order. Where
two neighbours fall apart in a pass their common prefix is below the bytes reached, so after the passes for SPAN bytes the
intervals that never fell apart are the repeated strings, and all but the first of each go. Symbols are of STEP bytes, which
takes 7 passes instead of 100.

The transforms are merged bucket by bucket, since equal strings share a bucket, and not over the whole corpus, whose interleave
no task could hold. Memory of a merge is bounded by MERGE bytes or one name's different segments.

Cases: null and empty texts have no bytes; documents of less than SPAN bytes lose nothing; of rows that repeat id and text
the first stays; a null doc_id is smaller than any other; different texts of one doc_id are ordered by their hash; very long
texts are hashed in stretches; an empty table gives none; other columns are not kept.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, materialise, ship, small_batches, table

ship(__name__)
#: Strings of a segment at most; periodic text would make long ones.
SPAN, K, RUN = 100, 32, 4096
#: Bytes of a symbol; the first pass takes what is left of SPAN.
STEP = 16
STRETCH = 1 << 20
#: Names that a task holds before it sends them; buckets for each shuffle partition; bytes of a merge and of a shard.
HELD, BUCKETS, MERGE, SHARD = 1 << 20, 4, 1 << 22, 1 << 20
#: Bytes of rows that go back to the JVM at a time.
OUT = 1 << 21
_MIX = 0x9E3779B97F4A7C15


def _words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of b as an integer."""
    return np.ndarray((max(0, len(b) - 7),), "<u8", np.ascontiguousarray(b), 0, (1,))


def _hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each K-byte string of b."""
    w, n, step = _words(b), len(b) - K + 1, _MIX
    h = w[:n] * np.uint64(step)
    for at in range(8, K, 8):
        step = step * _MIX & 0xFFFFFFFFFFFFFFFF
        h += w[at : at + n] * np.uint64(step)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _names(h: np.ndarray) -> np.ndarray:
    """The name of each SPAN-byte string: the least of the hashes in it."""
    wide, size = SPAN - K + 1, 1
    while 2 * size <= wide:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return np.minimum(h[: len(h) - (wide - size)], h[wide - size :]) if wide > size else h


def segments(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, number of strings, whether strings in it may be equal) of each segment of raw."""
    found, reach = [], SPAN - K
    for at in range(0, max(0, len(raw) - SPAN + 1), STRETCH):
        h = _hashes(np.frombuffer(raw, np.uint8, min(len(raw) - at, STRETCH + SPAN - 1), at))
        m = _names(h)
        cut = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
        n = np.diff(cut)
        # equal strings less than a string's K-byte strings apart: each of these is equal to one so far on, and of so many in a row one is looked at
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([h, np.zeros(reach, np.uint64)]), reach + 1)[::reach]
        x = np.flatnonzero((wide[:, 1:] == wide[:, :1]).any(1)) * reach
        twice = n > reach + 1  # further apart, only a long segment holds both
        for low, high in zip(np.searchsorted(cut, x - reach, "right").tolist(), np.searchsorted(cut, x + reach, "right").tolist()):
            twice[max(0, low - 1) : high] = True
        names, start = m[cut[:-1]], cut[:-1]
        if n.max() > RUN:  # periodic text: long runs of one name
            many = -(-n // RUN)
            first = RUN * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            names, twice, start = np.repeat(names, many), np.repeat(twice, many), np.repeat(start, many) + first
            n = np.diff(np.append(start, len(m)))
        found.append((names, start + at, n, twice))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _per_owner(owner: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, its starts) from pairs sorted by owner."""
    if len(owner):
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield int(owner[a]), starts[a:b]


_MARKS = ["bucket", "d", "key", "starts", "names", "owners"]
_MARK_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _marked(docs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """docs (d, key, text): (d, key, starts): segments (starts, 32 bits each) whose name others have too, or that may hold equal strings."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (d, key, starts) of names that the task has twice, and for each bucket one owner and start of each different name."""
        docs_held: list[tuple[int, int]] = []
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names, owner, start, twice = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(names, kind="stable")
            names, owner, start, twice = names[order], owner[order], start[order], twice[order]
            first = np.concatenate([[True], names[1:] != names[:-1]])
            known = ~first | np.concatenate([~first[1:], [False]]) | twice
            o = np.lexsort((start[known], owner[known]))
            out = []
            for i, s in _per_owner(owner[known][o], start[known][o]):
                out.append((i % buckets, *docs_held[i], s.astype("<u4").tobytes(), None, None))
                if len(out) == 10_000:
                    yield _batch(out, _MARKS, _MARK_KINDS)
                    out = []
            names, owner, start, known = names[first], owner[first], start[first], known[first]
            bucket = (names % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((start, owner, bucket))
            d, key = (np.array(x) for x in zip(*docs_held))
            size = 0
            for b, at in _per_owner(bucket[order], order):
                who, i = np.unique(owner[at], return_inverse=True)
                # planes of bytes that are alike: the compressor of the exchange makes little of most of them
                place = np.concatenate([(start[at] & 0xFFFF).astype("<u2"), (start[at] >> 16).astype("<u2"), i.astype("<u2"), known[at].astype("<u2")]).tobytes()
                name = names[at] // np.uint64(buckets)
                name = (name & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()  # within a bucket; two of one number only cost a look
                out.append((b, None, None, place, name, d[who].astype("<i8").tobytes() + key[who].astype("<i4").tobytes()))
                size += len(place) + len(name)
                if size > OUT:
                    yield _batch(out, _MARKS, _MARK_KINDS)
                    out, size = [], 0
            if out:
                yield _batch(out, _MARKS, _MARK_KINDS)

        for batch in batches:
            for d, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                names, start, _, twice = segments(text.as_buffer().to_pybytes() if text.is_valid else b"")
                if len(names):
                    held.append((names, np.full(len(names), len(docs_held)), start, twice))
                    docs_held.append((d, key))
                    n += len(names)
                if n >= HELD or len(docs_held) == 1 << 16:
                    yield from flush()
                    held, docs_held, n = [], [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        names_of = ["d", "key", "starts"]
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            ready = batch.filter(batch.column(4).is_null())
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays(ready.columns[1:4], names=names_of)
            for b, place, name, owners in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if name is not None:
                    kept.setdefault(b, []).append((place, name, owners))
        out = []
        while kept:
            _, blobs = kept.popitem()
            low, high, names, who, known = [], [], [], [], []
            d, key, n = [], [], 0
            for place, name, owners in blobs:
                c, m = len(name) // 4, len(owners) // 12
                p = np.frombuffer(place, "<u2").reshape(4, c).astype(np.int64)
                low.append(p[0] | p[1] << 16)
                who.append(p[2] + n)
                known.append(p[3] != 0)
                names.append(np.frombuffer(name, "<u4"))
                d.append(np.frombuffer(owners, "<i8", m))
                key.append(np.frombuffer(owners, "<i4", m, 8 * m))
                n += m
            names, start, who, known = (np.concatenate(x) for x in (names, low, who, known))
            d, key = np.concatenate(d), np.concatenate(key)
            order = np.argsort(names, kind="stable")
            names = names[order]
            first = np.concatenate([[True], names[1:] != names[:-1]])
            more = order[(~first | np.concatenate([~first[1:], [False]])) & ~known[order]]
            o = more[np.lexsort((start[more], who[more]))]
            for i, s in _per_owner(who[o], start[o]):
                out.append((int(d[i]), int(key[i]), s.astype("<u4").tobytes()))
                if len(out) == 10_000:
                    yield _batch(out, names_of, kinds)
                    out = []
        if out:
            yield _batch(out, names_of, kinds)

    sent = docs.select("d", "key", "text").mapInArrow(send, "bucket int, d long, key int, starts binary, names binary, owners binary")
    return sent.repartition(parts, "bucket").mapInArrow(meet, "d long, key int, starts binary")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


_STRINGS = ["bucket", "d", "key", "s", "e", "blob"]
_STRING_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _packed(rows: list[tuple]) -> bytes:
    """rows (seg, d, s, key, name, twice) as one compressed blob."""
    import zstandard

    segs, d, s, key, name, twice = zip(*rows)
    parts = [np.array(x, k).tobytes() for x, k in ((d, "<i8"), (s, "<u4"), (key, "<i4"), (name, "<u8"), (twice, "u1"), ([len(x) for x in segs], "<u4"))]
    return zstandard.ZstdCompressor(level=6).compress(len(rows).to_bytes(4, "little") + b"".join(parts) + b"".join(segs))


def _unpacked(blob: bytes) -> Iterator[tuple]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, cols = int.from_bytes(raw[:4], "little"), 4, []
    for k in ("<i8", "<u4", "<i4", "<u8", "u1", "<u4"):
        x = np.frombuffer(raw, k, n, at)
        at += x.nbytes
        cols.append(x.tolist())
    for d, s, key, name, twice, size in zip(*cols):
        yield raw[at : at + size], d, s, key, name, bool(twice)
        at += size


def _strings(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (d, key, text, marks): segments to be compared, one of equal ones in a task, packed by bucket; others as spans that go (no blob)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            while held:
                seg, mine = held.popitem()
                by.setdefault(mine[3] % buckets, []).append((seg, *mine))
            out, size = [], 0
            for b, rows in by.items():
                rows.sort(key=lambda r: r[4])
                out.append((b, None, None, None, None, _packed(rows)))
                size += len(out[-1][5])
                if size > OUT:
                    yield _batch(out, _STRINGS, _STRING_KINDS)
                    out, size = [], 0
            if out:
                yield _batch(out, _STRINGS, _STRING_KINDS)

        for batch in batches:
            gone = []
            for d, key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                raw, only = text.as_buffer().to_pybytes(), np.frombuffer(b"".join(marks), "<u4").astype(np.int64)
                names, start, n, twice = segments(raw)
                mine, end = np.isin(start, only), None
                for name, s, c, t in zip(names[mine].tolist(), start[mine].tolist(), n[mine].tolist(), twice[mine].tolist()):
                    seg = raw[s : s + c + SPAN - 1]
                    have = held.get(seg)
                    if have is None or (d, s, key) < have[:3]:
                        held[seg] = (d, s, key, name, t)
                        size += len(seg) if have is None else 0
                    if have is None:
                        continue
                    if (d, s, key) < have[:3]:
                        gone.append([int(have[0]) % buckets, have[0], have[2], have[1], have[1] + len(seg), None])
                    elif end is not None and s <= end[4]:  # goes on from the span before
                        end[4] = s + len(seg)
                    else:
                        end = [int(d) % buckets, d, key, s, s + len(seg), None]
                        gone.append(end)
                if size > 8 * OUT:
                    yield from flush()
                    size = 0
                if len(gone) > 20_000:
                    yield _batch(gone, _STRINGS, _STRING_KINDS)
                    gone = []
            if gone:
                yield _batch(gone, _STRINGS, _STRING_KINDS)
        yield from flush()

    return docs.select("d", "key", "text", "marks").mapInArrow(take, "bucket int, d long, key int, s int, e int, blob binary")


class Transform:
    """A shard's suffixes of strings, in the order of their first SPAN bytes: for each the place of the suffix that the symbol
    of STEP bytes (or FIRST) before it makes, or -1 where a string begins.

    symbols, firsts: ranks of the STEP and FIRST bytes at each place of the text, the same ranks in all shards.
    """

    def __init__(self, begin: np.ndarray, symbols: np.ndarray, firsts: np.ndarray, at: int, end: int) -> None:
        # places at..end of the text, string ends included
        n = end - at
        room = np.arange(n) - begin[at:end]  # bytes of the string before each place
        order = np.arange(n, dtype=np.int32)
        for k, (size, ranks) in enumerate(_passes(symbols, firsts)):
            order = order[room[order] >= size] - np.int32(size)
            order = order[_stable(ranks[at + order])]
        # those with less than SPAN bytes after them come last: no string starts there
        rest = np.ones(n, bool)
        rest[order] = False
        self.order = np.concatenate([order, np.flatnonzero(rest).astype(np.int32)])
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        self.before = {}
        for size in (SPAN % STEP, STEP):
            to = self.order - np.int32(size)
            fits = room[self.order] >= size
            self.before[size] = np.where(fits, place[np.where(fits, to, 0)], -1).astype(np.int32)
        self.at = at


def _passes(symbols: np.ndarray, firsts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(SPAN % STEP, firsts), *[(STEP, symbols)] * (SPAN // STEP)]


def _stable(ranks: np.ndarray) -> np.ndarray:
    """The stable order of non-negative ranks, by radix passes of 16 bits."""
    order = np.argsort((ranks & 0xFFFF).astype(np.uint16), kind="stable")
    if len(ranks) and ranks.max() > 0xFFFF:
        order = order[np.argsort((ranks >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _ranks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the STEP bytes from each place of text, equal for equal bytes only, and the first SPAN % STEP bytes as they are."""
    w = _words(np.concatenate([text, np.zeros(STEP, np.uint8)]))
    low, high = w[: len(text)], w[8 : 8 + len(text)]
    mixed = low * np.uint64(_MIX) ^ (high + (low >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(mixed)
    x, y, z = low[order], high[order], mixed[order]
    new = z[1:] != z[:-1]
    if (((x[1:] != x[:-1]) | (y[1:] != y[:-1])) & ~new).any():  # two symbols of one hash
        order = np.lexsort((low, high))
        x, y = low[order], high[order]
        new = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    number = np.zeros(len(text), np.int64)
    number[order[1:]] = np.cumsum(new)
    return number.astype(np.int32), (low & np.uint64((1 << 8 * (SPAN % STEP)) - 1)).astype(np.uint32)


def merged(shards: list[list[bytes]]) -> list[np.ndarray]:
    """Repeated strings of SPAN bytes: an array of places for each, places counted over all strings of all shards, one byte apart."""
    strings = [x for shard in shards for x in shard]
    sizes = np.array([len(x) + 1 for x in strings])
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    ends = np.cumsum(sizes)
    begin = np.repeat(ends - sizes, sizes)
    symbols, firsts = _ranks(text)
    local, at, parts = np.empty(len(text), np.int64), 0, []
    for shard in shards:
        end = at + sum(len(x) + 1 for x in shard)
        local[at:end] = begin[at:end] - at
        parts.append(Transform(local, symbols, firsts, at, end))
        at = end
    # all shards side by side: the suffix at each place of the transforms, and the place of the suffix made by the symbol before
    suffix = np.concatenate([p.order + p.at for p in parts])
    before = {k: np.concatenate([np.where(p.before[k] < 0, -1, p.before[k] + p.at) for p in parts]) for k in (SPAN % STEP, STEP)}
    interleave, fallen = np.arange(len(text)), np.zeros(len(text), np.int32)
    for size, ranks in _passes(symbols, firsts):
        to = before[size][interleave]
        there = to >= 0
        to, fallen = to[there], fallen[there]
        symbol = ranks[suffix[to]]
        order = _stable(symbol)
        interleave, symbol, fallen = to[order], symbol[order], fallen[order]
        # neighbours fall apart if their symbols differ, or the suffixes that these stand before had done so
        apart = (symbol[1:] != symbol[:-1]) | (fallen[1:] != fallen[:-1])
        fallen = np.concatenate([[0], np.cumsum(apart)]).astype(np.int32) if len(interleave) else fallen
    if not len(interleave):
        return []
    edge = np.flatnonzero(np.concatenate([[True], fallen[1:] != fallen[:-1], [True]]))
    many = np.diff(edge) > 1
    places = suffix[interleave]
    return [places[a:b] for a, b in zip(edge[:-1][many].tolist(), edge[1:][many].tolist())]


def _compared(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """rows (d, s, key, seg), different segments in the order of the tasks they come from: spans (d, key, s, e) that go."""
    shards, size = [[]], 0
    for r in rows:
        if size > SHARD:
            shards.append([])
            size = 0
        shards[-1].append(r[3])
        size += len(r[3])
    ends = np.cumsum([len(r[3]) + 1 for r in rows])
    begins = np.concatenate([[0], ends[:-1]])
    repeats = merged(shards)
    if not repeats:
        return
    group = np.repeat(np.arange(len(repeats)), [len(x) for x in repeats])
    place = np.concatenate(repeats)
    which = np.searchsorted(ends, place, "right")
    d, s, key = (np.array([r[i] for r in rows], np.int64)[which] for i in range(3))
    s = s + place - begins[which]
    order = np.lexsort((key, s, d, group))
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    later = order[~first]
    # strings of a segment that go together are one span
    which, d, s, key = which[later], d[later], s[later], key[later]
    order = np.lexsort((s, which))
    which, d, s, key = which[order], d[order], s[order], key[order]
    edge = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (s[1:] > s[:-1] + SPAN), [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(d[a]), int(key[a]), int(s[a]), int(s[b - 1]) + SPAN


def _gone(strings: DataFrame, parts: int) -> DataFrame:
    """(d, key, s, e): spans that go, of segments gathered by bucket."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of, kinds = ["d", "key", "s", "e"], [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        held: dict[bytes, tuple] = {}
        for batch in batches:
            ready = batch.filter(batch.column(5).is_null())
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays(ready.columns[1:5], names=names_of)
            out = []
            for blob in batch.column(5):
                for seg, *mine in _unpacked(blob.as_buffer()) if blob.is_valid else ():
                    have = held.get(seg)
                    if have is None:
                        held[seg] = mine
                        continue
                    first, later = (mine, have) if mine[:3] < have[:3] else (have, mine)
                    held[seg] = first
                    if first[:3] != later[:3]:
                        out.append((later[0], later[2], later[1], later[1] + len(seg)))
            if out:
                yield _batch(out, names_of, kinds)
        by: dict[int, list] = {}
        for seg, (d, s, key, name, twice) in held.items():
            by.setdefault(name, []).append((d, s, key, seg, twice))
        held.clear()
        some, size = [], 0
        for rows in by.values():
            if len(rows) > 1 or rows[0][4]:
                some += rows
                size += sum(len(r[3]) + 1 for r in rows)
                if size > MERGE:
                    yield from _sent(_compared(some), names_of, kinds)
                    some, size = [], 0
        if some:
            yield from _sent(_compared(some), names_of, kinds)

    return strings.repartition(parts, "bucket").mapInArrow(meet, "d long, key int, s int, e int")


def _sent(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for i in range(0, len(rows), 50_000):
        yield _batch(rows[i : i + 50_000], names, kinds)


_LEAST = -(1 << 63)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, d, key, text): key numbers the different texts of a doc_id, told apart by 128 bits of hashes.

    Only texts of ids that stand in several rows are exchanged; where there is none, all keys are 0.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("d"), "text")
    many = materialise(docs.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d"), "substrings-many")
    if many.isEmpty():
        return docs.select("doc_id", "d", F.lit(0).alias("key"), "text")
    if fits_broadcast(many, 1_000_000):
        many = F.broadcast(many)
    hashed = docs.join(many, "d", "left_semi").withColumn("h", F.xxhash64("text")).withColumn("i", F.xxhash64(F.lit(1), "text"))
    number = F.row_number().over(Window.partitionBy("d").orderBy("h", "i"))
    numbers = materialise(hashed.select("d", "h", "i").distinct().withColumn("key", number), "substrings-numbers")
    key = F.expr("if(key > 16777215, raise_error('more than 16777215 texts of one doc_id'), key)").cast("int")
    again = materialise(hashed.join(numbers, ["d", "h", "i"]).select("doc_id", "d", key.alias("key"), "text"), "substrings-again")
    return docs.join(many, "d", "left_anti").select("doc_id", "d", F.lit(0).alias("key"), "text").union(again)


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, d, key, text) and (d, key, s, e): spans that go."""
    small_batches(docs.sparkSession)
    keyed = _numbered(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * parts
    marks = _marked(keyed, buckets, parts).groupBy("d", "key").agg(F.collect_list("starts").alias("marks"))
    # equal rows of documents are cut once
    texts = keyed.join(marks, ["d", "key"]).dropDuplicates(["d", "key"]).select("d", "key", "text", "marks")
    return keyed, _gone(_strings(texts, buckets), parts)


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, text as binary, spans, again) of each row: spans that go, apart and sorted; again: a repeat of an earlier row."""
    keyed, gone = repeated(docs)
    gone = gone.groupBy("d", "key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    out = keyed.join(gone, ["d", "key"], "left")
    out = out.withColumn("again", F.row_number().over(Window.partitionBy("d", "key").orderBy("text")) > 1)
    return out.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "spans", "again")


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays of raw, the bytes removed, the runs that they made."""
    kept, at, runs, end = [], 0, 0, -1
    for s, e in spans:
        if s > end:
            runs += 1
        if s > at:
            kept.append(raw[at:s])
        at = max(at, e)
        end = max(end, e)
    kept.append(raw[at:])
    out = b"".join(kept)
    return out, len(raw) - len(out), runs


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans, again in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = raw.as_buffer().to_pybytes()
                spans = [(x["s"], x["e"]) for x in spans or []]
                kept, n, runs = cut(raw, [(0, len(raw))] if again and len(raw) >= SPAN else spans)
                rows.append((len(raw), n, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), pa.int64()) for c in cols[:3]], pa.array(list(cols[3]), pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP5_SQL = r"""
with d as (
  select row_number() over (order by doc_id nulls first) as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, unnest(range(0, len(h) // 2 - 99)) as p, h from d),
o as (select r, p, row_number() over (partition by substr(h, 2 * p + 1, 200) order by r, p) as k from w),
g as (select r, p, coalesce(p > lag(p) over (partition by r order by p) + 100, true) as new from o where k > 1),
i as (select r, p, sum(new::int) over (partition by r order by p) as n from g),
s as (select r, n, min(p) as a, max(p) + 100 as e from i group by r, n),
c as (select r, a, e, lag(e, 1, 0) over (partition by r order by a) as b from s),
x as (
  select d.r, count(c.a) as n_spans, coalesce(sum(c.e - c.a), 0) as gone, coalesce(max(c.e), 0) as last,
         coalesce(string_agg(substr(h, 2 * c.b + 1, 2 * (c.a - c.b)), '' order by c.a), '') as before
  from d left join c using (r) group by d.r)
select doc_id, (len(h) // 2)::bigint as n_bytes, gone::bigint as n_removed, n_spans::bigint as n_spans,
       sha256(unhex(before || substr(h, 2 * last + 1))) as kept_sha256
from d join x using (r)
"""
