"""WARC records in ZIP packages, written and range-read without extraction.

A package is a ZIP archive of stored (not compressed) members: `archive/data.warc.gz`, records as one gzip member each,
and `indexes/index.cdx`, a line a record whose JSON says where it lies. The reader looks for the end record in the last
bytes of a package, follows the ZIP64 locator where a count or offset does not fit, parses the central directory, takes
from a member's local header where its bytes begin, reads the indexes under `indexes/` (plain or gzip), and then reads
records by byte ranges of the package: nothing is extracted, and ranges of one package go to different tasks. Archives
under `archive/` that no index names are walked record by record to find where each lies.

Payloads that are equal (by SHA-256) share one response, that with the largest page_id; the rest are revisits
that carry the headers only. Before the exchange that tells which, a batch drops the payloads of rows that one of their
own batch outlives, and the rest are compressed; the exchange spreads the rows of one payload over SALTS keys.

Cases: null html is an empty payload; a null page_id is never a response for others, and its record is a response if no
row of its group has an id; rows that repeat the largest page_id are all responses; a null url is an empty target; very long
payloads are one record; an empty table makes no package; other columns are not kept.
"""

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, ship, table

ship(__name__)
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Keys over which rows of one payload are spread.
SALTS = 16
#: Bytes of records that a task reads at a time.
RANGE = 8 << 20
_BIG32, _BIG16 = 0xFFFFFFFF, 0xFFFF


def record(kind: str, page_id: int | None, url: str, digest: str, size: int, payload: bytes, refers: int | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x), payload


class PackageWriter:
    """Writes stored members one after another to a stream; ZIP64 fields where they are needed, or always."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.always, self.at, self.members = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # sizes follow the data (bit 3), in 64 bits since the extra field is there
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 33, 0, _BIG32, _BIG32, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        at = self.size
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._write(data)
        return at

    def end(self) -> None:
        self._write(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        start = self.at
        for name, crc, size, at in self.members:
            big = [x for x in (size, size, at) if self.always or x >= _BIG32]
            short = [_BIG32 if self.always or x >= _BIG32 else x for x in (size, at)]
            extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 33, crc, short[0], short[0], len(name), len(extra), 0, 0, 0, 0, short[1]) + name + extra)
        size, n, at = self.at - start, len(self.members), self.at
        if self.always or start >= _BIG32 or size >= _BIG32 or n >= _BIG16:
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", 0x07064B50, 0, at, 1))
            n, size, start = _BIG16, _BIG32, _BIG32
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0))


def members(f) -> dict[str, tuple[int, int]]:
    """Stored members of an open package: name to (where its bytes begin, their number)."""
    size = f.size()
    tail = min(size, 22 + 0xFFFF + 20)
    f.seek(size - tail)
    raw = f.read(tail)
    at = raw.rfind(b"PK\x05\x06")
    # the comment after it may hold these bytes as well: its length must lead to the end
    while at >= 0 and (at + 22 > len(raw) or at + 22 + struct.unpack_from("<H", raw, at + 20)[0] != len(raw)):
        at = raw.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP package: no end record")
    _, _, _, _, n, length, start, _ = struct.unpack_from("<IHHHHIIH", raw, at)
    if (n == _BIG16 or length == _BIG32 or start == _BIG32) and raw[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", raw, at - 12)
        f.seek(where)
        _, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", f.read(56))
    f.seek(start)
    listing, at, out = f.read(length), 0, {}
    for _ in range(n):
        mark, _, _, _, method, _, _, _, packed, plain, name, extra, comment, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", listing, at)
        if mark != 0x02014B50:
            raise ValueError("broken central directory")
        label = listing[at + 46 : at + 46 + name].decode()
        fields, k = listing[at + 46 + name : at + 46 + name + extra], 0
        while k + 4 <= len(fields):
            tag, size = struct.unpack_from("<HH", fields, k)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{size // 8}Q", fields, k + 4))
                plain = wide.pop(0) if plain == _BIG32 else plain
                packed = wide.pop(0) if packed == _BIG32 else packed
                local = wide.pop(0) if local == _BIG32 else local
            k += 4 + size
        if method == 0:
            f.seek(local)
            head = f.read(30)
            out[label] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        at += 46 + name + extra + comment
    return out


def index_row(name: str, offset: int, length: int) -> bytes:
    return b"- - " + json.dumps({"offset": str(offset), "length": str(length), "filename": name}).encode() + b"\n"


def _walked(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member in size bytes from start."""
    at, end = start, start + size
    while at < end:
        f.seek(at)
        inflate, taken = zlib.decompressobj(31), 0
        while not inflate.eof:
            piece = f.read(min(1 << 16, end - at - taken))
            if not piece:
                raise ValueError("an archive ends within a record")
            taken += len(piece)
            inflate.decompress(piece)
        taken -= len(inflate.unused_data)
        yield at, taken
        at += taken


def located(f) -> list[tuple[int, int]]:
    """(offset in the package, length) of every record of an open package, each once, in order."""
    found, rows, known = members(f), set(), set()
    for name, (at, size) in found.items():
        if name.startswith("indexes/") and name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            f.seek(at)
            raw = f.read(size)
            for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).splitlines():
                brace = line.find(b"{")
                if brace >= 0:
                    entry = json.loads(line[brace:])
                    member = "archive/" + entry["filename"].removeprefix("archive/")
                    known.add(member)
                    rows.add((found[member][0] + int(entry["offset"]), int(entry["length"])))
    for name, (at, size) in found.items():
        if name.startswith("archive/") and name.endswith(".warc.gz") and name not in known:
            rows.update(_walked(f, at, size))
    return sorted(rows)


def _uri(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, zip64: bool = False, least: int = 0) -> DataFrame:
    """Write (page_id, url, html) as packages. least: payloads of fewer bytes are always responses. A row a package: (file)."""

    @F.pandas_udf("struct<digest:string,size:long,gz:binary>")
    def pack(ids: pd.Series, urls: pd.Series, html: pd.Series, same: pd.Series) -> pd.DataFrame:
        # the largest id of each payload in the batch: whoever has less is a revisit, whatever other batches hold
        top = ids.groupby(same).transform("max")
        rows = []
        for i, u, h, t in zip(ids, urls, html, top):
            body = h.encode() if isinstance(h, str) else b""
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if len(body) >= least and not pd.isna(t) and (pd.isna(i) or i < t):
                rows.append((digest, len(body), None))
                continue
            raw = record("response", None if pd.isna(i) else int(i), u if isinstance(u, str) else "", digest, len(body), body)
            rows.append((digest, len(body), gzip.compress(raw, 5, mtime=0)))
        return pd.DataFrame(rows, columns=["digest", "size", "gz"])

    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("same"))
    keeps = keyed.filter(F.octet_length(body) >= least).groupBy("same").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    keeps = keeps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    packed = keyed.select("page_id", "url", "same", pack("page_id", "url", "html", "same").alias("x")).select("page_id", "url", "same", "x.*")
    told = packed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(keeps, ["same", "salt"], "left")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, base = _uri(folder)
        store.create_dir(base)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        out, index = None, bytearray()
        for batch in batches:
            for i, u, digest, size, gz, keep in zip(batch["page_id"], batch["url"], batch["digest"], batch["size"], batch["gz"], batch["keep"]):
                if out is None:
                    stream = store.open_output_stream(f"{name}.part")
                    out = PackageWriter(stream, zip64)
                    out.begin(DATA)
                if not pd.isna(keep) and (pd.isna(i) or int(i) != int(keep)):
                    gz = gzip.compress(record("revisit", None if pd.isna(i) else int(i), u if isinstance(u, str) else "", digest, int(size), b"", int(keep)), 5, mtime=0)
                index += index_row(DATA.removeprefix("archive/"), out.write(gz), len(gz))
        if out is not None:
            out.end()
            out.begin(INDEX)
            out.write(bytes(index))
            out.end()
            out.close()
            stream.close()
            store.move(f"{name}.part", name)
            yield pd.DataFrame({"file": [name]})

    return told.select("page_id", "url", "digest", "size", "gz", "keep").mapInPandas(save, "file string")


def read(packages: DataFrame, folder: str) -> DataFrame:
    """packages: (file). (page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit; ids that are no page's are null."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _uri(folder)
        for batch in batches:
            for name in batch["file"]:
                with store.open_input_file(name) as f:
                    rows = located(f)
                out, first = [], 0
                for k, (offset, length) in enumerate(rows):
                    if k == len(rows) - 1 or offset + length - rows[first][0] >= RANGE or rows[k + 1][0] != offset + length:
                        out.append((name, rows[first][0], [n for _, n in rows[first : k + 1]]))
                        first = k + 1
                yield pd.DataFrame(out, columns=["file", "at", "lengths"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _uri(folder)
        page = lambda x: int(x[len("<urn:page:") : -1]) if x and x.startswith("<urn:page:") and x != "<urn:page:>" else None
        for batch in batches:
            for name, at, lengths in zip(batch["file"], batch["at"], batch["lengths"]):
                rows = []
                with store.open_input_file(name) as f:
                    f.seek(at)
                    for n in lengths:
                        warc, http, payload = parse_record(gzip.decompress(f.read(int(n))))
                        if warc["WARC-Type"] not in ("response", "revisit"):
                            continue
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        digest = warc.get("WARC-Payload-Digest", "sha1:" + own).removeprefix("sha1:")
                        if warc["WARC-Type"] == "response" and own != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((page(warc["WARC-Record-ID"]), int(http.get("Content-Length", len(payload))), digest, warc["WARC-Type"], page(warc.get("WARC-Refers-To"))))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    found = packages.mapInPandas(ranges, "file string, at long, lengths array<long>")
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts).mapInPandas(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialise

    folder = scratch(spark, "warc")
    return read(materialise(write(table(spark, sf_dir, "pages"), folder), "warc-files"), folder)
