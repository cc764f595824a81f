"""Tokens, files of ids, archives, chats, URLs: exact round trips and brute force."""

import base64
import gzip
import hashlib
import io
import json
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidegraph.llm import bpe, chat, huffman, urls, warc

TOKENIZER = Tokenizer.from_file(bpe.vocabulary_path())
random.seed(4)
ALPHABET = [chr(c) for c in [*range(0x250), *range(0x300, 0x400), 0x130, 0x1E9E, 0x212B, 0x1F600, 0x2028, 0x3000, 0x4E00, 0xAC00, 0x1100, 0x1161]]
TEXTS = ["".join(random.choice(ALPHABET) if random.random() < p else random.choice("etaoin shrdlué'ß,. .\n<|") for _ in range(random.randint(0, 40))) for p in (0.02, 0.3) for _ in range(400)]
TEXTS += [None, "", " \n", "Hello, world's <|endoftext|>x<|startoftext|>", "word " * 3000, "x" * 5000, "a\x1cb", "Ends. Here, too."]
DOCS = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "no id")]


def table(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)


def documents(spark, tmp_path, rows):
    table(spark, [(i, t, "ids") for i, t in rows], "doc_id long, text string, start string", f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_bpe_is_exact(spark, tmp_path):
    def spec(i, t):
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids
        back = TOKENIZER.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    got = bpe.op2_bpe(spark, documents(spark, tmp_path, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((spec(i, t) for i, t in DOCS), key=repr)


def test_bpe_of_the_vocabulary():
    e = bpe.Encoder(open(bpe.vocabulary_path(), encoding="utf-8").read())
    for t in e.token[::7]:
        text = t.replace("</w>", " ")
        assert np.frombuffer(e.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "Hi there", "k"), (2, None, None)], "doc_id int, text string, w string")
    out = bpe.decode(bpe.encode(df))
    assert out.columns == ["doc_id", "text", "w", "ids", "decoded"]
    assert [r["decoded"] for r in out.orderBy("doc_id").collect()] == ["hi</w> there</w>", ""]


@pytest.mark.parametrize("n,limit", [(1, 18), (2, 18), (50, 7), (3000, 12), (3000, 18)])
def test_huffman_codes(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.6, n) * 100).astype(np.int64)
    counts[0] += 1
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all() and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    for size in (1, 255, 256, 257, 1000):
        ids = rng.choice(n, size, p=counts / counts.sum()).astype(np.uint32)
        data, bits, blocks = huffman.pack(ids, lengths, huffman.canonical(lengths))
        assert bits == lengths[ids].sum() and len(blocks) == -(-size // huffman.BLOCK)
        assert (huffman.unpack(data, size, blocks, *huffman.decode_table(lengths, limit), limit) == ids).all()


def test_huffman_is_optimal_when_the_limit_allows():
    counts = np.array([1, 1, 2, 3, 5, 8, 13])
    assert (huffman.code_lengths(counts) * counts).sum() == 2 + 4 + 7 + 12 + 20 + 33  # merges of the plain algorithm


@pytest.mark.parametrize("segment", [1 << 20, 500])
def test_huffman_files(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(huffman, "SEGMENT", segment)
    of = lambda t: np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    want, at = [], 0
    for i, ids in sorted(((i, of(t)) for i, t in DOCS), key=lambda r: (r[0] is not None, r[0], r[1].astype("<u2").tobytes())):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = huffman.op8_huffman(spark, documents(spark, tmp_path, DOCS)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_huffman_of_nothing(spark, tmp_path):
    assert huffman.op8_huffman(spark, documents(spark, tmp_path, [])).count() == 0


def ids_of(of, texts):
    flat, ends = of(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def ids_by_library(texts):
    return [[*TOKENIZER.encode(t or "", add_special_tokens=False).ids, huffman.END] for t in texts]


def test_huffman_words_cut_without_the_library():
    """Latin words with capitals, digits and marks are cut into pieces, each of which is asked for once."""
    of = huffman._Ids(open(bpe.vocabulary_path(), encoding="utf-8").read())
    texts = ["Osmiez. ofthan### +1 (238) LAAI!! \u00c9tre,*** x", "osmiez ofthan$$$ \u0181\u023a.,. 4460307498010481", "Plain words, here. And there", None, " "]
    of.library = None
    assert ids_of(of, texts) == ids_by_library(texts)
    of.words = None  # all pieces are known, so other words of them are put together
    texts = ["OSMIEZ,*** Ofthan!! x44", "Words"]
    assert ids_of(of, texts) == ids_by_library(texts)


@pytest.mark.parametrize("cache", [2, 60, 450_000])
def test_huffman_words_forgotten(monkeypatch, cache):
    monkeypatch.setattr(huffman, "CACHE", cache)
    of = huffman._Ids(open(bpe.vocabulary_path(), encoding="utf-8").read())
    for k in range(0, len(TEXTS), 40):
        texts = ["the same words", *TEXTS[k : k + 40]]
        assert ids_of(of, texts) == ids_by_library(texts)
        assert cache > 60 or len(of.rows) <= 2 + cache


def test_huffman_special_tokens_by_their_case():
    of = huffman._Ids(open(bpe.vocabulary_path(), encoding="utf-8").read())
    texts = ["a\x1cb", "<|ENDOFTEXT|> x", "<|endoftext|> x"]
    assert ids_of(of, texts) == ids_by_library(texts)


def test_huffman_ids_of_a_vocabulary_with_case():
    spec = json.load(open(bpe.vocabulary_path(), encoding="utf-8")) | {"normalizer": None}
    texts = ["Abc, DEF. x", "don't 123", "plain words"]
    want = [[*Tokenizer.from_str(json.dumps(spec)).encode(t, add_special_tokens=False).ids, huffman.END] for t in texts]
    assert ids_of(huffman._Ids(json.dumps(spec)), texts) == want


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("zip64", [False, True])
def test_packages(zip64):
    out = io.BytesIO()
    w = warc.PackageWriter(out, zip64)
    for name, data in (("a", b"hello"), ("b/c", b"x" * 999)):
        w.begin(name)
        w.write(data[:3])
        w.write(data[3:])
        w.end()
    w.close()
    z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert z.testzip() is None and z.read("a") == b"hello"
    f = Bytes(out.getvalue())
    at, size = warc.members(f)["b/c"]
    f.seek(at)
    assert f.read(size) == b"x" * 999


def test_packages_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored")
        z.writestr("d", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"PK then a comment"
    f = Bytes(out.getvalue())
    found = warc.members(f)
    f.seek(found["s"][0])
    assert list(found) == ["s"] and f.read(found["s"][1]) == b"stored"
    with pytest.raises(ValueError):
        warc.members(Bytes(b"nothing here"))


def test_end_record_behind_its_own_bytes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored")
        z.comment = b"a PK\x05\x06" + b"comment of twenty-two bytes and more"
    assert list(warc.members(Bytes(out.getvalue()))) == ["s"]


@pytest.mark.parametrize("index", ["", "indexes/index.cdxj", "indexes/index.cdx.gz"])
def test_records_in_packages_of_others(spark, tmp_path, index):
    """An archive of another writer: a record that is no response, text or packed indexes in any order, or none."""
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    info = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    own = [gzip.compress(warc.record("response", i, "u", digest(b), len(b), b)) for i, b in ((1, b"x" * 200_000), (2, b"b"))]
    parts = [info, *own]
    starts = [sum(map(len, parts[:k])) for k in range(3)]
    lines = b"".join(warc.index_row("data.warc.gz", starts[k], len(parts[k])) for k in (2, 0, 1))
    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/data.warc.gz", b"".join(parts))
        if index:
            z.writestr(index, gzip.compress(lines) if index.endswith(".gz") else lines)
    files = spark.createDataFrame([(str(path),)], "file string")
    got = sorted(tuple(r) for r in warc.read(files, f"file://{tmp_path}").collect())
    assert got == [(1, 200_000, digest(b"x" * 200_000), "response", None), (2, 1, digest(b"b"), "response", None)]


PAGES = [(1, "u", "a"), (2, None, "a"), (3, "u\r\nX: y", "a"), (4, "u", None), (5, "u", ""), (None, "u", "a"), (None, "u", "zz"), (3, "u", "a"), (9, "é", "x" * 300_000), (10, "http://x: y", "\r\n\r\nq\U0001f600")]


@pytest.mark.parametrize("rows", [PAGES, []])
def test_warc(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(warc, "RANGE", 100)
    table(spark, [(*r, "k") for r in rows], "page_id long, url string, html string, keep string", f"{tmp_path}/pages.parquet")
    keep = {}
    for i, _, h in rows:
        if i is not None:
            keep[h or ""] = max(keep.get(h or "", i), i)

    def spec(i, h):
        b, to = (h or "").encode(), keep.get(h or "")
        kind = "response" if to is None or to == i else "revisit"
        return i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, None if kind == "response" else to

    assert sorted(map(tuple, warc.op1_warc(spark, str(tmp_path)).collect()), key=repr) == sorted((spec(i, h) for i, _, h in rows), key=repr)


TURNS = [(1, 0, None, None), (1, 0, None, "x"), (1, None, "assistant", "#\\<a"), (None, 1, "assistant", ""), (2, 1, "a: b</turn>", "y: z\n</turn>\n"), (2, 1, "a: b</turn>", "y: z\n</turn>\n"), (3, 0, "assistant", "q"), (3, 1, "assistant", "é")]


@pytest.mark.parametrize("rows", [TURNS, []])
def test_chat(spark, tmp_path, rows):
    table(spark, [(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, form string", f"{tmp_path}/conversations.parquet")
    said = r"\### Assistant: </turn> ok"
    every = [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]
    want = []
    for conv in {r[0] for r in every}:
        own = sorted((r for r in every if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        want.append((conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = [tuple(r)[:5] for r in chat.op9_chat(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ties_go_by_text_as_it_is(spark, tmp_path):
    said = [("#", "$"), ("a\t", "a"), ("\\\\", "a"), ("<", "A"), ("", "x")]
    rows = [(k, 0, "assistant", t, "k") for k, pair in enumerate(said) for t in pair[::-1]]
    table(spark, rows, "conv_id long, turn long, role string, text string, form string", f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["loss_sha256"] for r in chat.op9_chat(spark, str(tmp_path)).collect()}
    for k, pair in enumerate(said):
        a, b = sorted(pair)
        # "a" before a longer text that begins with it
        assert got[k] == hashlib.sha256((a + b).encode()).hexdigest(), pair


def test_typed_contents_that_are_odd(spark):
    rows = [(1, 0, "user", "not json [", ""), (1, 1, "user", '{"type": "text"}', ""), (1, 2, "assistant", '["plain", 7, {"type": "video", "ref": "v.mp4"}, {"type": "image", "width": "wide"}]', ""), (1, 3, "user", None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, form2 string")
    got = {r["turn"]: r["form"] for r in chat.format_turns(df, typed=True).collect()}
    assert got[0]["segment"] == "### user: not json [ </turn>\n" and got[1]["segment"] == '### user: {"type": "text"} </turn>\n' and got[3]["segment"] == "### user:  </turn>\n"
    assert got[2]["segment"] == "### assistant: plain7<video:0><image:1> </turn>\n"
    assert [(x["kind"], x["tokens"]) for x in got[2]["attached"]] == [("video", 0), ("image", 170)] and "v.mp4" in got[2]["attached"][0]["ref"]


def test_parts():
    made = chat.format_turn("assistant", [{"type": "text", "text": "see <"}, {"type": "image", "ref": "i.png", "width": 1024, "height": 100}, {"type": "audio", "seconds": 2.5}, {"type": "document", "pages": 3, "ref": "d"}, {"type": "text", "text": "ok"}])
    assert made["segment"] == "### assistant: see \\<<image:0><audio:1><document:2>ok </turn>\n"
    assert [made["segment"][a:b] for a, b in made["loss"]] == ["see \\<", "ok"]
    assert [(x["kind"], x["tokens"]) for x in made["attached"]] == [("image", 340), ("audio", 63), ("document", 1500)] and made["expanded_tokens"] == 1903
    assert chat.format_turn("user", [])["loss"] == []


URLS = [None, "nourl", "HTTP://Example.COM/en/7x?y", "x://com/en/", "x://a.notcom/en/", "a://b?c", "a://b://c/d#e", "://", "x://excom/en/7", "x://s.example.net/de/8", "x://net/de/", "x://b.org/es/q", "a\nb://h.org/es/\nz#f"]


def test_urls(spark, tmp_path):
    table(spark, [(i, u, "<title>Words of titles</title>", "k") for i, u in enumerate(URLS)], "page_id long, url string, html string, token string", f"{tmp_path}/pages.parquet")

    def spec(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(r, v) for r, v in urls.RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))

    got = {r["page_id"]: r for r in urls.op4_urls(spark, str(tmp_path)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = spec(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")


def test_urls_of_nothing(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_segmentation_is_the_cheapest():
    import itertools
    import math

    counts = {"the": 50, "rap": 5, "ist": 7, "therapist": 3, "he": 20, "a": 30, "t": 10}
    s = urls.Segmenter(counts, 1000)
    cost = lambda ws: sum(s.cost.get(w, s.unknown[len(w)]) for w in ws)
    for text in ("therapist", "thea", "zzhe", "atthe"):
        cuts = [[text[a:b] for a, b in itertools.pairwise([0, *c, len(text)])] for n in range(len(text)) for c in itertools.combinations(range(1, len(text)), n)]
        assert math.isclose(cost(s.words(text)), min(map(cost, cuts))) and "".join(s.words(text)) == text


def test_bayes_learns():
    counts, sums, docs = {"x": (9, 1), "y": (1, 9)}, (10, 10), (10, 10)
    assert urls.score(["y"], counts, sums, docs) > 0 > urls.score(["x"], counts, sums, docs) and urls.score(["q"], counts, sums, docs) == 0
    assert urls.score(["y"], counts, sums, (0, 5)) == 0
