"""Quality, decontamination, personal data, near-duplicates, repeated substrings: against brute force, on awkward rows."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pytest
import xxhash
from tidegraph.llm import decontam, pii, quality, simhash, substrings
from tidegraph.llm.common import shared_dir

EXTRA = "doc_id long, text string, w string, t string, n int, ids string"


def table(spark, rows, tmp_path, name="documents"):
    df = spark.createDataFrame([(i, t, "w", "t", 7, "x") for i, t in rows], EXTRA).repartition(3)
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def fresh(spark, rows):
    return spark.createDataFrame([(i, t, "w", "t", 7, "x") for i, t in rows], EXTRA)


random.seed(11)
WORDS = "a bb Ccc dé the of".split()
PROSE = [" ".join(random.choice(WORDS) for _ in range(random.randint(0, 120))) for _ in range(25)]
AWKWARD = [(None, "null id " * 30), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "x" * 70_000), (5, "y " * 9_000), (6, PROSE[3]), (6, PROSE[3]), (7, "a\nb\na\nb\n\na"), (8, "#$ ** %% !! " * 30)]
ROWS = AWKWARD + [(100 + i, t) for i, t in enumerate(PROSE)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def repeated(w):
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    return len({p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)})


def test_quality(spark, tmp_path):
    folder = table(spark, ROWS, tmp_path)
    got = sorted(map(tuple, quality.op3_quality(spark, folder).drop("kept").collect()), key=repr)

    def spec(i, t):
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        n = repeated(w)
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)

    assert got == sorted((spec(i, t) for i, t in ROWS), key=repr)


def test_quality_order_never_changes_the_verdict(spark):
    df = fresh(spark, ROWS)
    names = [r.name for r in quality.RULES]
    kept = [sorted(map(repr, quality.apply_rules(df, order=o).filter("rejected_by is null").select("doc_id").collect())) for o in (names, names[::-1])]
    assert kept[0] == kept[1] and quality.apply_rules(df, order=names).columns == [*df.columns, "rejected_by"]


def test_quality_measures_and_orders(spark):
    found = quality.measure(fresh(spark, ROWS))
    assert {m.name for m in found} == {r.name for r in quality.RULES} and [m.gain for m in found] == sorted((m.gain for m in found), reverse=True)
    assert [m.name for m in quality.measure(fresh(spark, []))] == [r.name for r in quality.RULES]


def test_quality_asks_no_further_than_the_first_rejection(spark):
    rules = (quality.Rule("first", "t like 'no%'"), quality.Rule("trap", "raise_error(concat('asked about ', t)) is null"))
    df = spark.createDataFrame([(1, "no one"), (2, "no two")], "doc_id long, text string")
    assert {r["rejected_by"] for r in quality.apply_rules(df, rules, ["first", "trap"]).collect()} == {"first"}
    assert quality.passing(df, rules, ["first", "trap"]).count() == 0
    with pytest.raises(Exception, match="asked about"):
        quality.apply_rules(df, rules, ["trap", "first"]).collect()


def test_quality_costs_stand_clear(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i * j % 997}" for j in range(800))) for i in range(300)], "doc_id long, text string")
    cheap, dear = quality.Rule("cheap", "n < 0"), quality.Rule("dear", "size(array_distinct(transform(w, x -> sha2(x, 256)))) < 0")
    for _ in range(2):
        by = {m.name: m for m in quality.measure(df, (dear, cheap))}
        assert by["dear"].seconds > 20 * by["cheap"].seconds and by["dear"].seconds > 1e-5


def norm(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def leaks(docs, bench):
    out = []
    for i, t in docs:
        w, hit, items = norm(t), set(), set()
        for item, b in bench:
            b = norm(b)
            n = min(10, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    items.add(str(item))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


BENCH = [(1, PROSE[0] + " q r s t u v w x y z k"), (22, "of the bb"), (3, None), (4, "y " * 12), (5, "É"), (6, "é"), (7, "null ID null id null id null id null id")]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_ROWS, 0])
def test_decontamination(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    folder = table(spark, ROWS, tmp_path)
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert sorted(map(tuple, decontam.op10_decontamination(spark, folder).collect()), key=repr) == leaks(ROWS, BENCH)
    kept = decontam.decontaminate(fresh(spark, ROWS), spark.createDataFrame(BENCH, "item_id long, text string"))
    assert kept.columns == fresh(spark, []).columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(x[0]) for x in leaks(ROWS, BENCH) if not x[-1])


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(fresh(spark, ROWS), bench).filter("contaminated").isEmpty()
    assert decontam.report(fresh(spark, []), bench).count() == 0


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def personal(t):
    t = t or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def test_personal_data(spark, tmp_path):
    bits = ["a", "b@", "@", "c.d", ".", "1", "22", "255", "256", "-", " ", "+", "4", "(", ")", "é", "😀", "4111111111111111", "4111 1111 1111 1111", "--", "\n", "_"]
    rows = AWKWARD + [(1000 + i, "".join(random.choice(bits) for _ in range(random.randint(0, 40)))) for i in range(400)] + [(9, "a@b.c_d@e.f x@y.z.x@q.r")]
    rows += [(50 + i, c * 30_000) for i, c in enumerate(("1", "1-", "1 ", "a@b.co "))]
    got = {repr((r["doc_id"], r["base_sha256"])) for r in pii.op6_pii(spark, table(spark, rows, tmp_path)).collect()}
    assert got == {repr((i, hashlib.sha256(personal(t).encode()).hexdigest())) for i, t in rows}


def test_contexts_discover_what_looks_otherwise(spark):
    rows = [(i, f"word{chr(97 + i % 26)} mailto user{i}@host{i}.org please say more") for i in range(30)] + [(99, "then mailto user77-at-host please say"), (100, "the year2024x was good and user77-at-host")]
    spans = {r["doc_id"]: [(x["kind"], r["text"][x["s"] : x["e"]]) for x in r["_p_spans"]] for r in pii.extract(fresh(spark, rows)).collect()}
    assert spans[99] == [("email", "user77-at-host")] == spans[100] and len(spans[0]) == 1


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a.b@c.de or +1 (743) 555-3824!", 33), (2, None, None), (3, "4111 1111 1111 1111", 19)], "doc_id int, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "to [EMAIL] or [PHONE]!", 22), (2, None, None), (3, "[CARD]", 6)]


def prints(t, k=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    got = {(r["doc_id"], r["_s_fp"] & (1 << 64) - 1) for r in simhash.fingerprints(fresh(spark, ROWS).select("doc_id", "text")).collect()}
    assert got == {(i, prints(t)) for i, t in ROWS}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_components_lose_no_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(600):  # chains of 1 to 4 bits from one another
        x = rng.choice(values)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        values.append(x)
    for _ in range(150):  # many under one anchor, of other halves that differ in a few bits
        x = values[0] ^ rng.getrandbits(6) << 40
        values += [x, x ^ 7 << rng.randint(40, 60), x ^ 1 << rng.randint(0, 31) ^ 1 << 5]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    top = list(range(len(values)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, a in enumerate(values):
        for j in range(i):
            if ((a ^ values[j]) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                top[y] = x
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    assert {r["fp"]: r["root"] for r in simhash.components(df).collect()} == {v: values[find(i)] for i, v in enumerate(values)}


def test_near_duplicates_and_keep_one(spark):
    near = simhash.near_duplicates(fresh(spark, ROWS).select("doc_id", "text"))
    same = {r["doc_id"]: r["_s_component"] for r in near.filter("doc_id in (1, 2, 3)").collect()}
    assert same == {1: 1, 2: 1, 3: 1} and near.count() == len(ROWS)
    kept = simhash.keep_one(fresh(spark, ROWS))
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and ids.count(2) == 0 and kept.columns == fresh(spark, []).columns
    assert simhash.keep_one(fresh(spark, [])).count() == 0


def test_similar_texts_keep_one(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, group = [], {}
    for g in range(12):
        base = [word() for _ in range(150)]
        for k in range(4):
            copy = list(base)
            for at in rng.sample(range(150), 2 * bool(k)):  # two words: similarity of about 0.87
                copy[at] = word()
            rows.append((10 * g + k, " ".join(copy)))
            group[10 * g + k] = g
    kept = [group[r["doc_id"]] for r in simhash.keep_one(fresh(spark, rows)).collect()]
    assert sorted(kept) == list(range(12))
    assert simhash.keep_one(fresh(spark, rows), similarity=None).count() > 12


def cut_spec(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                mark[a : a + 100] = b"\1" * 100
            seen.add(raw[a : a + 100])
        runs = sum(1 for k in range(len(raw)) if mark[k] and not (k and mark[k - 1]))
        out.append((i, len(raw), sum(mark), runs, hashlib.sha256(bytes(b for b, m in zip(raw, mark) if not m)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("stretch", [1 << 20, 512])
def test_substrings(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    rng = random.Random(2)
    parts = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (90, 99, 100, 101, 130, 180, 300, 1000)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(200, "ab" * 900), (201, "x" * 500), (202, "x" * 99), (203, None), (204, ""), (205, parts[6]), (205, parts[6]), (None, parts[7]), (206, "z" + "ab" * 300), (207, ("abcdefg" * 30 + "#") * 9)]
    assert sorted(map(tuple, substrings.op5_substrings(spark, table(spark, rows, tmp_path)).collect()), key=repr) == cut_spec(rows)


def test_substrings_of_nothing(spark, tmp_path):
    assert substrings.op5_substrings(spark, table(spark, [], tmp_path)).count() == 0


def jaccard_components(rows, shingle=5, similarity=0.8):
    """Groups of row numbers that sets of shingles at least so similar join, by brute force."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    top = list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            met = len(a & sets[j])
            if 10 * met >= 10 * similarity * (len(a) + len(sets[j]) - met):
                top[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def kept_groups(spark, rows):
    group = dict(zip((i for i, _ in rows), jaccard_components(rows)))
    kept = [group[r["doc_id"]] for r in simhash.keep_one(fresh(spark, rows)).select("doc_id").collect()]
    return kept, set(group.values())


def test_pairs_in_hot_buckets_keep_one(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for p in range(3):  # a passage that 130 documents share, strangers otherwise; 40 pairs among them
        passage = [word() for _ in range(145)]
        texts = []
        for _ in range(90):
            texts.append(passage + [word() for _ in range(55)])
        for t in texts[:40]:
            copy = list(t)
            for at in rng.sample(range(145, 200), 3):
                copy[at] = word()
            texts.append(copy)
        rng.shuffle(texts)
        rows += [(1000 * p + i, " ".join(t)) for i, t in enumerate(texts)]
    kept, groups = kept_groups(spark, rows)
    assert sorted(kept) == sorted(groups)


def test_all_texts_of_a_fingerprint_component_are_compared(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(60):  # original, a copy of it that comes first, and one that is like the original only
        base = [word() for _ in range(200)]
        near, far = list(base), list(base)
        near[rng.randrange(5, 90)] = word()
        for at in (110, 130, 150, 170):
            far[at] = word()
        rows += [(10 * g, " ".join(near)), (10 * g + 1, " ".join(base)), (10 * g + 2, " ".join(far))]
    kept, groups = kept_groups(spark, rows)
    assert sorted(kept) == sorted(groups)


def test_pairs_at_the_very_similarity_keep_one(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(600):  # of 94 words the last 10 differ: 80 shingles of 90 + 10 are shared
        base = [word() for _ in range(94)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base[:84] + [word() for _ in range(10)]))]
    kept, groups = kept_groups(spark, rows)
    assert len(groups) == 600 and sorted(kept) == sorted(groups)


def test_texts_of_one_id_that_agree_in_24_bits(spark, tmp_path):
    rng = random.Random(17)
    seen, rows = {}, []
    while len(rows) < 6:
        t = "%x" % rng.getrandbits(600)
        other = seen.setdefault(xxhash.xxh64_intdigest(t, 42) & 0xFFFFFF, t)
        if other != t:
            rows += [(None, other), (None, t)]
    rows += [(1, "z" * 20), (3, rows[0][1] + "tail")]
    assert sorted(map(tuple, substrings.op5_substrings(spark, table(spark, rows, tmp_path)).collect()), key=repr) == cut_spec(rows)


def test_contexts_discover_over_three_hops(spark):
    texts = [f"mailto user{i}@host{i}.org please" for i in range(120)]
    texts += [x for i in range(25) for x in (f"mailto aaaaa{i} please", f"alpha aaaaa{i} pour")]
    texts += [x for i in range(5) for x in (f"alpha bbbbb{i} pour", f"beta bbbbb{i} bitte")]
    rows = list(enumerate(texts)) + [(999, "beta ccccc1 bitte"), (1000, "gamma ddddd1 gracias")]
    spans = {r["doc_id"]: [(x["kind"], r["text"][x["s"] : x["e"]]) for x in r["_p_spans"]] for r in pii.extract(fresh(spark, rows)).collect()}
    assert spans[999] == [("email", "ccccc1")] and spans[1000] == []


def rounds(meets):
    """What contexts make known, by brute force: meets (kind, inst, pat)."""
    meets, known = set(meets), {}
    while True:
        now = {(k or known.get(i, ""), i, p) for k, i, p in meets}
        by = {}
        for k, i, p in now:
            by.setdefault(p, []).append(k)
        doubt = {}
        for p, kinds in by.items():
            n, to = max(((n, k) for k, n in Counter(kinds).items() if k), default=(0, ""))
            if n >= pii.SUPPORT and n >= pii.PRECISION * len(kinds):
                for k, i, q in now:
                    if q == p and not k:
                        doubt[i, to] = doubt.get((i, to), 1.0) * max(1 - n / len(kinds), 1e-9)
        new = {}
        for (i, to), x in sorted(doubt.items(), key=lambda y: (y[1], y[0])):
            if x <= pii.DOUBT and i not in new:
                new[i] = to
        if not new:
            return known
        known |= new


def test_rounds_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        word, n = rng.choice(["mail", "reach", "host", "see"]), rng.randrange(1000)
        what = rng.choice([f"user{n}@example.org", f"acct-{n}", f"10.0.{n % 250}.7", f"{n}x{n}"])
        far = " " * rng.choice([1, 90])  # further than any window of characters
        rows.append((i, f"please {word}:{far}{what}{far}{rng.choice(['today', 'soon'])} thanks"))
    rows += [(200 + i, f'api token = "{rng.getrandbits(160):040x}" end') for i in range(9)] + [(300, 'api token = "QX77-K1" end'), (301, "built in 2024 by 3 people")]
    found = pii.spans(fresh(spark, rows))
    meets = [(x["kind"], x["inst"], p) for r in found.collect() for x in [*r["_p_base"], *r["_p_more"]] for p in x["pats"]]
    got = {r["inst"]: r["kind"] for r in pii.discovered(found).collect()}
    assert got == rounds(meets) and got["QX77-K1"] == "secret" and "2024" not in got
    spans = {r["doc_id"]: [x["kind"] for x in r["_p_spans"]] for r in pii.extract(fresh(spark, rows)).collect()}
    assert spans[200] == spans[300] == ["secret"] and spans[301] == []


def test_crowds_of_near_copies_stay_off_the_driver(spark):
    bits = [(i, j, k) for i in range(30) for j in range(i) for k in range(j)]  # one component, far more shared words than files tell of
    values = [0x1234_5678 << 32 ^ 1 << i ^ 1 << j ^ 1 << k for i, j, k in bits]
    spark.conf.set("spark.sql.maxBroadcastTableSize", 10_000_000)
    try:
        got = {(r["fp"], r["root"]) for r in simhash.components(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == {(v, min(values)) for v in values}


def test_texts_that_pack_well_stay_off_the_driver(spark):
    rng = random.Random(12)
    word = lambda: "abcdefghij" * 10 + str(rng.randrange(10**6))
    rows = []
    for g in range(350):  # 14 MB of text, in files of far less
        base = [word() for _ in range(200)]
        copy = list(base)
        for at in (40, 90, 140):
            copy[at] = word()
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(copy))]
    spark.conf.set("spark.sql.maxBroadcastTableSize", 10_000_000)
    try:
        kept, groups = kept_groups(spark, rows)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(kept) == sorted(groups)


def test_rounds_over_few_edges_take_little(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(63) for _ in range(400)]
    chains = [values[k : k + 20] for k in range(0, 400, 20)]
    rows = [e for c in chains for e in zip(c, c[1:])]
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1k"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("few", "")
    try:
        nodes, edges = spark.createDataFrame([(v,) for v in values], "fp long"), spark.createDataFrame(rows, "a long, b long")
        got = {r["fp"]: r["root"] for r in simhash._components(nodes, edges, "few").collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {v: min(c) for c in chains for v in c}
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few") for s in told.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(told.getStageInfo, stages) if x)  # Spark forgets those that it skipped, and old ones
    left = [p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("few-*")]
    assert tasks < 600 and len(left) == 1, (tasks, left)  # one table is what the result reads
