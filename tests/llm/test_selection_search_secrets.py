"""Resampling, ranked search and secret scans against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import resampling, search, secrets

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in TERM.findall(text or "")]


def plain_features(text, sizes):
    words = terms(text)
    return [" ".join(words[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)]


def plain_scores(rows, target, sizes=(1, 1), buckets=10_000, seed=2024):
    def counts(texts):
        found = Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, sizes))
        return [found[b] for b in range(buckets)]

    s, t = counts([x for _, x in rows]), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for name, text in rows:
        own = [gain[zlib.crc32(f.encode()) % buckets] for f in plain_features(text, sizes)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append((name, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms(text))))
    return out


def plain_resample(rows, target, percent, least, **settings):
    scored = plain_scores(rows, target, **settings)
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return [(*r[:4], None) for r in scored], [(*r[:4], k + 1) for k, r in enumerate(drawn)]


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3), (2, 2)])
def test_resampling_equals_plain_python(spark, docs, texts, sizes, monkeypatch):
    monkeypatch.setattr(resampling, "LAST", 1)
    target = spark.createDataFrame([("a", "W1b w2c Élan w3d"), ("b", None), ("c", "w7h w8i w7h")], "item string, text string")
    got = resampling.resample(docs, target, percent=60, least_words=5, sizes=sizes)
    rows = [tuple(r) for r in got.select("row.doc_id", "n_features", "weight", "score", "rank").collect()]
    scores, drawn = plain_resample([(i, t) for i, t, _, _ in texts], ["W1b w2c Élan w3d", None, "w7h w8i w7h"], 60, 5, sizes=sizes)
    assert Counter(r[:4] for r in rows) == Counter(r[:4] for r in scores)
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, len(drawn) + 1))
    assert [r[3] for r in sorted((r for r in rows if r[4]), key=lambda r: r[4])] == [r[3] for r in drawn]
    assert got.select("row.*").columns == docs.columns


def test_cutoff_is_exact_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(resampling, "LAST", 5)
    rng = random.Random(3)
    keys = [rng.randrange(-50, 50) if rng.random() < 0.6 else 7 for _ in range(5000)] + [rng.randrange(-(10**18), 10**18) for _ in range(800)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    ordered = sorted(keys)
    for wanted in (1, 700, 3600, 5800):
        value = ordered[wanted - 1]
        assert resampling.cutoff(frame, wanted) == (value, ordered.index(value), ordered.count(value))
    names = spark.createDataFrame([(f"n{k}",) for k in keys], "k string")
    ordered = sorted(f"n{k}" for k in keys)
    assert resampling.cutoff(names, 3000)[0] == ordered[2999]


def test_ties_go_to_the_smaller_id_and_copies_are_counted(spark):
    rows = [(i % 40 if i < 400 else None, "one two three") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resample(frame, frame.select("text"), percent=50, least_words=1).select("row.doc_id", "score", "rank").toPandas()
    drawn = got.dropna(subset="rank")
    assert len(got) == 600 and sorted(drawn["rank"]) == list(range(1, 301))
    want = sorted(((-r[3], r[0] is None, r[0] or 0) for r in plain_scores(rows, [t for _, t in rows])))[:300]
    assert sorted(-drawn["score"]) == [w[0] for w in want]


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,0)"])
def test_ids_of_other_types(spark, kind):
    raw = spark.range(40).select((F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")) if kind == "date" else F.col("id")).cast(kind).alias("doc_id"), F.lit("one two three").alias("text"))
    got = resampling.resample(raw.union(raw.limit(1).select(F.lit(None).cast(kind), "text")), raw.select("text"), percent=50, least_words=1)
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 21)) and got.schema["row"].dataType["doc_id"].dataType == raw.schema["doc_id"].dataType
    found = search.search(search.build(raw), raw.limit(1).select(F.lit("q").alias("item_id"), "text"), 5).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.rank)] == [r.doc_id for r in raw.orderBy("doc_id").limit(5).collect()]


def test_resampling_of_nothing(spark, docs, nothing):
    assert resampling.resample(nothing, docs).count() == 0
    assert resampling.resample(docs, nothing.select("text"), percent=0).filter("rank IS NOT NULL").count() == 0
    assert resampling.resample(docs, nothing.select("text"), percent=100, least_words=1).filter("rank IS NOT NULL").count() == 13


def plain_search(rows, items, k):
    held = [(i, terms(t)) for i, t in rows]
    held = [(i, w) for i, w in held if w]
    total, lists = sum(len(w) for _, w in held), defaultdict(list)
    for at, (_, words) in enumerate(held):
        for word, tf in Counter(words).items():
            lists[word].append((at, tf))
    out = []
    for item, text in items:
        scores = Counter()
        for word in set(terms(text)):
            weight = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * len(lists[word]) + 1)))
            for at, tf in lists[word]:
                length = 100 - 50 + (50 * len(held[at][1]) * len(held)) // total
                scores[at] += weight * ((1000000000 * tf) // (1000 * tf + 20 * length))
        best = sorted(((-s, held[at][0] is None, held[at][0] or 0) for at, s in scores.items() if s > 0))[:k]
        out += [(item, n + 1, None if no else i, -s) for n, (s, no, i) in enumerate(best)]
    return out


@pytest.mark.parametrize(("k", "size"), [(1, 2), (3, 4), (50, 8192)])
def test_search_equals_all_scores(spark, docs, texts, k, size, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", size)
    items = [("q1", "w3d W10a w17h niño"), ("q1", "w3d W10a w17h niño"), (None, "nothing known here"), ("q3", None), ("q4", ""), ("q5", " ".join(texts[0][1].split()[:40]))]
    frame = spark.createDataFrame(items, "item_id string, text string")
    got = search.search(search.build(docs), frame, k)
    assert Counter(map(tuple, got.collect())) == Counter(plain_search([(i, t) for i, t, _, _ in texts], items, k))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_over_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 40)
    monkeypatch.setattr(search, "CHUNK_BYTES", 300)
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(300)]
    rows = [(i // 2, " ".join(rng.choice(vocabulary[: 1 + int(300 * rng.random() ** 2)]) for _ in range(rng.randrange(1, 80)))) for i in range(900)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.randrange(1, 12)))) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = search.search(search.build(frame), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert Counter(map(tuple, got.collect())) == Counter(plain_search(rows, items, 10))


def test_pair_bounds_are_bounds_and_tighter():
    rng = random.Random(4)
    for _ in range(200):
        count = rng.randrange(1, 9)
        holds = [[rng.randrange(1, 100) if rng.random() < 0.4 else 0 for _ in range(30)] for _ in range(count)]
        maxima = {t: max(h) for t, h in enumerate(holds)}
        pairs = [(t, t + 1) for t in range(0, count - 1, 2)]
        joint = {(a, b): max((x + y for x, y in zip(holds[a], holds[b]) if x and y), default=0) for a, b in pairs}
        order = sorted(maxima, key=maxima.__getitem__)
        found = search.bounds(order, pairs, maxima, joint)
        for n in range(count + 1):
            reached = max((sum(holds[t][d] for t in order[:n]) for d in range(30)), default=0)
            assert reached <= found[n] <= sum(maxima[t] for t in order[:n])
    assert search.bounds([0, 1], [(0, 1)], {0: 5, 1: 7}, {}) == [0, 5, 7]


def test_search_of_nothing(spark, docs, nothing):
    asked = spark.createDataFrame([("q", "w3d")], "item_id string, text string")
    assert search.search(search.build(nothing), asked).count() == 0
    assert search.search(search.build(docs), asked.limit(0)).count() == 0


def plain_base(text):
    """The base spans, character by character."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    out, value = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
        end = None
        if word:
            k = at + len(word)
            k += text[k : k + 1] in ('"', "'") and k < len(text)
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] in (":", "=") and k < len(text):
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ('"', "'") and k < len(text)
                stop = k
                while stop < len(text) and text[stop] in value:
                    stop += 1
                if stop > k:
                    end = stop
                    if stop - k >= 6:
                        out.append((at, 0, f"assign:{at}:{stop}"))
        at = end or at + 1
    for kind, first, least, order in (("access", "AKIA", 20, 1), ("hex", "", 24, 2)):
        digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" if first else "0123456789abcdef"
        at = 0
        while at < len(text):
            end = at + len(first)
            if text.startswith(first, at) and end < len(text) and text[end] in digits:
                while end < len(text) and text[end] in digits:
                    end += 1
                if end - at >= least:
                    out.append((at, order, f"{kind}:{at}:{end}"))
                at = end
            else:
                at += 1
    return [s for _, _, s in sorted(out)]


PARTS = [
    "password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abcdef", "x", "KelvinKey", "toKen", "ſecret", "AKIA", "0123456789ABCDEF", "ABCD1234",
    "0123456789abcdef", "deadbeef", "\n", "é", "𝒳", "token=token: abcdefgh", "-._/+", "-----",
]


def test_base_spans_equal_a_scan_by_characters():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30)))
        got = [f"{k}:{a}:{b}" for k, a, b, _, _ in secrets.spans(text) if k != "literal"]
        assert got == plain_base(text), text


@pytest.mark.parametrize(("text", "found"), [
    ('DEFAULT = "Tr0ub4dor&3"\nother = DEFAULT\nclient.credential = other', ["Tr0ub4dor&3"]),
    ('const dbPwd = "S3cr3t!" + "tail9";', ["S3cr3t!", "tail9"]),
    ("os.environ['DB_PWD'] = 'q9w8e7r6'", ["q9w8e7r6"]),
    ('{"private_key": "MIIEpAIBAAKCAQEA7"}', ["MIIEpAIBAAKCAQEA7"]),
    ("signing_key: str = 'ab12cd34ef'", ["ab12cd34ef"]),
    ("mysql --passphrase s3kr1tpass99 --user bob", ["s3kr1tpass99"]),
    ("export DB_PWD=k8Jd92kfQ1\n", ["k8Jd92kfQ1"]),
    ("<passphrase>x9y8z7w6v5</passphrase>", ["x9y8z7w6v5"]),
    ("pwd := \"${DB_PASSWORD}\"", []), ('max_pins = "4096000x"', []), ("pwd_file = '/etc/passphrase/one'", []), ('if pwd == "comparison1": pass', []),
    ("the key: nothing special here, auth: basic", []), ("a = b\nb = a\npwd = a", []), ("pwd = getPwd2()", []), ('title = "Tr0ub4dor&3"', []),
    ("password = 'hunter2hunter'", []),  # a base span covers it
])
def test_literals_that_reach_a_sensitive_name(text, found):
    assert [text[a:b] for k, a, b, _, _ in secrets.spans(text) if k == "literal"] == found


@pytest.mark.parametrize("piece", ["a-", "a1.", "x=", 'x="\\', "pwd: ", "x = y(", "x:int", "--a=", "<a>", "'a'+", "secret", "token=", "pwd=a::"])
def test_long_monotonous_texts_take_linear_time(piece):
    started = time.monotonic()
    secrets.spans("token pwd =: </" + piece * (400_000 // len(piece)))
    assert time.monotonic() - started < 20


def test_scan_and_mask_every_row(spark, nothing):
    rows = [(1, "x token = \"ad9b9ab81594e97f2d82ac69ac6544142c4f1d40\" y"), (1, None), (None, ""), (2, "é" * 90_000 + " pwd='q9w8e7r6'"), (3, "clean text")]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    found = secrets.scan(frame)
    got = {(r.row.doc_id, r.row.text): [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert got[rows[0]] == [("assign", 2, 51), ("hex", 11, 51)] and got[rows[3]] == [("literal", 90006, 90014)]
    assert got[rows[1]] == got[rows[2]] == got[rows[4]] == [] and len(got) == 5
    masked = secrets.mask(found)
    assert masked.columns == frame.columns
    assert {(r.doc_id, r.text) for r in masked.collect()} == {(1, "x <SECRET>\" y"), (1, None), (None, ""), (2, "é" * 90_000 + " pwd='<SECRET>'"), (3, "clean text")}
    assert secrets.scan(nothing).count() == 0
    shown = found.filter("row.doc_id = 1 AND row.text IS NOT NULL").select(secrets.joined(F.col("spans"))).first()[0]
    assert shown == "assign:2:51,hex:11:51"


def test_a_block_holds_a_bounded_text(spark):
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 200000)").alias("text"))
    index = search.build(docs)
    sizes = [r.n for r in index.rows.filter("term IS NULL").select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == index.documents == 12 and max(sizes) <= 8
    assert index.terms == 12 * 200000
