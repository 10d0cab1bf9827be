"""Near duplicates, leaks, records, URLs, archives and repeated passages against plain Python."""

import hashlib
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from assayer.llm import common, decontamination, records, simhash, suffix, urls, warc
from tests.llm.conftest import WORDS, passage

BPE = public_tokenizers.path("byte_bpe_50k.json")


def groups_of(prints, most):
    """Smallest reachable row for fingerprints given as whole numbers."""
    label = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= most and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 200), (None, 3), (100, 200)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100}


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "The QUICK brown\tfox jumps Ünder the quick brown fox"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text, 4) == want.to_bytes(8, "big")
    assert simhash.fingerprint("one two", 4) == xxhash.xxh64_digest(b"one two", 42)
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == bytes(8)
    assert simhash.fingerprint(text, 4, 8)[:8] == simhash.fingerprint(text, 4)


def test_block_cells_lose_no_pair():
    rng, cells = np.random.default_rng(0), simhash.block_cells()
    assert len(cells) == 35
    for _ in range(200):
        apart = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not apart & set(cell) for cell in cells)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_links_close_like_all_pairs(spark, chunk):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {0}
    for c in centre.tolist():
        for _ in range(25):
            c ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
            prints.add(c)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fp binary")
    table = simhash.pivot_table(frame, 1, 16).cache()
    found = simhash.links(table, simhash.block_cells(), 4, chunk)
    whole = {r.node: r.component for r in common.components(found).collect()}
    signed = [struct.unpack(">q", p.to_bytes(8, "big"))[0] for p in prints]
    mine, want = [whole.get(s, s) for s in signed], groups_of(prints, 4)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_near_duplicates_of_odd_rows(docs, nothing, texts):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].component_id == by_id[2].component_id == 1
    assert {by_id[i].component_id for i in (4, 5, 6)} == {4} and bytes(by_id[4].fp) == bytes(8)
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one_of_each_group(docs, nothing):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect())
    assert [i for _, i, _ in ids if i is not None] == [1, 4, 7, 7, 8, 9, 10, 11, 12, 13]
    assert sum(i is None for _, i, _ in ids) == 1  # the null text goes with the empty ones
    assert simhash.keep_one(nothing).count() == 0


def test_keep_one_follows_the_bits(spark):
    rng, rows = np.random.default_rng(7), []
    for k in range(60):
        words = [f"t{w}" for w in rng.choice(2000, 200).tolist()]
        edited = [f"e{k}" if at == 50 and k % 2 else w for at, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    prints = [int.from_bytes(simhash.fingerprint(t, 4), "big") for _, t in rows]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(groups_of(prints, 4)) and len(kept) < 100


def test_many_copies_of_one_text_are_linked_without_holding_all_pairs(spark, monkeypatch):
    rng, base = np.random.default_rng(4), [f"b{w}" for w in range(3000)]
    rows = []
    for k in range(200):
        own = list(base)
        own[int(rng.integers(3000))] = f"c{k}"
        rows.append((k, " ".join(own)))
    rows += [(200 + k, " ".join(f"z{k}x{w}" for w in range(300))) for k in range(4)]
    stored, own = {}, simhash.store

    def count(df, purpose):
        out = own(df, purpose)
        stored[purpose] = stored.get(purpose, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "store", count)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(groups_of([int.from_bytes(simhash.fingerprint(t, 4), "big") for _, t in rows], 4)) and {200, 201, 202, 203} <= kept
    assert stored["units"] < stored["members"] / 10


ITEM = passage(11, 30, 3)


@pytest.mark.parametrize(("item", "text", "found"), [
    ("ha ha ha ha", "foo ha ha ha ha bar", True), ("new york", "in New York city", True), ("new york", "a new road to york", False),
    ("今天天气很好我们去公园散步", "他说：今天天气很好，我们去公园散步吧。", True), ("今天天气很好我们去公园散步", "昨天下雨了", False),
    ("yes", "yes it is", False), ("yes", " Yes! ", True), ("one two three", "zero one two three four", True), ("a b a b a b", "x a b a b a b y", True),
])
def test_short_repeated_and_unspaced_items(spark, item, text, found):
    docs = spark.createDataFrame([(1, text), (2, "something else altogether"), (3, None)], "doc_id long, text string")
    got = decontamination.matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 9)] * found


def full_alignment(item, text):
    """Best local alignment of two word lists, cell by cell, over the item's number of words."""
    best, above = 0, [0] * (len(text) + 1)
    for word in item:
        row = [0]
        for k, other in enumerate(text):
            row.append(max(0, above[k] + (1 if word == other else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, *row), row
    return best / len(item)


def test_leaks_equal_the_alignment_of_all_pairs(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"v{k}" for k in range(4000)]
    items = [[str(w) for w in rng.choice(vocabulary, rng.integers(4, 40))] for _ in range(25)]
    texts = []
    for k in range(60):
        own = [str(w) for w in rng.choice(vocabulary, 60)]
        copied = list(items[k % 25])
        for at in rng.permutation(len(copied))[: len(copied) * (k % 4) // 12]:
            if k % 2:
                copied[at] = "changed"
            else:
                copied[at : at + 1] = [copied[at], "added"] if k % 3 else []
        texts.append(own[:30] + copied + own[30:] if k % 5 else own)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.matches(docs, bench).collect()}
    want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(items) if (s := full_alignment(item, t)) >= 0.5}
    assert got == pytest.approx(want) and len(want) > 40


def test_leaks_are_found_exact_cut_and_edited(spark):
    words = ITEM.split()
    edited = " ".join("changed" if i % 7 == 3 else w for i, w in enumerate(words))
    rows = [
        (1, passage(100, 80, 9) + " " + ITEM + " " + passage(7, 50, 13)), (2, passage(100, 40, 9) + " " + edited), (3, passage(100, 80, 9)),
        (4, ITEM.upper().replace(" ", ", ")), (5, None), (6, ""), (None, ITEM), (1, passage(100, 80, 9)), (7, " ".join(words[:20])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "two words"), (4, passage(390, 40, 29))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (None, 1), (7, 1)}
    assert got[(1, 1)] == 1.0 and 0.5 <= got[(2, 1)] < 1.0
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [3, 5, 6]
    assert decontamination.matches(docs, bench.limit(0)).count() == decontamination.matches(docs.limit(0), bench).count() == 0


def every(step, words):
    """The words with each step-th one replaced."""
    return " ".join("changed" if i % step == step - 1 else w for i, w in enumerate(words.split()))


def test_leaks_are_found_without_other_traces_of_the_item(spark):
    items = {1: passage(0, 15, 1), 2: passage(100, 20, 1), 3: passage(200, 30, 1), 4: passage(300, 40, 1)}
    inserted = " ".join(w + " more" if i % 3 == 2 else w for i, w in enumerate(items[3].split()))
    texts = {1: every(4, items[1]), 2: every(5, items[2]), 3: inserted, 4: every(5, items[4])}
    docs = spark.createDataFrame([(k, f"before it {t} after it") for k, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.matches(docs, bench).collect()}
    assert set(got) == {(k, k) for k in items} and got[1, 1] == pytest.approx(0.6) and got[3, 3] == pytest.approx(0.7)


def test_a_whole_copy_does_not_hide_an_edited_one(spark):
    item = passage(0, 15, 1)
    docs = spark.createDataFrame([(1, item), (2, every(4, item))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matches(docs, bench).collect()} == {1, 2}


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, passage(k, 60, 9) + " " + passage(11 * k, 30, 3)) for k in range(8)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, passage(11 * k, 30, 3)) for k in range(8)], "item_id long, text string")
    whole = set(map(tuple, decontamination.matches(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "ITEM_WORDS", 70)
    assert {(k, k, 1.0) for k in range(8)} <= whole == set(map(tuple, decontamination.matches(docs, bench).collect()))


def test_alignment_scores():
    item = np.array([1, 2, 3, 4, 5, 6])
    assert decontamination.align(item, np.array([9, 1, 2, 3, 4, 5, 6, 9]))[0] == 6
    assert decontamination.align(item, np.array([1, 2, 3, 9, 4, 5, 6]))[0] == 5
    assert decontamination.align(item, np.array([1, 2, 4, 5, 6]))[0] == 4
    assert decontamination.align(item, np.array([9, 9]))[0] == 0


def test_records_round_trip(docs, nothing, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    manifest = records.write(docs, BPE)
    rows = sorted(records.read(manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, *_ in texts), key=lambda i: (i is not None, i))
    want = sorted(str((i, [*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, _, _ in texts)
    assert sorted(str((r.doc_id, list(r.ids))) for r in rows) == want
    start = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    shuffled = records.read(manifest, with_ids=True, order_seed=4).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, rows))
    assert records.read(records.write(nothing, BPE)).count() == 0


def test_encoder_equals_the_library():
    own = records.Encoder.of(BPE)
    samples = ["", " ", "a", " a b ", "a  b", "don't stop, now!", "x\n y", "a \n b", "tab\tand space", "ends.\nAnd, é漢 字 $$$ a|b 12 1,2", "\u00a0 x", "<|endoftext|> y"]
    assert own.encode(samples) == own.encode(samples) == own.library(samples)


def test_new_words_take_the_merges_alone():
    own, seen = records.Encoder(BPE), []
    texts = [" ".join(f"w{'abcdefghij'[k % 10] * (k % 7)}é{'klmnopqrst'[k // 10 % 10]}漢{'uvwxyz'[n % 6]}{mark}" for k in range(200)) for n, mark in enumerate((",", ".\nNext", "'s", "", "$$$\nx\ny"))]
    # letters by one edition of Unicode only, digits that are no letters, white space inside, marks that combine
    odd = ["a\u1c89b \u1c89b c\u1c89", "x² ²x y²z,", "a\tb c\x1cd", "e\u0301a b\u0301", "a\n b", "a\n\nb c\n", "b<|endoftext|>c d\n<|endoftext|>", "a\0b \0"]
    want, through = own.library(texts + odd), own.library
    own.library = lambda some: seen.extend(some) or through(some)
    assert own.encode(texts) == want[:5] and sum(map(len, seen)) < 100 < sum(map(len, texts)) / 100
    assert own.encode(odd) == want[5:] and own.encode(odd + texts) == want[5:] + want[:5]


def test_remembered_pieces_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(records, "CACHE", 100)
    own = records.Encoder(BPE)
    texts = [f"a {'xyz' * 300}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} b{k % 7}," for k in range(100)]
    for text in texts:
        assert own.encode([text]) == own.library([text])
        assert sum(map(len, [*own.memory["rest"][0], *own.memory["rest"][1]])) < 5000


def test_a_vocabulary_of_another_kind_goes_by_the_library(tmp_path):
    import json

    with open(BPE, encoding="utf-8") as file:
        kind = json.load(file)
    kind["added_tokens"].append(kind["added_tokens"][0] | {"id": 50257, "content": "token,"})
    (tmp_path / "own.json").write_text(json.dumps(kind), encoding="utf-8")
    own = records.Encoder(str(tmp_path / "own.json"))
    texts = ["a token, b", "a btoken,\nc,", "a token b,"]
    assert own.merges is None and own.encode(texts) == own.library(texts)


def test_damage_is_noticed():
    import io

    good = records.frame(b"payload")
    assert records.read_frame(io.BytesIO(good)) == b"payload" and records.read_frame(io.BytesIO(b"")) is None
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(bad)))


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
URLS = [
    ("http://A.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("http://x.org/fr/?q#f", "x.org", "/fr/", "org/fr/", "allow"), ("http://myexample.com/de/x", "myexample.com", "/de/x", None, None),
    ("http://m.example.com/de/x#y?z", "m.example.com", "/de/x", "example.com/de/", "block"), (None, "", "", None, None), ("no scheme", "", "", None, None),
    ("http://net", "net", "", None, None), ("http://h?x://y/z", "h", "", None, None), ("", "", "", None, None), ("http://x.com/" + "a/" * 3000, "x.com", "/" + "a/" * 3000, None, None),
]


def test_urls_by_rule_and_by_trees(spark):
    more = [(f"http://s{k}.{t}/{p}/{k}?a={k}&b=1", None) for k in range(20) for t, p in (("shop.net", "x"), ("x.org", "fr"), ("y.com", "en"))]
    rows = [(k, u[0], "clash", 0.5) for k, u in enumerate([*URLS, *more, URLS[0]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, entropy double")
    got = {r.page_id: r for r in urls.judge(pages, RULES, trees=3).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert len(got) == len(rows)
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages, RULES).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), RULES).count() == 0
    blocked = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/")], "page_id long, url string")
    assert {r.verdict for r in urls.judge(blocked, RULES).collect()} == {"block"}


def test_entropy(spark):
    frame = spark.createDataFrame([("aabb",), ("abcd",), ("",), ("zzzz",)], "t string")
    assert [round(r[0], 6) for r in frame.select(urls._entropy(frame["t"])).collect()] == [1.0, 2.0, 0.0, 0.0]


def test_a_long_page_is_put_together_in_one_pass(spark):
    html = "<p>" + "0123456789abcdef" * (1 << 19)  # 8 MB in 1024 segments
    folder = warc.write(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), segment_bytes=1 << 13)
    started = time.monotonic()
    found = warc.read(spark, folder).select("page_id", "payload_bytes", "digest").collect()
    assert [tuple(r) for r in found] == [(1, len(html), hashlib.sha1(html.encode()).hexdigest())]
    assert time.monotonic() - started < 20


def test_warc_round_trip(spark):
    big, long = "<p>é漢</p>" * 200, "WARC/1.1\r\n\r\nline\r\n" * 9000
    rows = [
        (1, "http://a", big), (5, "http://b", big), (3, "http://c\r\nX: y", big), (None, "http://d", big), (7, None, None), (8, "u", ""), (9, "u", "short"),
        (10, "u", "short"), (11, "v", long), (12, "v", long + "."), (13, "w", "dup" * 500), (13, "w", "dup" * 500), (14, "z", "\U0001f600" * 9000),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    back = warc.read(spark, warc.write(pages, segment_bytes=1000)).collect()
    assert len(back) == len(rows)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 5
        want.append(str((page, "revisit" if revisit else "response", 5 if revisit else None, hashlib.sha1(data).hexdigest(), len(data), None if revisit else hashlib.sha1(data).hexdigest())))
    got = [str((r.page_id, r.record_type, r.refers_to, r.digest, r.payload_bytes, None if r.payload is None else hashlib.sha1(bytes(r.payload)).hexdigest())) for r in back]
    assert sorted(got) == sorted(want)
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_files_close_by_bytes_and_revisits_name_their_record(spark):
    rows = [(k, "u", f"{k} " + "page " * 40_000) for k in range(40)] + [(100 + k, f"v{k}", "copy " * 400) for k in range(3)]
    folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), file_bytes=2 << 20)
    files = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("length").collect()]
    assert 3 <= len(files) <= 8 and max(files) < 3 << 20
    parts = {r.page_id: r for r in warc.segments(spark, folder).filter("page_id >= 100").select("page_id", "record_id", "kind", "refers_to").collect()}
    assert parts[102].kind == "response" and [parts[k].refers_to for k in (100, 101)] == [parts[102].record_id] * 2
    assert {r.page_id: r.refers_to for r in warc.read(spark, folder).filter("record_type = 'revisit'").collect()} == {100: 102, 101: 102}


def test_missing_segments_are_noticed(spark):
    folder = warc.write(spark.createDataFrame([(1, "u", "x" * 9000)], "page_id long, url string, html string"), segment_bytes=1000)
    parts = warc.segments(spark, folder)
    assert warc.reassemble(parts).count() == 1
    with pytest.raises(Exception, match="segments missing"):
        warc.reassemble(parts.filter("number <> 4")).collect()
    with pytest.raises(ValueError):
        warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc\r\n0\r\n\r\n")


def plain_removal(rows, length=50):
    low = float("-inf")
    rows = [(low if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, data in rows:
        for k in range(len(data) - length + 1):
            first[data[k : k + length]] = min(first.get(data[k : k + length], i), i)
    out = []
    for i, data in rows:
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append(str((None if i == low else i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))))
    return sorted(out)


@pytest.mark.parametrize("part_bytes", [1 << 20, 700])
def test_suffix_removal_equals_brute_force(docs, texts, part_bytes):
    got = suffix.remove_repeats(docs, part_bytes=part_bytes, run_names=500).collect()
    mine = sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in got)
    assert mine == plain_removal([(i, t) for i, t, _, _ in texts])


def test_suffix_removal_of_shifted_passages(spark):
    rng = np.random.default_rng(9)
    letters = "abcd é"
    shared = ["".join(rng.choice(list(letters), n)) for n in (49, 50, 51, 80, 200)]
    rows = []
    for k in range(30):
        text = "".join(rng.choice(list(letters), rng.integers(0, 90)))
        for s in rng.choice(len(shared), 2):
            text += shared[s][rng.integers(0, 3) :] + "".join(rng.choice(list(letters), rng.integers(0, 40)))
        rows.append((int(rng.integers(0, 25)), text))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix.remove_repeats(frame, part_bytes=500, run_names=200).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in got) == plain_removal(rows)


def test_suffix_removal_of_nothing(nothing):
    assert suffix.remove_repeats(nothing).count() == 0


def test_cover_reaches_every_difference():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def test_packed_runs():
    values = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    assert (suffix.unpack(suffix.pack(values)) == values).all() and (suffix.unpack(suffix.pack(values[:1])) == values[:1]).all()
    ids = np.array([-(1 << 63), 5, -3, 1 << 62])
    assert (suffix._unpack_ids(suffix._pack_ids(ids)) == ids).all()


def test_pipeline_stages_follow_each_other(spark, docs, nothing):
    folder = "/root/testdata/sf0.001"
    for start in (docs, nothing):
        frame = start
        for name, stage in corpus_pipeline.STAGES:
            before, frame = frame, common.store(stage(spark, frame, folder), "test-stage")
            if name != "token_records":
                assert frame.columns == start.columns
            if name not in ("token_records", "source_mixing"):
                assert frame.count() <= before.count()
        assert frame.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert WORDS
