"""Quality, mixing, language and token counts against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from assayer.llm import language, mixing, quality, tokens
from tests.llm.conftest import passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_every_row(docs, texts):
    rows = quality.ledger(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((i, *plain_quality(t))) for i, t, _, _ in texts)


def test_quality_keeps_columns_and_filters(docs, nothing):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, None, 12}
    assert quality.ledger(nothing).count() == 0 and quality.keep(nothing).columns == nothing.columns


def test_ablation_counts_sole_failures(docs):
    rows = {r.rule: r for r in quality.ablation(quality.ledger(docs)).collect()}
    bits = [r.failure_bits & quality.policy_mask("web-1") for r in quality.ledger(docs).collect()]
    for rule in quality.POLICIES["web-1"]:
        bit = quality.mask([rule])
        assert (rows[rule].n_failed, rows[rule].n_only) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits))
        assert rows[rule].n_kept_without == sum(b & ~bit == 0 for b in bits)


def test_policies_are_subsets():
    assert quality.policy_mask("base-1") == 3 and quality.policy_mask("base-1") & ~quality.policy_mask("web-1") == 0


def filled(sizes, weights, budget, cap):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = budget - sum(target[s] for s in sizes if s not in open_)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def test_water_filling_clamps_and_shares_again(spark):
    sizes, weights = {"a": 10, "b": 100, "c": 1000, "d": 0}, {"a": 5.0, "b": 2.0, "c": 1.0, "d": 5.0}
    frame = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(frame, 1.5 * 1110, 2.0).collect()}
    want = filled(sizes, weights, 1.5 * 1110, 2.0)
    assert got == pytest.approx(want)
    assert sum(mixing.water_fill(frame, 9e9, 2.0).toPandas()["target"]) == 2220  # all are clamped


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 37), f"s{min(i % 9, 3)}" if i % 11 else None) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = mixing.mix(frame).select("row.source", "doc_id", "size", "target", "copies").toPandas()
    two = mixing.mix(frame.repartition(7)).select("row.source", "doc_id", "size", "target", "copies").toPandas()
    assert one["copies"].max() <= 2 and len(one) == 6000
    assert one.sort_values("doc_id").reset_index(drop=True).equals(two.sort_values("doc_id").reset_index(drop=True))
    one["taken"] = one["size"] * one["copies"]
    for _, group in one.groupby("source", dropna=False):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= 0.01 * group["target"].iloc[0] + 40


def test_empty_documents_at_the_cap_are_taken_no_oftener_than_the_cap(spark):
    rows = [(i, "w " * 10 if i % 2 else "", "full") for i in range(400)] + [(1000 + i, "w " * 5000, "large") for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(frame, weights=(1000.0, 1.0)).select("row.source", "size", "copies", "target", "source_size").toPandas()
    assert (mixed["target"] == 2 * mixed["source_size"])[mixed["source"] == "full"].all()
    assert mixed["copies"].max() <= 2 and mixing.repeat(mixing.mix(frame)).filter("source = 'full'").count() <= 800


def test_mix_handles_odd_rows(docs, nothing, texts):
    mixed = mixing.mix(docs)
    assert mixed.count() == len(texts) and mixing.repeat(mixed).columns == docs.columns
    assert {r.size for r in mixed.filter("row.text IS NULL").collect()} == {0}
    assert mixing.mix(nothing).count() == 0 and mixing.repeat(mixing.mix(nothing)).columns == nothing.columns


def test_codewords_are_distinct():
    for count in (1, 2, 4, 7, 9, 40):
        codes = language.codewords(count)
        assert len({tuple(r) for r in codes}) == count
    assert language.codewords(4).shape == (4, 7)


def test_gram_buckets_cover_long_texts(monkeypatch):
    text = "abcdefghij" * 50
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_SLAB", 64)
    assert (language.gram_counts(text) == whole).all()


def test_language_is_learnt_from_text(spark):
    rng = np.random.default_rng(1)
    sounds = {"aa": ["ka", "ta", "ra", "na"], "bb": ["pe", "le", "me", "se"], "cc": ["zo", "vo", "do", "go"], "dd": ["ni", "bi", "fi", "hi"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[g], 3)) for _ in range(30)), g) for i, g in enumerate(list(sounds) * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame.filter("doc_id % 5 <> 0"))
    found = language.predict(frame.filter("doc_id % 5 = 0"), model, keep=("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in found) and len(found) == 48


def plain_decode(model, margins):
    """Loss-weighted decoding, bit by bit."""
    losses = []
    for word in model.codes.tolist():
        losses.append(sum(w * math.log1p(math.exp(-m if bit else m)) for bit, m, w in zip(word, margins.tolist(), model.weights.tolist())))
    shares = [math.exp(min(losses) - loss) for loss in losses]
    best, *rest = sorted((s / sum(shares) for s in shares), reverse=True)
    return model.languages[losses.index(min(losses))], best, bool(rest and best - rest[0] < language.MARGIN) or min(losses) > model.limit


def test_decoding_equals_plain_python_and_flags_what_fits_no_word():
    rng = np.random.default_rng(6)
    for count in (1, 2, 4, 9):
        codes = language.codewords(count)
        nothing = np.zeros(codes.shape[1])
        model = language.Model([f"l{k}" for k in range(count)], codes, np.zeros((1, codes.shape[1])), nothing, nothing, rng.uniform(0.1, 1, codes.shape[1]), 1.5)
        for _ in range(50):
            margins = rng.normal(0, 3, codes.shape[1])
            name, score, ambiguous = model.decode(margins)
            assert (name, ambiguous) == plain_decode(model, margins)[::2] and score == pytest.approx(plain_decode(model, margins)[1])
        own = (2.0 * codes[0] - 1) * 9
        assert model.decode(own)[::2] == ("l0", False)
        if count > 2:
            own[: len(own) // 4 + 1] *= -1  # near no word: some bits are sure of the contrary
            assert model.decode(own)[2]


def test_sample_counts_do_not_grow_with_partitions_or_copies(spark, monkeypatch):
    rows = [(k, passage(k, 30, 7), "en" if k % 2 else "de") for k in range(160)] + [(None, passage(1, 30, 7), "en")] * 80
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, many = language.train(docs.coalesce(1)), language.train(docs.repartition(40))
    assert (few.ratios == many.ratios).all() and few.limit == many.limit  # sums of whole numbers
    tables, kind = [], type(docs)
    own = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: tables.append(own(df)) or tables[-1])
    assert language.train(docs.repartition(40)).languages == ["de", "en"]
    assert len(tables) == 1 and tables[0].num_rows <= 4 * (language.WIDTH + 1)
    assert sum(n for b, n in zip(tables[0]["bucket"].to_pylist(), tables[0]["n"].to_pylist()) if b == language.WIDTH) == 160


def test_language_odd_rows(docs, nothing, spark):
    model = language.train(docs)
    got = language.predict(docs, model, keep=("doc_id", "text")).collect()
    assert {r.lang_pred for r in got if not (r.text or "").strip()} == {"und"}
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}
    assert language.train(nothing) is None and language.predict(nothing, None, keep=("doc_id",)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "123 456", "en")], "doc_id long, text string, lang string")
    assert language.predict(digits, model).first().lang_pred == "und"


def viterbi(vocabulary, text):
    data = text.encode()
    best = [(0, 0)] + [None] * len(data)
    for i in range(len(data)):
        node = 0
        for j in range(i, len(data)):
            node = int(vocabulary.step(np.array([node]), np.array([data[j]]))[0])
            if not node:
                break
            if vocabulary.cost[node] >= 0:
                new = (best[i][0] + int(vocabulary.cost[node]), best[i][1] + 1)
                best[j + 1] = min(best[j + 1] or (math.inf, 0), new)
    return best[-1][1]


def test_trie_counts_equal_single_cuttings():
    own = tokens.Vocabulary.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    samples = ["", "a", " the", " there", " therefore", "é漢字", "aaaaaaaaaaaaaaaaaaaaaa", " th"] + ["".join(rng.choice(list("theransio "), rng.integers(1, 14))) for _ in range(60)]
    samples = list(dict.fromkeys(samples))
    assert own.count(samples).tolist() == [viterbi(own, s) for s in samples]


def test_a_second_pattern_is_its_own_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    letters = tokens.Vocabulary.of(path, r"[a-z]+")
    assert letters is not tokens.Vocabulary.of(path, r"[0-9]+") and letters is tokens.Vocabulary.of(path, r"[a-z]+")


def test_token_counts_of_odd_rows(docs, nothing, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = tokens.token_counts(docs, path, public_tokenizers.PATTERN).collect()
    own = tokens.Vocabulary.of(path, public_tokenizers.PATTERN)
    want = sorted(str((i, *own.documents([t])[0])) for i, t, _, _ in texts)
    assert sorted(str(tuple(r)) for r in rows) == want
    assert {tuple(r)[1:] for r in rows if r.doc_id in (4, 5)} == {(0, 0, 0)}
    assert tokens.token_counts(nothing, path, public_tokenizers.PATTERN).count() == 0
