"""The registered queries of the dealt operators, with check SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontamination, language, mixing, quality, records, resampling, search, secrets, simhash, suffix, tokens, urls, warc
from assayer.plans.registry import query, table

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
w AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w),
p AS (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS covered FROM c WHERE n > 1),
s AS (SELECT r, CAST(sum(covered) AS BIGINT) AS n_repeat_words FROM p GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts
      FROM d LEFT JOIN s USING (r)),
b AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values()))} AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & {quality.policy_mask("base-1")} <> 0 AS base_failed,
       bits & {quality.policy_mask("web-1")} = 0 AS kept, CAST(bits AS BIGINT) AS failure_bits
FROM b"""


@query("op10_quality_rules", _QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all documents, judged by the base and the web policy."""
    base, web = quality.policy_mask("base-1"), quality.policy_mask("web-1")
    return quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.fails(base).alias("base_failed"), (~quality.fails(web)).alias("kept"), "failure_bits",
    )


_MIXING_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 3) AS INTEGER) AS bucket
  FROM documents),
h AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY ALL),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM h GROUP BY source),
s AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM z),
t AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM s),
l AS (
  SELECT 0::DOUBLE AS level, 0 AS k
  UNION ALL
  SELECT (any_value(budget) - coalesce(sum(CASE WHEN weight * level >= 2 * source_size THEN 2 * source_size END), 0))::DOUBLE
           / sum(CASE WHEN weight * level < 2 * source_size THEN weight END)::DOUBLE, k + 1
  FROM l, s, t WHERE k <= (SELECT count(*) FROM s) GROUP BY level, k),
f AS (SELECT *, least(2.0::DOUBLE * source_size, weight * (SELECT max(level) FROM l)) AS target FROM s),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM f),
q AS (SELECT *, target - whole * source_size AS missing FROM r),
u AS (SELECT source, bucket, size, sum(size) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM h),
c AS (SELECT u.source, max(bucket) AS cut FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source
      WHERE upto <= missing OR (upto - size < missing AND upto - missing <= missing - (upto - size)) GROUP BY u.source)
SELECT d.doc_id, d.size, q.source_size, q.target,
       CAST(d.size * (q.whole + CASE WHEN d.bucket <= coalesce(c.cut, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source"""


@query("op9_source_mixing", _MIXING_SQL)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document contributes to the mix of all documents."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_simhash_dedup")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, by 4-word shingles and at most 4 differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op2_token_records")
def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token record, written and read back."""
    return records.read(records.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op7_decontamination")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score) of all documents that hold a copy of a benchmark item, edited or not."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from the folds that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language.train(docs.filter("NOT held_out"))
    return language.predict(docs, model, keep=("doc_id", "held_out"))


@query("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text over a public vocabulary."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: The host and path rules of the URL query.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query("op5_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rule or by the trees."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "block_probability")


@query("op6_warc")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@query("op8_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that smaller documents hold."""
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# crc32 bit by bit over a table of 256 entries; sums are whole numbers, so their order does not matter
_RESAMPLING_SQL = f"""
WITH z AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
a AS (SELECT r, unnest(words) AS w FROM d),
b AS (SELECT unnest({_TERMS}) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM a UNION ALL SELECT w FROM b)),
y AS (SELECT w, list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM v),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM y, z),
s AS (SELECT bucket, count(*) AS n FROM a JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM a) + 10000)
               / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS gain
      FROM s FULL JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM a JOIN h USING (w) JOIN g USING (bucket) GROUP BY r),
f AS (SELECT r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
      FROM d LEFT JOIN m USING (r)),
c AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM f),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM c WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM k) // 100 THEN place END AS rank
FROM c LEFT JOIN k USING (r)"""


@query("op11_importance_resampling", _RESAMPLING_SQL)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents with 20 words, drawn towards the benchmark's words, with their ranks."""
    drawn = resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
a AS (SELECT r, unnest(words) AS w FROM d),
s AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_terms FROM a),
p AS (SELECT w, r, count(*) AS tf FROM a GROUP BY w, r),
v AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY w),
l AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
q AS (SELECT i, item_id, unnest(list_distinct({_TERMS})) AS w FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
c AS (SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN p USING (w) JOIN v USING (w) JOIN l USING (r), s GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM c WHERE score > 0) WHERE place <= 50"""


@query("op12_ranked_search", _SEARCH_SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    index = search.build(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark"))


@query("op13_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "row.doc_id", number("assign"), number("access"), number("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )
