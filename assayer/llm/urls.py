"""URL filters: rules of hosts and paths first, gradient-boosted trees on lexical features for the rest.

A rule fits its host and every subdomain if the URL's path starts with the rule's; of the rules that
fit the longest wins. URLs under a rule carry its verdict as their label, and trees are boosted on a
bounded sample of those labelled URLs (Spark's own GBT over a DataFrame). Features are lexical: length,
depth, digit ratio, entropy, parameter counts, and how common the host's last label and its
registered name are among all URLs. Everything is column functions and JVM code.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged by
the trees like any other. With no labelled URL everything without a rule is allowed; if all labels
agree, they are the verdict. Repeated rows are judged each; an empty table gives no rows. Input columns
stay in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
SAMPLE_URLS = 20_000  # bound of the training sample
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "fragment", "suffix_share", "name_share")

#: (verdict, rule); a rule is a host, a slash and the start of a path.
Rules = Sequence[tuple[str, str]]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. Of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # longer rules are asked first
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character: runs of the sorted characters give the counts."""
    letters = F.sort_array(F.split(text, ""))
    start = F.struct(F.lit(0).alias("run"), F.lit("").alias("last"), F.lit(0.0).alias("sum"))
    term = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    runs = F.aggregate(
        letters, start,
        lambda a, c: F.when(a["last"] == c, F.struct((a["run"] + 1).alias("run"), c.alias("last"), a["sum"].alias("sum"))).otherwise(
            F.struct(F.lit(1).alias("run"), c.alias("last"), (a["sum"] + term(a["run"])).alias("sum"))
        ),
        lambda a: a["sum"] + term(a["run"]),
    )
    size = F.length(text)
    return F.when(size > 0, F.log2(size.cast("double")) - runs / size).otherwise(F.lit(0.0))


def lexical(parts: DataFrame) -> DataFrame:
    """Adds the features to rows with ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return parts.withColumns(
        {
            "suffix": F.element_at(labels, -1), "name": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."),
            "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "depth": count(F.col("path"), "/").cast("double"),
            "labels": F.size(labels).cast("double"), "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "entropy": _entropy(url), "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
        }
    )


def judge(pages: DataFrame, rules: Rules, sample_urls: int = SAMPLE_URLS, trees: int = 20, depth: int = 4, seed: int = 3, url: str = "url") -> DataFrame:
    """(row, host, path, rule, verdict, block_probability) of every row."""
    rows = pages.select(F.struct("*").alias("row"), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = lexical(rows.withColumns({"rule": rule, "decided": verdict}))
    # suffix statistics of all URLs, as shares so that they do not depend on the table's size
    names = parts.groupBy("suffix", "name").agg(F.count("*").alias("n"), F.count("decided").alias("ruled"))
    totals = names.agg(F.sum("n").alias("n"), F.sum("ruled").alias("ruled")).first()
    total, labelled = totals["n"] or 1, totals["ruled"] or 0
    suffixes = names.groupBy("suffix").agg((F.sum("n") / total).alias("suffix_share"))
    shares = names.select("suffix", "name", (F.col("n") / total).alias("name_share")).join(suffixes, "suffix")
    described = parts.join(shares, ["suffix", "name"])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    draw = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = min(1.0, sample_urls / labelled) if labelled else 0.0
    sample = described.filter(F.col("decided").isNotNull() & (draw < share)).select(*FEATURES, (F.col("decided") == BLOCK).cast("double").alias("label"))
    sample = sample.repartition(8, "length").sortWithinPartitions(*FEATURES, "label")
    kinds = [r[0] for r in sample.select("label").distinct().collect()] if labelled else []  # at most two rows
    kept = ["row", "host", "path", "rule"]
    if len(kinds) < 2:
        likely = F.lit(kinds[0] if kinds else 0.0)
        return described.select(*kept, F.coalesce("decided", F.when(likely > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), likely.alias("block_probability"))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(vectors.transform(sample))
    scored = model.transform(vectors.transform(described)).withColumn("verdict", F.when(F.col("prediction") > 0.5, BLOCK).otherwise(ALLOW))
    return scored.select(*kept, F.coalesce("decided", "verdict").alias("verdict"), _second(F.col("probability")).alias("block_probability"))


def _second(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.element_at(vector_to_array(vector), 2)
