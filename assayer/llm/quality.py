"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one long with a bit
per failed rule. A policy is a named, versioned set of rules, hence a mask: applying another version
or asking what a rule alone rejects is bit arithmetic on the ledger and never reads a text again.
All of it is built-in column functions on one row, so there is no shuffle but the tiny one of the
ablation counts.

Defined cases: a null or empty text has no words and fails ``few_words``. Repeated rows are judged
each for itself. An empty table gives an empty ledger. Columns of the input keep their names inside
the struct ``row``, so they cannot clash with the ledger's.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")

_SYMBOLS = "#*$%&|<>"

#: Name to failing condition over the measurements. The position is the bit, so rules are only ever appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "shouting": "10 * n_shouts > 3 * n_words",
    "short_words": "10 * word_chars < 20 * n_words",
    "long_words": "word_chars > 20 * n_words",
}

#: Policy versions; a released version is never changed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "shouting", "short_words", "long_words"),
}


def mask(rules: Iterable[str]) -> int:
    """The bits of some rules."""
    order = list(RULES)
    return sum(1 << order.index(rule) for rule in rules)


def policy_mask(version: str) -> int:
    return mask(POLICIES[version])


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, measurements): each text is split once, and every measurement is taken from the parts.

    ``n_repeat_words`` counts words in 3-word windows that occur twice or more in the text. Windows
    are compared by their 64-bit hash; sorting puts equal ones next to each other, and the covered
    words follow from the gaps between the positions of the repeated ones.
    """
    parts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body")).select(
        "row", "body", words_of(F.col("body")).alias("words"), F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = parts.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _removed(F.col("body"), _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _removed(F.col("body"), "!").cast("long").alias("n_shouts"),
        F.slice(
            F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
            F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)),
        ).alias("windows"),
    )
    # only texts with a repeated window are sorted
    ordered = counted.withColumn(
        "windows",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    places = ordered.withColumn(
        "windows",
        F.sort_array(
            F.array_compact(
                F.transform(
                    "windows",
                    lambda w, k: F.when(
                        F.coalesce(w["h"] == F.get("windows", k - 1)["h"], F.lit(False))
                        | F.coalesce(w["h"] == F.get("windows", k + 1)["h"], F.lit(False)),
                        w["i"],
                    ),
                )
            )
        ),
    )
    covered = F.aggregate(
        F.transform("windows", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("windows", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    measured = F.struct(*[F.coalesce(covered, F.lit(0).cast("long")).alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES])
    # as output of a generator the measurements are plain columns: a later filter is not rewritten into their definitions
    return places.select("row", F.inline(F.array(measured)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, measurements, failure_bits): every rule evaluated once."""
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())), F.lit(0).cast("long"))
    return measure(docs, text).withColumn("failure_bits", bits)


def fails(policy: int) -> Column:
    """Whether a ledger row fails one of the rules of a mask."""
    return F.col("failure_bits").bitwiseAND(F.lit(policy).cast("long")) != 0


def keep(docs: DataFrame, version: str = "web-1", text: str = "text") -> DataFrame:
    """The documents a policy version keeps, with their own columns."""
    return ledger(docs, text).filter(~fails(policy_mask(version))).select("row.*")


def ablation(entries: DataFrame, version: str = "web-1") -> DataFrame:
    """Per rule of a policy: documents it fails, those only it fails, and what is kept without it.

    The ledger is first reduced to counts per failure pattern, a table whose size depends on the
    rules alone.
    """
    policy = policy_mask(version)
    patterns = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(policy).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(mask([rule])).cast("long").alias("bit")) for rule in POLICIES[version]])
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return (
        patterns.select("bits", "n", F.inline(rules)).groupBy("rule")
        .agg(
            total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total(F.col("bits") == F.col("bit")).alias("n_only"),
            total(rest == 0).alias("n_kept_without"),
        )
    )
