import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, verdict string"
WORDS = [f"w{i}{'abcdefghij'[i % 10]}" for i in range(400)]


def passage(start, count=120, step=7):
    return " ".join(WORDS[(start + i * step) % 400] for i in range(count))


@pytest.fixture(scope="session")
def texts():
    """Odd rows and a few groups: nulls, empty and very long texts, ties, repeated rows, copies, junk."""
    base = passage(3)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(WORDS[10], "other", 1), "en", "a"), (4, None, None, None), (5, "", "en", "b"),
        (6, " \t\n ", None, "b"), (7, passage(50, 60, 11), "de", "b"), (7, passage(50, 60, 11), "de", "b"), (7, passage(91, 70, 13), "de", None),
        (None, passage(200, 80, 3), "fr", "c"), (None, None, "fr", "c"), (8, "x" * 5000, "en", "c"), (9, passage(0, 9000, 17), "en", "c"),
        (10, "\n".join(["same line here ok"] * 30), "en", "c"), (11, passage(5, 60, 19).replace(" ", " ### "), "en", "a"),
        (12, "ÄÖÜ été niño 漢字 " + passage(9, 70, 23), "es", "a"), (13, "start " + base[40:260] + " end", "en", "a"),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names clash with those of the operators' results."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 99, "v") for i, t, g, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
