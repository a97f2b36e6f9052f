import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, entry string, node string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "house,", "river", "green", "Tree.", "walks", "slow", "über", "été"]) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and very long texts, ties, copies, near copies, a hot source, shared passages."""
    rng = random.Random(7)
    shared = prose(rng, 45)
    out = [None, "", "   ", "\n\t", "one", "one ", " one", "two  words", "two\nwords"]
    out += [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    out += [prose(rng, 30) + " " + shared + " " + prose(rng, 20) for _ in range(8)]
    copy = prose(rng, 80)
    out += [copy] * 12 + [copy.replace(" ", "\n")] + [copy + " end" + str(k) for k in range(10)] + [copy.upper()]
    out += [shared + " " + shared, prose(rng, 9000), "x" * 20000, "<|endoftext|> a", "É́ café, don't ''s 12ab", "a\x85b c\x1cd"]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    """Columns that clash with names used inside the operators are part of every table."""
    return [(3 * k % 1009, t, "en", ["a", "b", None, ""][min(k % 7, 3)], None, "x", "y", "z") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Null ids and repeated rows as well."""
    return spark.createDataFrame([*rows, *rows[:30], (None, "one", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (None, "only here", None, None, None, None, None, None)], SCHEMA)
