import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def rows():
    """Numbers and texts: nulls, empties, ties, copies, near copies, repeated lines, a very long text."""
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    common, body = "A common line of text", [line(30) + "\n" + line(25) for _ in range(30)]
    texts = [None, "", " \n\t", "one", "É ß née. 日本語 x", common, " \t" + common.upper() + "\r\nother\n" + common, line(20_000)]
    texts += body + body[:6] + [b + " tail" for b in body[6:10]] + [common + "\n" + b for b in body[10:14]]
    texts += ["Released under the MIT License. " + line(12), "the GNU general public license and mit license, MIT LICENSE", "spam " * 60, line(5) + "\n" + (line(8) + "\n") * 6]
    texts += [line(10) + " " + "needle in a hay stack that is long enough to find" + " " + line(9), "short item here"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no number " + line(9)), (3, "one"), (11, body[2])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with results' names."""
    from sievework.llm import shared

    shared.ready(spark)
    full = [(i, t, "en" if k % 2 else "fr", f"src{k % 3}", None if t is None else len(t), "x", 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words string, shard int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
