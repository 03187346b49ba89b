import random

import pytest

WORDS = "der die das and the of to on with par les une casa sol luna mar rio noche tree stone river cloud Ünder naïve 数据 x1 y2 z3 !? idiot moron".split()


def make_text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): near and exact copies, shared passages, nulls, blanks, repeated rows and ids, a long text, a loop."""
    rng = random.Random(5)
    base, passage = make_text(rng, 300), make_text(rng, 60)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    out = [(1, base), (2, base), (3, near), (4, near.upper()), (5, f"{make_text(rng, 50)} {passage} {make_text(rng, 20)}"), (6, f"{passage}\n{make_text(rng, 30)}")]
    out += [(7, None), (8, ""), (9, " \t\n "), (10, "one"), (11, "one two three four"), (12, "a b " * 120), (13, make_text(rng, 20_000)), (None, make_text(rng, 40)), (None, None)]
    out += [(14, "same row here it is again and again")] * 3 + [(15, "first of this id " * 5), (15, "second of this id " * 5)]
    out += [(100 + i, make_text(rng, rng.randrange(1, 120))) for i in range(60)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], "doc_id long, text string, lang string, score int, rid string").repartition(4)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
