import random

import pytest

WORDS = "the of and to in quick brown foxes jump over lazy dogs stream window table merge grid count frame vector".split()


@pytest.fixture(scope="session")
def words():
    rng = random.Random(9)
    return lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def docs(rows, schema="doc_id long, text string, source string"):
        names = [f.split()[0] for f in schema.split(", ")]
        more = [c for c in CLASHING if c not in names]
        rows = [tuple(r) + (None,) * (len(names) - len(r)) + (i,) * len(more) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, ", ".join([schema, *(f"{c} long" for c in more)])).repartition(3)

    return docs


# Names that the operators use for columns of their own.
CLASHING = (
    "n items spans n_words _n lost rest rep toxic labelled key keys text_key fp fingerprint bands band value component group_id node hi lo src dst src2 h h1 h2 owner host path rule verdict chunk words tokens "
    "size source_size target taken first_slot pieces row start slots pos rank score form near clean media payload tree leaf part body counts carry doc k m"
).split()
HARD = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "A"), (None, "no id here but a long enough line"), (5, "same line of text here\nother"), (6, "same line of text here\nother"), (6, "same line of text here\nother"), (7, "Ünïcode „Zitat“ ÅÄÖ \x1f\x00 end"), (8, "w " * 30_000)]


@pytest.fixture
def hard(make):
    return make(HARD)


@pytest.fixture
def empty(make, spark):
    return spark.createDataFrame([], make([(1, "")]).schema)
