"""A table with every awkward case, for all operators."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(r, n):
    return " ".join(f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(n))


def awkward_rows():
    r = random.Random(7)
    base = [sentence(r, 60) for _ in range(12)]
    texts = list(base)
    texts += base[:3] + [base[0]]  # copies
    for b in base[:4]:  # near copies
        w = b.split()
        w[30] = "changed"
        texts.append(" ".join(w))
    texts += [base[4] + " " + base[5], "pre " + base[6] + " post", "loop me now " * 40]
    texts += [None, "", " \t\n", "one", "two words", "Three Words HERE", "three words here", "x" * 5000, "Größe ÉTÉ 😀 don't we're\n\n  ", sentence(r, 4000), "a\na\na\nb\n#$%", "\x0b\x0c|&<>"]
    rows = [(i, t, "en", "tests/x" if i % 5 == 0 else None, None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1, "clash")] * 2  # repeated rows
    rows += [(None, base[1], None, None, None, None), (None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string"


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
