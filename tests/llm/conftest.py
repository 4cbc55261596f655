import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id long, kept boolean, digest string, bucket int, block long"


def words(rng, n, base="abcdefgh"):
    return " ".join("".join(rng.choice(base) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def made_rows(seed=1):
    """Copies, near copies, nulls, empty and blank and very long texts, repeated rows."""
    rng = random.Random(seed)
    base = [words(rng, n) for n in (1, 3, 5, 9, 12, 40, 60, 200, 200, 4000)]
    texts = [*base, None, "", "   \n\t ", "Ünïcode tëxt — ok 你好 世界", base[5].upper(), base[5], "x" * 20_000, base[7] + " tail", "head " + base[8]]
    for t in (base[6], base[7], base[8]):
        w = t.split()
        for _ in range(6):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [base[4]] * 5
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t), 0.5, 7, True, "d", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]  # the same row again
    rows.append((None, "no id", "en", None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(made_rows(), KINDS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)
