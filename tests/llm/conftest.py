import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, score double, bucket long"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, empty and very long texts, repeated rows, near copies and clashing columns."""
    rng = random.Random(4)
    passage = sentence(rng, 70)
    texts = [None, "", " \t\n", "one", "é ü 漢字 \x85 　", sentence(rng, 20_000), sentence(rng, 300), passage, f"{sentence(rng, 40)} {passage}", f"{passage} {sentence(rng, 200)}", passage]
    near = sentence(rng, 200).split()
    for i in range(6):
        copy = near[:]
        copy[i * 7] = "changed"
        texts.append(" ".join(copy))
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 1, "x", 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
