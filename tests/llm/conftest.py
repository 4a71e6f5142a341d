import random

import pytest

WORDS = ["river", "stone", "the", "of", "and", "green", "light", "over", "house", "table", "window", "runs", "slowly", "paper", "north", "a", "to", "is", "was", "seven"]


def prose(rng, n, per_line=12):
    """``n`` words in lines."""
    words = [rng.choice(WORDS) + rng.choice(["", "", "", str(rng.randrange(40))]) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + per_line]) for i in range(0, n, per_line))


@pytest.fixture(scope="session")
def rough(spark):
    """Documents with nulls, empty and long texts, exact and near copies, shared passages, repeated rows; extra columns with awkward names."""
    rng = random.Random(3)
    passage = prose(rng, 70)
    rows = [(1, None), (2, ""), (3, " \n\t \n"), (4, "one"), (5, "one"), (6, "Zwei Wörter"), (None, prose(rng, 30)), (None, None)]
    base = prose(rng, 90)
    for i in range(10, 40):
        kind = i % 6
        if kind == 0:
            text = prose(rng, rng.randrange(5, 120))
        elif kind == 1:
            text = prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 15)
        elif kind == 2:
            words = base.split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        elif kind == 3:
            text = base
        elif kind == 4:
            text = "\n".join([prose(rng, 12)] * 9)
        else:
            text = prose(rng, 40).replace(" ", "  ") + " \x0b " + "é " * 5
        rows.append((i, text))
    rows.append((50, "word " * 40000 + "\n" + passage))
    rows += [rows[12], rows[12], (51, passage), (52, passage)]
    rows.append((None, passage))
    return rows


@pytest.fixture(scope="session")
def rough_docs(spark, rough):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, chunk string, key int, h long, region string, gone int, a int, b int, n long, `part` int"
    data = [(i, t, "en", "s", len(t or ""), 1, "x", 2, 3, "y", 4, 5, 6, 7, 8) for i, t in rough]
    return spark.createDataFrame(data, schema).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def no_docs(spark, rough_docs):
    return spark.createDataFrame([], rough_docs.schema)
