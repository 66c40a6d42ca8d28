import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int, _id int, _text string"


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts and ids, a very long text, copies, repeated rows and columns whose names clash."""
    shared = prose(60, 1)
    texts = {
        1: f"{prose(30, 2)} {shared} {prose(30, 3)}", 2: f"{prose(10, 4)} {shared}", 3: None, 4: "", 5: " \n\t ", 6: prose(120, 5), 7: prose(120, 5),
        8: "Ünïcode ﬁne 漢字 \u0000 it's <|endoftext|> a\u0085b", 9: prose(60_000, 6), 10: "one", 11: "one",
    }
    rows = [(i, t, "en", None, len(t or ""), 0, "x") for i, t in texts.items()]
    rows += [rows[5], (None, prose(120, 5), None, "s", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
