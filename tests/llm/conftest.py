import random

import pytest

WORDS = "river stone light wind garden paper orange window silver morning travel bridge cloud forest letter music winter summer market engine".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n))


#: doc_id, text: copies, near copies, a shared passage, empty, null, tiny and long texts, repeated rows and a null id.
PASSAGE = prose(99, 70)
ROWS = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),
    (3, prose(1, 120).replace("river", "River").rsplit(" ", 1)[0] + " changed"),
    (4, prose(4, 60) + " " + PASSAGE + " " + prose(5, 60)),
    (5, PASSAGE + "\n" + prose(6, 80)),
    (6, ""),
    (7, None),
    (8, "   \t\n "),
    (9, "two words"),
    (10, "two words"),
    (11, "é" * 500 + prose(11, 10) + "é" * 500),
    (12, "a" * 700),
    (13, prose(13, 4000)),
    (13, prose(13, 4000)),
    (None, prose(14, 100)),
    (None, "x"),
    (15, prose(15, 200) + " under the MIT License. " + prose(16, 20)),
]


@pytest.fixture(scope="session")
def docs(spark):
    # Extra columns, two of which have names that operators use themselves.
    rows = [(i, t, f"s{k}", k, 0.5) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
