"""Small document tables with the awkward cases, and helpers to run operators on them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "entre", "während", "thing", "ble", "ouer", "là", "ción", "Nicht", "house", "river"] + [f"w{rng.randrange(500)}" for _ in range(60)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def awkward():
    """(doc_id, text): null, empty, blank, short and long texts, copies, repeated rows, texts beyond ASCII, a null id."""
    shared = prose(1, 40)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "word"),
        (5, "Two words"),
        (6, prose(2)),
        (7, prose(2)),
        (7, prose(2)),
        (8, prose(2).replace(" ", "\t \n")),
        (9, prose(3) + " " + shared),
        (10, shared + "\n" + prose(4)),
        (11, prose(5, 3000)),
        (12, prose(5, 3000) + " tail"),
        (13, "aba " * 200),
        (14, "x" * 5000),
        (15, "é" * 300 + "\x00" + "日本語 テキスト 🙂 " * 20),
        (16, prose(6, 1) + " " + shared.upper()),
        (None, prose(7)),
    ]


def documents(spark, rows=None, extra=()):
    """The rows as a documents table in several partitions, with further columns of clashing names."""
    rows = awkward() if rows is None else rows
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA).repartition(3)
    for name in extra:
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
