"""Small documents with the cases every operator has to survive."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WIDE = DOCS + ", size int, score string, node int, label string, `__words` string, repeats string, found string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs(spark, texts, sources=None, first=1):
    """Texts numbered from ``first``; a pair (id, text) names its own id."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i + first, t)
        rows.append((doc_id, text, "en", sources[i] if sources else f"src{i % 3}", len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def odd_rows():
    rng = random.Random(5)
    long = sentence(rng, 20_000)
    near = sentence(rng, 300)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "b", 3),
        (5, long, "en", "a", len(long)), (6, near, "de", "a", 9), (6, near, "de", "a", 9), (7, near + " end", "de", None, 9),
        (None, "no id here at all", "en", "b", 5), (8, "x" * 50_000, "en", "b", 50_000), (9, "1" * 20_000, "en", "c", 2),
        (10, "Größe été \U0001f600 mail an.na@example.com \U0001f600", "fr", "c", 3), (11, "tie", "en", "d", 3), (12, "tie", "en", "d", 3),
    ]


def odd(spark):
    """Null and empty values, long texts, ties, repeated rows and columns whose names clash with inner ones."""
    rows = [r + (7, "s", 3, "l", "w", "r", "f") for r in odd_rows()]
    return spark.createDataFrame(rows, WIDE).repartition(3)


def empty(spark):
    return spark.createDataFrame([], WIDE)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def odd_labels(spark):
    return labels(spark, [(1, None, None), (2, 0, 0), (4, 1, 1), (5, 1, 0), (6, 1, 0), (6, 1, 0), (7, 1, 1), (None, 1, 1), (99, 0, 1), (8, 5, 7)])
