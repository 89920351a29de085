import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    parts = ["the", "of", "an", "tion", "er", "re", "ing", "st", "ou", "ha"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def table(spark, rows):
    """A documents table of (doc_id, text) or longer rows, with extra columns whose names clash with results."""
    full = [(*r, *("en", "src0", len(r[1] or ""))[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame(full, COLUMNS).selectExpr("*", "'x' AS keep_id", "1.5D AS kept", "array(1) AS n_words", "'y' AS rate", "2 AS start")


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, junk, copies, near copies, shared passages, empty and null texts, one very long text."""
    rng = random.Random(7)
    base = [prose(rng, rng.choice([3, 30, 80, 200, 400])) for _ in range(60)]
    passage = prose(rng, 70)
    rows = list(base)
    rows += [base[3], base[3], base[4].replace(" ", "  ") + " ", base[5] + " extra", base[10] + "\n" + passage, passage, prose(rng, 50) + " " + passage + " " + prose(rng, 20)]
    rows += ["", None, " \t\n", "one", "a b", "word " * 300, "ab cd " * 60, "Ünï çode 'll don't 12 $$ ### " * 20, prose(rng, 20_000)]
    words = base[20].split()
    for k in range(12):
        near = list(words)
        near[(k * 7) % len(near)] = "changed"
        rows.append(" ".join(near))
    rows += [base[6]] * 15
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]
