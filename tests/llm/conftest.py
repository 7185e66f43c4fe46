from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with copies, near copies, shared lines, junk, nulls, empty and long texts, repeated rows, and a clashing extra column."""
    rng = random.Random(5)
    rows = []
    common = "this line stands at the foot of every page"
    for i in range(60):
        text = "\n".join(" ".join(words(rng, 12)) for _ in range(rng.randrange(1, 8)))
        rows.append([i, f"{text}\n{common}", "en", f"s{i % 4}"])
    base = words(rng, 150)
    for i in range(60, 90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"x{rng.randrange(1000)}"
        rows.append([i, " ".join(w), "en", "s0"])
    rows += [[i, rows[3][1], "en", "s3"] for i in range(90, 96)]
    rows += [[96, None, None, None], [97, "", "en", "s1"], [98, " \n\t", "en", "s1"], [99, "Three Small words", "en", "s1"], [100, "three small WORDS", "en", "s2"]]
    rows += [[101, "a b c d e " * 400, "en", None], [102, " ".join(words(rng, 12000, 5000)), "en", "s0"], [103, "### $$$ &&& ### $$$ %%% " * 9, "en", "s1"]]
    rows += [[None, " ".join(words(rng, 40)), "en", "s1"], [104, "naïve café 字字 😀 " * 4, "fr", "s2"], [104, "naïve café 字字 😀 " * 4, "fr", "s2"]]
    out = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="session")
def texts(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
