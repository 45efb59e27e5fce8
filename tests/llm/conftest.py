import pytest

WORDS = "the of river stone walks under bright morning light and slowly turns toward distant hills where old houses stand in rows by quiet roads".split()


@pytest.fixture(scope="session")
def make_text():
    import random

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Rows (doc_id, text) with columns whose names clash with those that operators add."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1.5, "x", "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, found string, quality string")

    return make
