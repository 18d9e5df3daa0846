import random

import pytest

WORDS = [a + b for a in ("an", "the", "tion", "er", "lo", "wu", "ki", "ra") for b in ("ba", "de", "fi", "go", "hu", "jy", "ka", "le", "mi", "no")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty and blank texts, ties, repeated lines, special strings, and one very long text."""
    rng = random.Random(5)
    same = prose(rng, 80)
    return [None, "", "   \n\t ", "word", same, same, same.upper(), "line\nline\n\nline\nother ## | <b>", "don't 'tis it's <|endoftext|> <|startoftext|> 've 'l ½ ١٢ 日本語 ÉÈ Σας", "x" * 3000, prose(rng, 30_000)] + [prose(rng, rng.randrange(1, 300)) for _ in range(60)]


@pytest.fixture()
def docs(spark, odd_texts):
    """The odd texts with a null source and id-like columns whose names clash with results."""
    rows = [(i, t, ["src0", "src1", None][i % 3], "en", 1, 2, 3, 4) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int, kept int, q int, component int").repartition(3)
