import random

import pytest

WORDS = "the of and river stone house lantern copper window meadow signal amber thirty quiet harbor velvet cinder maple ribbon walnut".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, blanks, ties, repeated rows, a very long text, near copies and clashing extra columns."""
    rng = random.Random(7)
    long = prose(rng, 30_000)
    base = prose(rng, 300)
    near = base.split()
    near[150] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.replace(" ", "\n", 5)), (5, None), (6, ""), (7, " \t\n"),
        (8, long), (9, long + " end"), (10, "one"), (11, "One"), (12, "two words"), (13, "<|endoftext|> a</s>b ▁x  y  "),
        (14, "naïve café ÉTÉ Straße 日本語のテキスト 😀"), (2, base), (None, "no id"), (15, prose(rng, 60)), (16, "x" * 5000), (17, "\x0b\x0c\r"),
    ]
    rows += [(100 + i, prose(rng, rng.randint(1, 80))) for i in range(60)]
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int, key string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
