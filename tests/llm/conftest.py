import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, ids binary, fp long, k1 long, shard int, "
    "salt int, h long, at long, start long, cell string, kept boolean, score double, place long, key long"
)


def sentence(rng: random.Random, words: int) -> str:
    parts = ["on", "the", "of", "ring", "tha", "é", "ß", "er", "st", "ou"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Ids and texts: nulls, empty and long texts, ties, copies, near copies, repeated rows and odd characters."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 160)) + "\n" + sentence(rng, 30) for _ in range(25)]
    shared = sentence(rng, 70)
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts, 10))
    rows += [(100, texts[0]), (101, texts[0]), (5, texts[1]), (102, texts[2] + " more"), (103, texts[2].upper())]
    rows += [(110 + i, f"{sentence(rng, 12)} {shared} {sentence(rng, 9 + i)}\nA common line of text\n{i}") for i in range(6)]
    rows += [(120, shared + "\n  a COMMON line of text \t"), (121, "A common line of text"), (122, "A common line of text")]
    rows += [(130, None), (131, ""), (132, " \n\t \n"), (None, texts[3]), (None, texts[4]), (133, None), (131, "")]
    rows += [(140, " ".join([shared] * 60)), (141, "x" * 5_000), (142, "<|endoftext|> a<|endoftext|>\x1c\x85 　b  c\r\n")]
    rows += [(150, "ab " * 400), (150, "ab " * 400), (151, "-1 km 5% $7 Élan Σας İb 漢字👍🏽")]
    return rows


@pytest.fixture(scope="session")
def odd_pairs():
    return odd_rows()


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names operators use themselves."""
    rest = (7, None, 3, 1, 2, 4, 5, 6, 7, "c", False, 0.5, 8, 9)
    rows = [
        (i, t, [None, "en", "fr"][k % 3], [None, "s"][k % 2], rest[0], bytearray(b"abc"), *rest[2:])
        for k, (i, t) in enumerate(odd_rows())
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def by_id():
    """Rows as a sorted list that nulls can be part of."""
    def sort(rows):
        return sorted((tuple(r) for r in rows), key=repr)

    return sort
