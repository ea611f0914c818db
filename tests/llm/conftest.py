import random

import pytest

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure"


def some_texts(seed: int = 7) -> list[str | None]:
    """Texts with nulls, blanks, copies, near copies, shared passages, loops, odd characters and a very long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = words(120), words(60)
    near = [*base]
    near[100] = "changed"
    own = [words(rng.randint(5, 150)) for _ in range(12)]
    rows = [" ".join(w) for w in own]
    rows += [" ".join(base), " ".join(base), " ".join(near), " \t ".join(base)]
    rows += [" ".join(words(40) + passage + words(20)) for _ in range(4)]
    rows += ["der " * 90, "x", "", " \n\t ", None, None, "12 34 !?", "Ünïcödé 😀 straße " * 30, "a" * 3000, LONG, "\x00\x1c odd\x0bspace\x85 \xa0 here"]
    rows.append(" ".join(words(9000)))
    return rows


@pytest.fixture(scope="session")
def texts():
    return some_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with some null columns, a repeated row, a row without an id and columns whose names operators use inside."""
    rows = [(i * 3, t, ("en", "de", None)[i % 3], None if i % 4 else "s", None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id here at all", "en", "s", 17, "clash", 99)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, spans int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
