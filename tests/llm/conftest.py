"""Small tables with every awkward row."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, th int, cid long, `kept_text` string"


def word(rng, size=400):
    return f"w{rng.randint(0, size)}"


def rows(seed=1):
    """Documents with copies, near copies, shared passages, repeats, nulls, blanks and a long text; names that clash with the operators' own."""
    rng = random.Random(seed)
    passage = " ".join(word(rng, 5000) for _ in range(60))
    out = []
    for i in range(0, 120, 2):
        kind = i // 2 % 6
        text = " ".join(word(rng) for _ in range(rng.randint(20, 90)))
        if kind == 1 and len(out) > 4:
            text = out[-3][1]
        elif kind == 2 and out:
            words = (out[-1][1] or "").split()
            for _ in range(2):
                if words:
                    words[rng.randrange(len(words))] = word(rng, 9999)
            text = " ".join(words)
        elif kind == 3:
            text = text[:50] + "\n" + passage + "\n" + text[50:] + "\nsame line\nand the next\n" + word(rng)
        elif kind == 4:
            text = text + "\n\n" + "A B c\td\u000be f " + text.upper()
        out.append((i, text))
    out += [(1001, None), (1003, ""), (1005, " \n\t "), (1007, "12 34 !!"), (1009, "one two"), (1011, "one two"), (1013, "One  TWO"), (None, out[0][1]), (None, None), out[3], out[3]]
    out.append((1015, " ".join(word(rng, 50000) for _ in range(12000))))
    out.append((1017, "über straße ñandú 日本語 emoji \U0001f600 é don't I'M x_1 3.14 " * 3))
    return [(i, t, ["en", "de", None][n % 3], "s", 0, 0.5, 1, 2, 3, "x") for n, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
