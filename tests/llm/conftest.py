import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, first string, digest string, key string, score string, gone string, spans string, n_tokens string, n_lines string, __file string, __row string, __whole string, keep_id string, token string, lang_pred string, mix_slot string, __predicted string, __counted string, __gone string, __spans string, __all string"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    base = [words(rng, 60, vocabulary) for _ in range(6)]
    line = lambda: words(rng, 9, vocabulary)
    shared = "\n".join(line() for _ in range(4))
    near = base[0].split()
    near[30] = "changed"
    texts = [
        None, "", " \n\t", base[0], base[0], base[0].replace(" ", "  "), " ".join(near), base[1], base[1].upper(), base[2] + " tail",
        f"{line()}\n{shared}\n{line()}", f"{shared}\n\n{line()}\n{shared}", "a b c", "a b c", "é🙂 日本語 x", base[3] * 40, base[4] + "\n" + base[5], "12345", ".,;",
    ]
    rows = [(i, t, ["en", None, "de"][i % 3], ["hot", "hot", None, "b"][i % 4], len(t or ""), "x", None, "k", "s", "g", None, "n", "l") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[2], "en", None, None, None, None, None, None), (None,), (3, "another text under a used id", "en", "hot", 1, "", "", "", "", "", "", "", "")]
    return [r + (None,) * (SCHEMA.count(",") + 1 - len(r)) for r in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
