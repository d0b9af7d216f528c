import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp long, id long, score double, label string, bucket int, shard int, length long, chunk long"


def _row(i, text, lang="en"):
    return (i, text, lang, "s", None, 1, 2, 3, 0.5, "x", 1, 1, 1, 1)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts and languages, empty and very long texts, ties, repeated rows, columns with clashing names."""
    texts = [None, "", "   \n\t ", "?!... --- ***", "word", "two words", "The cat sat on the mat, and the dog did too.", "the cat sat on the mat, and the dog did too.", "日本語のテキスト 🙂 мир", "long " * 120_000, "x" * 300_000, "a\x00b\x1cc\x85d", "\\### Assistant: </turn> ok"]
    rows = [_row(i, t, None if i % 3 == 0 else "de" if i % 3 == 1 else "en") for i, t in enumerate(texts)]
    rows += [_row(None, "a row without an id"), _row(None, None, None), _row(6, texts[6]), _row(6, texts[6]), _row(6, "another text under the same id")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
