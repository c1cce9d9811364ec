import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, `row` int, `key` string, text_2 string, score int, copy int, `odd.name` string, component_id string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns with clashing names."""
    rest = ("x", 1, "k", "t", 2, 3, "o", "c")
    words = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "The cat and the dog. A house, a tree.\nNext line.", "en", "a", 40, *rest),
        (2, None, "en", "a", None, *rest),
        (3, "", None, None, 0, *rest),
        (4, "12 345 ...", "en", "", 10, *rest),
        (5, words, "en", "a", len(words), *rest),
        (6, "Der Hund und die Katze. Ein Haus.", "de", "b", 33, *rest),
        (6, "Der Hund und die Katze. Ein Haus.", "de", "b", 33, *rest),
        (7, "The cat and the dog. A house, a tree.\nNext line.", None, None, None, *((None,) * 8)),
        (None, "The dog and the cat.", "en", "b", 20, *rest),
        (None, None, None, None, None, *((None,) * 8)),
        (8, "<|endoftext|> a\tb  c </s> ▁x", "en", "b", 30, *rest),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
