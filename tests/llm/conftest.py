import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs(texts) or make_docs(rows): a documents table."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r, "en", f"s{i % 3}", len(r or "")) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls in every column, empty and long texts, copies, repeated rows."""
    word = "Lorem ipsum dolor sit amet consectetur"
    rows = [
        (1, "The same text.", "en", "a", 14),
        (2, "the SAME text.", "de", None, None),
        (3, None, None, "b", None),
        (4, "", "en", "b", 0),
        (None, "no id " + word, "en", "b", 44),
        (6, " ".join(f"{word} {i}" for i in range(3000)), "fr", "c", None),
        (7, "Été ÉTÉ " + word, "fr", "c", 44),
        (7, "Été ÉTÉ " + word, "fr", "c", 44),
        (8, "été été " + word, None, "", 44),
        (9, "日本語のテキスト <|endoftext|> " + word, "ja", "a", 40),
        (10, " \n\t ", "en", "a", 4),
    ]
    return make_docs(rows)
