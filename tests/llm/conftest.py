import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text, ...) rows; what a row lacks is null."""

    def make(rows, extra=()):
        schema = DOCS + "".join(f", `{name}` string" for name in extra)
        width = 5 + len(extra)
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


#: Rows that every operator has to bear: null and empty texts, null ids, equal rows, a long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (None, "a null id with a few words in its text here", "en", "s", 1),
    (None, None, None, None, None),
    (4, "the same row twice and twice again in this table", "en", None, 1),
    (4, "the same row twice and twice again in this table", "en", None, 1),
    (5, "one", "en", "s", 3),
    (6, "long " * 30_000 + "end", "en", "s", 1),
    (7, "é ü ñ 漢字     x\u0000y 😀", "xx", "t", 1),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents([r + ("a", "b", "c") for r in ODD], extra=("size", "row", "kept"))
