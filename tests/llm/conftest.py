import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def as_docs(spark):
    """Rows of (doc_id, text, lang, source) as a documents table, with columns whose names clash with the operators' own."""

    def make(rows, *extra):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def saved(tmp_path_factory):
    """Write tables under a fresh folder and return it, as the queries expect."""

    def make(**tables):
        path = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make


#: Nulls, empty and blank texts, repeated rows, repeated and null ids, equal texts, a long text.
ODD = [
    (None, None, None, None),
    (None, "alpha beta gamma delta epsilon zeta", "en", None),
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \n\t", "en", "b"),
    (4, "Alpha beta gamma delta epsilon zeta", "en", "b"),
    (4, "Alpha beta gamma delta epsilon zeta", "en", "b"),
    (5, "alpha beta gamma delta epsilon zeta", "fr", "b"),
    (6, "12345 !!! ???", "en", "c"),
    (7, "lorem ipsum " * 20_000, "fr", "c"),
    (8, "9" * 5_000 + "a" * 5_000, "fr", "c"),
    (9, "日本語 текст 😀 é", "xx", "d"),
]
