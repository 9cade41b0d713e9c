import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text[, source]) as a documents table with columns that clash with results."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        extra = "spans items score kept component_id n_words k1 h1 pos kind start len length offset k1_".split()
        for name in extra:
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))
