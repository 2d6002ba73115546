import pytest
from pyspark.sql import functions as F

from wardlog.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; tables may hold them too.
CLASHING = (
    "row rank size digest bucket slot key label node cls label_ n block group start own copies copies_ declared host suffix "
    "score taken target words places gram weight length sequence_id keep_id kept _row _bucket"
).split()


@pytest.fixture(scope="session")
def docs_of(spark):
    prepare(spark)

    def build(rows, clash=False):
        """Documents from (doc_id, text, lang, source) rows."""
        df = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df

    return build


ENGLISH = "the quick brown fox jumps over the lazy dog and one of them is a text without an end that had to be there".split()
LONG = " ".join(f"{ENGLISH[i % 23]} {i}" for i in range(9000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "the  quick\tbrown fox jumps over the lazy dog", "en", "b"),
        (3, None, "de", "b"),
        (4, "", None, None),
        (5, " \n\t ", "fr", "b"),
        (6, LONG, "en", "a"),
        (7, LONG + " end", "en", None),
        (None, "a text without an id", "en", "a"),
        (None, None, None, None),
        (8, "12 34 !!", "xx", "c.example"),
        (9, "one", "en", "a"),
    ]
