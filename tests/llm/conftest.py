import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns named like ones that operators make or use.
CLASHING = "fp string, score string, kept string, block string, kind string, place string, root string, row string, severity string"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a table like ``documents`` from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1]) if r[1] else 0) for r in rows]
        if clashing:
            n = len(CLASHING.split(", "))
            return spark.createDataFrame([(*row, *["x"] * n) for row in full], f"{SCHEMA}, {CLASHING}")
        return spark.createDataFrame(full, SCHEMA)

    return build


#: Nulls in every column, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (None, None, None),
    (None, "a text without an id that is long enough to count"),
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, "word " * 30_000),
    (5, "x" * 50_000),
    (6, "one line\nanother line of some length here\none line"),
    (6, "one line\nanother line of some length here\none line"),
    (7, "one line\nanother line of some length here\none line", None),
    (8, "é 😀 ünï code   ñ"),
]


@pytest.fixture(params=[False, True], ids=["plain", "clashing"])
def odd_documents(documents, request):
    return documents(ODD, request.param)


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf="sf0.001": spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
