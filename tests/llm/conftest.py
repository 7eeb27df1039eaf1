import duckdb
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators also use inside.
CLASHING = "id long, fp long, score double, kept boolean, row string, pass long, block long, key string, digest string, component_id long, lost string, mark long, uid long, rest string, held_out boolean, word string, n long"

LONG = "long tail " * 30_000 + "\n" + "One line of some length\n" * 50
TEXTS = [
    "The first line of a text\nThe second line of a text\nshort",
    "  THE FIRST line of a text\t\nSomething else entirely here\n\nshort",
    "The first line of a text\nThe first line of a text\nlast line of this one",
    "über die straße gehen wir heute\nüber die straße gehen wir heute",
    "a b c d e f g a b c d e f g a b c d e f g",
    "12345 67890 ### $$$ 12345",
    "word",
    "\n\n",
    " \t ",
    "",
    None,
    LONG,
    "emoji 😀😀😀 line that is long\nıİ ſ dotless line that is long",
    "<|endoftext|> in a text <|endoftext|>",
]


def edge_rows():
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0]]  # repeated rows
    rows += [(50 + i, TEXTS[1], "fr", "a", 1) for i in range(5)]  # copies
    rows += [(None, "The first line of a text\nThe second line of a text\nof nobody", "en", "a", 3), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Rows with extra columns under names that the operators use themselves."""
    extra = len(CLASHING.split(","))
    return spark.createDataFrame([(*r, *([None] * extra)) for r in edge_rows()], f"{COLUMNS}, {CLASHING}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(sf_dir):
    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
