import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, part int, fp string, Kept int"


def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; columns that clash with inner names."""
    long = "wort " * 30_000
    texts = [None, "", " \t\n", "one", "one", "a b c d e f g h i j k l", "Ärger über ß œ", long, "x" * 50_000, "mail a.b@c.de now 4111 1111 1111 1111 or 1.2.3.4 call +1 (555) 555-0199 end", "\U0001f600 smile", "\x00 zero \x0b tab"]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", None, "S", "é"][i % 4], len(t or ""), 1, "r", 2, "f", 3) for i, t in enumerate(texts)]
    out += [out[5]] * 3 + [(5, "another text of this id", "en", "s1", 23, None, None, None, None, None)]
    out += [(None, None, None, None, None, None, None, None, None, None)] * 2 + [(None, "no id here at all", "fr", "s1", 17, 1, "r", 2, "f", 3)]
    return out


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
