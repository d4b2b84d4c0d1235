import pytest

#: Clashes with names that the operators use or return.
CLASHING = "_row long, kept boolean, n_tokens long, spans string, key string, score double, cluster string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t), 7, True, 1, "x", "k", 0.5, "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, parts=3):
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    words = "the quick brown fox jumps over the lazy dog and runs far away from home".split()
    long = " ".join(words[(i * 7) % len(words)] + str(i % 97) for i in range(20_000))
    rows = rows_of([None, "", " \n\t", "Hello, World", "hello world!", "mail me at ann@example.org or +1 (555) 123-4567", long, long + " end", "é ñ ü", "a b c d e f g h i j k l"])
    rows += [rows[5], rows[5], rows[6]]
    nulls = list(rows[9])
    rows += [(None, nulls[1], None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows
