import pytest
from pyspark.sql import types as T

#: Cases every operator over documents must stand: null and empty texts, white space only, repeated rows and ties, odd characters.
ODD = ["", None, " ", "  two  blanks ", "\n\n", "a", "word " * 3000, "same text here", "same text here", "Ünïcödé ßtraße 你好 мир",
       "x" * 5000, "▁ marks ▁▁ stay", "tab\tand\r\nline", "emoji 👩‍👩‍👧  nbsp em", "don't stop. It's 42! <|endoftext|> \\u0000"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", f"src{i % 2}", None if t is None else len(t), "clash") for i, t in enumerate(ODD)]
    rows += [rows[0], (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string("doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
