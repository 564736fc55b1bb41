import pytest

LONG = "word " * 3000 + "x" * 5000
ROWS = [
    (1, "The cat and the dog went to the house of the old man. It is in a field that was green on the other side.", "en", "a", 1),
    (2, "The cat and the dog went to the house of the old man. It is in a field that was green on the other side.", "en", "a", 1),
    (3, "Der Hund und die Katze gehen in das Haus. Es ist nicht der Mann mit den grünen Augen von der Straße.", "de", "b", 1),
    (4, "Le chat et le chien sont dans la maison. Les enfants et les parents mangent des pommes sur une table.", "fr", None, None),
    (5, None, "en", "b", None),
    (6, "", None, "c", 0),
    (7, " \t\n ", "es", "c", 3),
    (8, LONG, "en", "a", len(LONG)),
    (9, "123 456 !!! ###", "en", "a", 15),
    (None, "El perro y el gato van a la casa de la mujer que no es de aquí por los campos.", "es", "a", 1),
    (10, "one two", "en", "a", 7),
    (10, "one two", "en", "a", 7),
    (11, "ΣΑΣ é \x00 𝕏 a▁b <|endoftext|> İstanbul", None, "z", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and names that operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    extra = ("row", "fp", "piece", "length", "score", "kept", "n_words", "_words", "words", "key", "a", "b", "_id", "v", "at", "component_id", "ids", "entropy", "_text", "_lang", "_rows", "_stay", "_gone", "_again", "_row", "id", "n", "stays", "_salt", "_action", "_digest")
    return rows.withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
