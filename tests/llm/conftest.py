import pytest
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Further columns, some with names that helpers use.
EXTRA = "h string, rid bigint, row string, g int, blob string, rn int, `key` string, k int, id string, size bigint, copies int, part int, doc string, v string, label int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null columns, empty and long texts, ties, repeated rows and clashing names."""
    long_text = " ".join(f"word{i % 977} and{i}" for i in range(40_000))
    rows = [
        (0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "ONE"), (5, "one"), (5, "one"), (6, long_text), (7, long_text.upper()), (8, "a b c d e f g"), (9, "a b c d e f g"), (9, "other text of the same id here"),
        (None, "no id at all in this row"), (None, None), (10, "Ünïcode ÄÖ é \x00 \U0001f600 text " * 20), (11, "x" * 5000), (12, "mail a@b.co now"),
    ]
    full = [(i, t, None if (i or 0) % 3 == 0 else "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", None) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    from pyspark.sql import functions as F

    for column in EXTRA.split(", "):
        name, kind = column.replace("`", "").split()
        df = df.withColumn(name, F.lit(None).cast(kind) if name != "label" else F.lit(7))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
