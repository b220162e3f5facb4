"""Small frames with the awkward cases every operator must handle."""

AWKWARD = [None, "", " \n\t", "x", "The MIT License", "a" * 70_000, "word " * 30_000, "é ü 漢字 \u00a0 \U0001f600", "same text here", "same text here"]


def docs_of(spark, texts, ids=None, extra=True):
    """doc_id, text and columns whose names clash with what operators use inside."""
    rows = [(i, t, "en", "s", 7, "p", 0.5, "k") for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, part string, score double, fp string"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def sf(spark, name, d="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{d}/{name}.parquet")
