"""Frames for the tests of the training-data operators."""

DATA = "/root/testdata/sf0.001"


def documents(spark, sf_dir=DATA):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def frame(spark, rows, extra=""):
    """documents-like rows: (doc_id, text), or with lang and source."""
    width = max((len(r) for r in rows), default=2)
    names = ["doc_id bigint", "text string", "lang string", "source string"][:width]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(names))
    return df
