import datetime as dt  # noqa: F401

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """rows: (doc_id, text[, lang[, source]])"""
    def make(rows):
        full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)
    return make
