import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, first=0, extra=False):
        rows = [(first + i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:  # columns whose names the operators use too
            from pyspark.sql import functions as F

            for c in ("n_words", "score", "digest", "node", "key", "bands", "total", "members", "kept", "unit", "w"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make
