import pytest


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        """rows: texts, or (doc_id, text); extra adds columns with names that operators use inside."""
        rows = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for c in ("class", "n", "bucket", "kind", "blob", "slot", "shard", "row_key", "text_key", "pieces", "score", "component"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make
