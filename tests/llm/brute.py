"""Plain versions of the operators, and odd tables that all of them must take."""

import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, fp long, size long, n long"


def odd_docs(spark, texts):
    """Documents with null ids, null and empty texts, repeated rows and columns whose names clash with inner ones."""
    rows = [(i, t, "en", f"src{i % 3}", 1, 0.5, "x", 7, 3, 2) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None, None, None, None, None, None), (1001, "", "en", "src1", 0, 0.0, "", 0, 0, 0), (None, "a b c d", "en", None, 1, 0.0, "", 0, 0, 0)]
    rows += [(1002, " \t\n ", "en", "src1", 0, 0.0, "", 0, 0, 0), rows[0], rows[0], (1003, "word " * 60000, "en", "src2", 1, 0.0, "", 0, 0, 0)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df: pd.DataFrame) -> list:
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))
