"""Small tables for the operators' tests."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, first=0):
    rows = [(first + i, t, "en", (sources[i] if sources else "s"), len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)
