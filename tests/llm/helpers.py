"""Small tables with every awkward case, and brute-force versions of the operators."""

from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("key", T.StringType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("slot", T.StringType()),
    ]
)


def docs(spark, rows, parts=3):
    """Rows are (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "k", "x", "c", "z") for r in rows]
    return spark.createDataFrame(full, DOC).repartition(parts) if full else spark.createDataFrame([], DOC)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (None, "null id"),
    (5, "Same text here"),
    (5, "Same text here"),
    (6, "Same  text here "),
    (None, "Same text here"),
    (7, "naïve café 🙂 日本語 \x00 end"),
    (8, "a" * 5000),
    (9, "word " * 3000),
    (10, "<|endoftext|> and don't\n\n\n  stop"),
]


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
