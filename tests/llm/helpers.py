"""Small tables with every awkward row, shared by the operator tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like ones that operators use inside.
CLASH = "fp long, root long, size long, rate double, score double, pos int, v string, count long, key string, predicted int, kept string, th long"


def docs(spark, rows, clash=True):
    """``rows``: (doc_id, text, lang, source) tuples."""
    full = [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]
    df = spark.createDataFrame(full, DOCS)
    if not clash:
        return df
    for name, kind in (c.split() for c in CLASH.split(", ")):
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit(7).cast(kind))
    return df


def prose(seed: int, words: int, letters: str = "abcdefghij") -> str:
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(words))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
