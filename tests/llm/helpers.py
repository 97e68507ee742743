"""Documents with every awkward case, and the schema they have."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(f"{draw.choice(WORDS)}{draw.randrange(50)}" for _ in range(words))


def rows():
    base, long = prose(1, 120), prose(2, 30_000)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.replace(" ", "\n\t ")), (5, None), (6, ""), (7, "   \n\t"),
        (8, "word"), (9, long), (10, long + " end"), (11, "àé😀ß'll 's  x\r\n y"), (11, "àé😀ß'll 's  x\r\n y"),
        (12, prose(3, 80) + "\n" + base[100:400] + "\n" + prose(4, 80)), (None, base), (None, None), (13, "!!! ??? 123 ..."),
        (14, "same line of text here\nsame line of text here\nsame line of texts here\nother"), (15, "😀" * 200), (16, prose(5, 60)),
    ]
    langs = ["en", "en", "de", None]
    return [(i, t, langs[k % 4], f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def documents(spark, extra: bool = False):
    df = spark.createDataFrame(rows(), SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("score", "lang_pred", "kept", "id", "digest", "batch", "rank", "key", "node", "c", "label", "start"):
            df = df.withColumn(c, F.lit(c))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
