"""Small tables with the awkward cases every operator must define a result for."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, value string, label string, n long, size long, a long, b long, shard long, before long, taken long"


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(words))


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None, "k", None, "l", 7, 7, 7, 7, 7, 7, 7)


def awkward():
    base = prose(1, 120)
    near = base.replace("w1", "q1", 1)
    return [
        row(1, base), row(2, base), row(3, near, None, None), row(4, None, None, None), row(5, ""), row(6, " \n\t "),
        row(7, "one"), row(8, "one"), row(9, "two words"), row(10, "é ß 中文 \u2028 x", "fr", "s2"), row(11, "1234 !!!"),
        row(12, prose(5, 30_000), "de", "s2"), row(12, prose(6, 50)), row(12, prose(6, 50)), row(None, base), row(None, None, None, None),
        row(13, "x" * 70_000), row(14, prose(9, 60) + "\n" + base[:200], "fr", "s3"), row(15, "a" * 200 + " " + base[50:300]),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
