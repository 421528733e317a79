"""Small tables with the awkward cases that every operator has to take."""

import os

from pyspark.sql import functions as F

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def sentence(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def long_text(n: int = 30_000) -> str:
    return "\n".join(sentence(1000 + i, 60) for i in range(n // 60))


BASE = sentence(1, 300)
SPECIAL = [
    (None, "a text without an id " + sentence(2, 40), "en", "s1"),
    (None, None, None, None),
    (1, None, "en", "s1"),
    (2, "", "en", None),
    (3, " \n\t ", "en", "s2"),
    (4, BASE, "en", "s1"),
    (5, BASE, "en", "s1"),
    (5, BASE, "en", "s1"),
    (6, BASE.replace("people", "persons"), "en", "s3"),
    (7, sentence(3, 3), "en", "s2"),
    (8, sentence(3, 3), "en", "s2"),
    (9, "Ünïcode " + sentence(4, 120), "de", "s2"),
    (10, sentence(5, 100) + "\n" + sentence(6, 70) + "\n" + sentence(7, 100), "en", "s4"),
    (11, sentence(8, 100) + "\n" + sentence(6, 70) + "\n" + sentence(9, 100), "en", "s4"),
    (12, "word " * 400, "en", "s4"),
    (13, long_text(), "en", "s5"),
]


def special_documents(spark):
    """SPECIAL with columns whose names clash with those that operators might use inside."""
    rows = spark.createDataFrame(SPECIAL, "doc_id long, text string, lang string, source string")
    for name in ("node", "size", "_id", "_h", "bucket", "k", "label", "kept", "s", "c0", "n_words", "cell", "words", "spans", "ranges", "quality", "toxic", "p_junk"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).repartition(3)


def empty_documents(spark):
    return special_documents(spark).limit(0)


def table(spark, sf, name):
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
