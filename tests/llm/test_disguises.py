"""Insults with signs for letters, at any place of the word."""

import pytest
from pyspark.sql import functions as F

from freightlake.llm import toxicity

LEARNED = ("zorgle*", "tasi")


def hidden(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = toxicity.features(F.col("text"), LEARNED)
    rows = df.select("i", *[found[k].alias(k) for k in ("hidden", "obfuscated")], F.size(F.split("text", " ")).alias("n")).orderBy("i").collect()
    return [round(r["hidden"] * r["n"]) for r in rows], [r["obfuscated"] > 0 for r in rows]


@pytest.mark.parametrize("word", ["$tupid", "@sshole", "1diot", "5lut", "|diot", "!diot", "idio7", "id|ot", "tr@sh", "stup1d1ty", "z0rgle", "z*rgle", "7asi", "tas|", "7451"])
def test_disguised_words(spark, word):
    texts = [f"you are {word} really", word, f"{word.upper()}!", f"trash! what {word}, idiot", f"({word}) {word}"]
    assert hidden(spark, texts)[0] == [1, 1, 1, 1, 2]


def test_plain_words_are_not_hidden(spark):
    texts = ["trash! idiot! *stupid* @idiot |moron| $scum", "on the 3rd @name paid $100 for 5 items | 1999!", "zorgle! tasi", "xidiot x1diot 1diots2", ""]
    assert hidden(spark, texts)[0] == [0] * 5


def test_bar_between_letters_is_a_disguise(spark):
    assert hidden(spark, ["id|ot", "a | b"])[1] == [True, False]
