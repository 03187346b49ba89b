"""Op 10, toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, named, table

#: At most about so many labelled rows fit the model; more are thinned out by a hash of their ids.
TRAIN_ROWS = 10_000
REJECT = 0.7
#: Insults that any language model of the text would know; a star stands for any ending.
LEXICON = (
    "idiot*", "moron*", "stupid*", "loser*", "clown*", "scum*", "trash", "pathetic", "worthless", "disgusting", "vermin", "imbecile*",
    "cretin*", "dimwit*", "halfwit*", "jerk*", "brainless", "retard*", "bastard*", "shit*", "fuck*", "bitch*", "asshole*", "whore*",
    "slut*", "dummkopf*", "trottel*", "arschloch*", "abschaum", "imbécile*", "connard*", "salaud*", "imbécil*", "estúpid*", "basura",
)
#: Beginnings of words, of so many letters, that labelled rows add to the lexicon: at most LEARNED, each found in
#: toxic rows far more often than chance allows (log-likelihood ratio) and
#: seldom in others. Those found in others more often are suspects, a feature of their own.
LETTERS, LEARNED, LEAST_RATIO, SURE, SUSPECT = (3, 8), 300, 22.0, 0.9, 0.4
SECOND_PERSON = ("you", "your", "yours", "youre", "yourself", "u", "ur", "du", "dich", "dein", "tu", "toi", "vous", "ton", "usted", "ti", "eres")
_LEET = ("013457@$!|*", "oieastasiio")
FEATURES = ("lexicon", "learned", "suspects", "suspected", "insults", "near_you", "capitals", "shouted", "exclaims", "symbols", "obfuscated", "hidden", "repeats", "words")


def _branches(words: set[str], letter: Callable[[str], str] = re.escape, ending: str = r"\p{L}*") -> str:
    """A pattern of all words (a star: any ending) that branches on one letter at a time."""
    if "*" in words:
        return ending
    parts = []
    for c in sorted({w[:1] for w in words}):
        rest = {w[1:] for w in words if w[:1] == c}
        parts.append(letter(c) + (_branches(rest, letter, ending) if c else ""))
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(sorted(parts, reverse=True)) + ")"


def _any(words: tuple[str, ...]) -> str:
    """The words, each between characters that are no letters or digits."""
    return r"(?<![\p{L}\p{N}])" + (_branches(set(words)) if words else "(?!)") + r"(?![\p{L}\p{N}])"


def _spellings(c: str) -> str:
    """A letter or what _LEET undoes to it."""
    signs = [sign for sign, plain in zip(*_LEET, strict=True) if c and plain == c]
    return f"[{''.join(map(re.escape, [c, *signs]))}]" if signs else re.escape(c)


def _disguised(words: tuple[str, ...]) -> str:
    """The words with at least one sign for a letter, wherever it stands; a sign beside a plain word is none."""
    signs, edge = "".join(map(re.escape, _LEET[0])), r"(?![\p{L}\p{N}])"
    return rf"(?<![\p{{L}}\p{{N}}])(?=\p{{L}}*[{signs}])(?!{_branches(set(words))}{edge}){_branches(set(words), _spellings, rf'[\p{{L}}{signs}]*')}{edge}"


def features(text: Column, learned: tuple[str, ...] = (), suspects: tuple[str, ...] = ()) -> dict[str, Column]:
    """Densities by word or by character of the whole text."""
    low = F.lower(text)
    chars = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("double")
    known = F.regexp_count(low, F.lit(_any(LEXICON)))
    new = F.regexp_count(low, F.lit(_any(learned))) if learned else F.lit(0)
    maybe = F.regexp_count(low, F.lit(_any(suspects))) if suspects else F.lit(0)
    disguised = F.regexp_count(text, F.lit(r"\p{L}[@$*#!|0-9]+\p{L}"))
    all_insults = tuple(sorted({*LEXICON, *learned}))
    hidden = F.regexp_count(low, F.lit(_disguised(all_insults)))
    you, insult = _any(SECOND_PERSON), _any(all_insults)
    gap = r"(?:[^\p{L}]+\p{L}+){0,3}?[^\p{L}]+"
    near = F.regexp_count(low, F.lit(f"{you}{gap}{insult}|{insult}{gap}{you}"))
    return {
        "lexicon": known / words,
        "learned": new / words,
        "suspects": maybe / words,
        "suspected": F.least(maybe, F.lit(20)),
        "insults": F.least(F.greatest(known, new), F.lit(20)),
        "near_you": F.when(known + new > 0, near / words).otherwise(F.lit(0.0)),
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "shouted": F.regexp_count(text, F.lit(r"(?<!\p{L})\p{Lu}{3,}(?!\p{L})")) / words,
        "exclaims": F.regexp_count(text, F.lit(r"[!?]")) / chars,
        "symbols": F.regexp_count(text, F.lit(r"[#$%&*@|]")) / chars,
        "obfuscated": disguised / words,
        "hidden": hidden / words,
        "repeats": F.regexp_count(text, F.lit(r"(\p{L})\1\1")) / words,
        "words": F.log1p(words),
    }


def learn_lexicon(texts: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Beginnings of words that tell toxic rows, sure ones and suspects, from (text, label): LEARNED of each at most."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    begins = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(LETTERS[0]), F.lit(LETTERS[1])), lambda k: F.transform(F.filter(words, lambda w: F.char_length(w) >= k), lambda w: F.substring(w, F.lit(1), k)))))
    n = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    if not n["n"] or not 0 < n["toxic"] < n["n"]:
        return (), ()
    counts = texts.select("label", F.explode(begins).alias("w")).groupBy("w").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("c"))
    total, toxic = float(n["n"]), float(n["toxic"])
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    a, c = F.col("a"), F.col("c")
    ratio = 2 * (part(a, c * toxic / total) + part(c - a, c * (1 - toxic / total)) + part(toxic - a, (total - c) * toxic / total) + part(total - c - (toxic - a), (total - c) * (1 - toxic / total)))
    best = counts.where((a >= SUSPECT * c) & (c >= 4)).select("w", (a >= SURE * c).alias("sure"), ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    best = cut(best, "lexicon")
    found = [[r["w"] for r in best.where(F.col("sure") == sure).orderBy(F.desc("ratio"), F.length("w"), "w").limit(LEARNED).collect()] for sure in (True, False)]
    covered = lambda w, words: any(w != v and w.startswith(v) for v in words)
    return tuple(f"{w}*" for w in found[0] if not covered(w, found[0])), tuple(f"{w}*" for w in found[1] if not covered(w, found[0] + found[1]))


def _with_features(rows: DataFrame, lexicons: tuple[tuple[str, ...], tuple[str, ...]]) -> DataFrame:
    return rows.withColumns({f"__{k}": c.cast("double") for k, c in features(F.coalesce("text", F.lit("")), *lexicons).items()})


def _for_scale() -> Column:
    """Whether a labelled row is kept from the trees and from the lexicon they use, to fit the scale: a quarter of the rows."""
    return F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0


def _fit(train: DataFrame):
    """A function that adds ``__score`` to rows with features, from rows that have ``__label`` too."""
    parts = {"trees": train.where(~_for_scale()), "scale": train.where(_for_scale())}
    classes = lambda t: [r["__label"] for r in t.select("__label").distinct().collect()]  # noqa: E731  two at most
    found = {k: classes(t) for k, t in parts.items()}
    if len(both := set(found["trees"]) | set(found["scale"])) < 2:
        constant = float(both.pop()) if both else 0.0
        return lambda rows: rows.withColumn("__score", F.lit(constant))
    parts = parts if min(map(len, found.values())) == 2 else {"trees": train, "scale": train}
    vector = VectorAssembler(inputCols=[f"__{k}" for k in FEATURES], outputCol="__vector")
    trees = GBTClassifier(labelCol="__label", featuresCol="__vector", maxIter=20, maxDepth=3, stepSize=0.25, seed=10)
    trees = trees.setPredictionCol("__class").setRawPredictionCol("__raw").setProbabilityCol("__probability")
    trees = trees.fit(vector.transform(parts["trees"]).select("__vector", "__label"))
    raw = lambda rows: trees.transform(vector.transform(rows)).withColumn("__p", vector_to_array("__probability")[1])
    scale = IsotonicRegression(labelCol="__label", featuresCol="__p", predictionCol="__scaled").fit(raw(parts["scale"]).select("__p", "__label"))
    return lambda rows: scale.transform(raw(rows)).withColumn("__score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__scaled")))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS, reject: float = REJECT) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with score and predicted.

    The model learns ``labels.toxic`` from labelled rows where ``learn`` (over doc_id) holds, at most about
    train_rows of them. Null labels are none; of several labels for an id the largest counts. A null or
    empty text has features 0 and a score. Without labels of both classes every score is the one class
    there is, 0 if none. Repeated rows each return; an empty table gives no rows. Columns of docs named
    score or predicted are replaced.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("__label")).where(learn)
    n = known.count()
    kept = cut(known.where(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(max(n, 1))) < train_rows), "known")  # about train_rows rows: small enough to broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(kept), "doc_id")
    lexicons = learn_lexicon(texts.where(~_for_scale()).select("text", F.col("__label").alias("label")))
    names = [f"__{k}" for k in FEATURES]
    model = _fit(cut(_with_features(texts, lexicons).select("doc_id", "__label", *names), "train"))
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    # the rows' own columns wait in one column, so that none has a feature's name
    scored = model(_with_features(docs.select(F.struct(*named(*columns)).alias("row"), "text"), lexicons))
    return scored.select("row.*", F.col("__score").alias("score"), (F.col("__score") >= reject).cast("int").alias("predicted"))


def fold(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
