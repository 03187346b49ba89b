"""A corpus in five stages: toxicity, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns a DataFrame;
all but the last return the columns of ``documents``, whatever their names, with the values that they had. An
empty table stays empty. Null and empty texts are judged as empty texts; rows of null ids are kept or dropped by
the same rules as others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlake.llm.common import cut, named, table
from freightlake.llm.jaccard import drop_near_duplicates
from freightlake.llm.packing import op5_packing
from freightlake.llm.quality import score_quality
from freightlake.llm.substrings import remove_repeats
from freightlake.llm.toxicity import fold, score_toxicity

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that none has the name of a column that an operator adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*named(*rest)).alias("rest")] if rest else []))


def _as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows that were taken apart."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; repeated rows all stay or all go."""
    scored = score_toxicity(_apart(docs), table(spark, sf_dir, "labels"), fold(3) != 1)
    return _as_before(scored.where("predicted = 0"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; repeated rows all stay or all go."""
    scored = score_quality(_apart(docs), table(spark, sf_dir, "labels"), fold(5) != 0)
    return _as_before(scored.where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; those without words all stay."""
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; a document that loses none keeps its row as it is."""
    rows = remove_repeats(_apart(docs))
    loses = F.col("n_removed") > 0
    new = {"text": F.when(loses, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        count = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["rest"] = F.col("rest").withField("n_chars", F.when(loses, count).otherwise(F.col("rest.n_chars")))
    return _as_before(rows.withColumns(new), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return op5_packing(spark, sf_dir, docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
