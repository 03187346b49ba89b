"""Op 9, document fingerprints by winnowing, with DataFrame functions only.

Every ``GRAM`` consecutive words have a rolling hash: the polynomial of their hashes in ``BASE`` modulo
``PRIME``, in Horner's form. From every ``WINDOW`` consecutive hashes the smallest is kept, the rightmost where it ties, with its position. Two texts that
share ``GRAM + WINDOW - 1`` consecutive words share a kept hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

GRAM = 3
WINDOW = 6
#: The polynomial's point and modulus: products stay below 2**62.
BASE, PRIME = 1_000_003_037, (1 << 31) - 1
#: Documents of a bucket of the order by doc_id, and quantiles that the driver holds; evenly cut beyond them.
ROWS_TOGETHER, MOST_BOUNDS = 2000, 10_000
#: Low bits that hold a position, from the right; the hash is above them.
POSITION_BITS = 31
_LAST = (1 << POSITION_BITS) - 1
_SPACES = " \t\n\x0b\f\r"


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _zip(a: Column, by: int, b: Column, f) -> Column:
    """f(a[i], b[i + by]) for every i that has both."""
    right = _shifted(b, by)
    n = F.least(F.size(a), F.size(right))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(right, F.lit(1), n), f)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: array<long>, each a hash of 31 bits above ``2**31 - 1 - position``; in order of position.

    Null and blank texts have none; a text with fewer than GRAM words is one gram; one with fewer than
    WINDOW grams keeps its smallest.
    """
    w, g, p, m2, m4, k = (f"__{out}_{x}" for x in ("w", "g", "p", "m2", "m4", "k"))
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACES))
    rolled = lambda h, word: (h * BASE + word) % PRIME
    least = lambda x, y: F.least(x, y)
    df = df.withColumn(w, F.when(F.length(trimmed) > 0, F.transform(F.split(trimmed, r"[ \t\n\x0B\f\r]+"), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))).otherwise(F.array().cast("array<long>")))
    whole = F.array(F.aggregate(F.col(w), F.lit(0).cast("long"), rolled))
    for i in range(1, GRAM):  # a gram of i + 1 words is one of i words and the next word
        df = df.withColumn(f"{g}{i}", _zip(F.col(f"{g}{i - 1}" if i > 1 else w), i, F.col(w), rolled))
    df = df.withColumn(g, F.when(F.size(w) >= GRAM, F.col(f"{g}{GRAM - 1}")).when(F.size(w) > 0, whole).otherwise(F.col(w)))
    df = df.withColumn(p, F.transform(F.col(g), lambda h, i: F.shiftleft(h, POSITION_BITS) + (F.lit(_LAST) - i)))
    df = df.withColumn(m2, _zip(F.col(p), 1, F.col(p), least)).withColumn(m4, _zip(F.col(m2), 2, F.col(m2), least))
    mins = _zip(F.col(m4), WINDOW - 2, F.col(m2), least)
    df = df.withColumn(k, F.when(F.size(p) >= WINDOW, F.array_distinct(mins)).when(F.size(p) > 0, F.array(F.array_min(p))).otherwise(F.col(p)))
    return df.withColumn(out, F.col(k)).drop(w, g, p, m2, m4, k, *[f"{g}{i}" for i in range(1, GRAM)])


def as_text(fingerprint: Column) -> Column:
    """``hash@position`` of each kept gram, hash in hexadecimal, separated by spaces."""
    one = lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, POSITION_BITS))), F.lit("@"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"))
    return F.array_join(F.transform(fingerprint, one), " ")


def hashes_of(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of kept hashes; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _order_buckets(docs: DataFrame, key: str, tie: str) -> Column:
    """A bucket number that grows with the key, by quantiles of the key and even cuts between them.

    Null keys and keys that fill more than a bucket are split by the first bits of the tie.
    """
    n = docs.count()
    wanted = max(1, n // ROWS_TOGETHER)
    k = min(MOST_BOUNDS, wanted)
    cuts = -(-wanted // k)
    bits = min(24, max(8, wanted.bit_length()))
    probs = [i / k for i in range(1, k)] or [0.5]
    got = docs.agg(F.percentile_approx(key, probs, 5 * MOST_BOUNDS).alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    found = got["q"] or []
    often = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})  # keys that fill more than a bucket
    bounds = sorted({*found, *(x + 1 for x in often if x + 1 < 1 << 63)})
    width = max(1, round(len(bounds) ** 0.5))
    coarse = bounds[::width]
    fine = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(key)))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    c = below(longs(coarse))
    f = F.when(c > 0, below(F.element_at(F.array(*[longs(x) for x in fine]), F.greatest(c, F.lit(1))))).otherwise(F.lit(0)) if fine else F.lit(0)
    bucket = (c * (width + 1) + f).cast("long")
    if cuts > 1 and bounds:
        at = F.when(c > 0, (c - 1) * width + f).otherwise(F.lit(0)) + 1
        edges = F.array(*[F.lit(float(x)) for x in (got["lo"], *bounds, got["hi"])])
        start, end = F.element_at(edges, at), F.element_at(edges, at + 1)
        share = F.when(end > start, (F.col(key).cast("double") - start) / (end - start)).otherwise(F.lit(0.0))
        bucket = bucket * cuts + F.least(F.greatest(F.floor(share * cuts), F.lit(0)), F.lit(cuts - 1))
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(bucket).cast("long")
    of_many = F.col(key).isNull() | (F.col(key).isin(often) if often else F.lit(False))
    return bucket * (1 << bits) + F.when(of_many, F.shiftright(tie, 64 - bits) + (1 << bits - 1)).otherwise(F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """Each (doc_id, text) with ``next_text``: that of the next document by descending doc_id, cyclic.

    Null ids come last; equal ids are ordered by the hash of their texts. The order is cut into buckets
    by quantiles of doc_id, and null or frequent ids further by that hash: a window runs inside each, and a
    bucket's last row takes the first of the bucket below it.
    """
    docs = docs.withColumn("__h", F.xxhash64("text"))
    docs = docs.withColumn("__bucket", _order_buckets(docs, "doc_id", "__h"))
    order = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "__h")
    heads = docs.groupBy("__bucket").agg(F.max_by("text", order).alias("__head"))
    names = docs.groupBy("__bucket").count()
    every = Window.orderBy(F.desc("__bucket"))
    after = names.select("__bucket", F.coalesce(F.lead("__bucket").over(every), F.max("__bucket").over(every)).alias("__from"))
    heads = heads.withColumnRenamed("__bucket", "__from").join(after, "__from").select("__bucket", "__head")
    inside = Window.partitionBy("__bucket").orderBy(F.desc("__o"))
    rows = docs.withColumn("__o", order).withColumn("__lead", F.lead(F.struct("text")).over(inside))
    rows = rows.join(heads, "__bucket", "left")
    return rows.withColumn("next_text", F.when(F.col("__lead").isNull(), F.col("__head")).otherwise(F.col("__lead.text"))).drop("__h", "__bucket", "__o", "__lead", "__head")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text, and how alike they are.

    A null text is empty. A table of one document is its own next. Texts without words have an empty
    fingerprint; two empty ones are alike (1.0), an empty and another are not (0.0).
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    for text, out in (("text", "f"), ("edited", "e"), ("next_text", "x")):
        rows = with_fingerprint(rows, text, out)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "f", "e", hashes_of(F.col("f")).alias("fh"), hashes_of(F.col("e")).alias("eh"), hashes_of(F.col("x")).alias("xh"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("fh"), F.col("eh")).alias("near_edited"), likeness(F.col("fh"), F.col("xh")).alias("near_next"),
    )
