"""Op 2, removal of repeated passages by seed and extend.

Seeds: from every window of consecutive words, the smallest of its word-gram hashes (the rightmost where it
ties) is its anchor, so equal windows have equal anchors at equal places. Documents are joined on anchors
that occur twice or more. Extension: around each shared anchor, the windows that it anchors are hashed and
compared with those of the anchor's other occurrences; runs of repeated windows are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, column, give_back, list_array, named, private, span_hashes, steps, table

WINDOW = 35
GRAM = 16
#: Documents whose shared anchors make up about one bucket, and the fewest buckets.
ROWS_TOGETHER, LEAST_BUCKETS = 1000, 64
#: An anchor with more occurrences is compared by a distributed count instead of within a bucket.
HOT = 4096
#: A row covers under 2**6 windows: ``at`` holds the first one's start above their number.
_N_BITS = 6
_MOST = 62


def anchors_of(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, start of the first window that it anchors, number of such windows, occurrences), in order.

    hashes are those of all words; bounds[i]:bounds[i+1] are one text's. Neighbouring anchors of one hash, as
    in text that repeats itself, share a row while it covers _MOST windows at most.
    """
    n = len(hashes) - window + 1
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(max(n, 0)) + window <= ends[: max(n, 0)])
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, starts
    begins = np.arange(len(hashes) - gram + 1)
    g = span_hashes(hashes, begins, begins + gram)
    low, at, width, wide = g, begins, 1, window - gram + 1
    while width < wide:  # minimum of 2 * width from two of width; the right one where they tie
        step = min(width, wide - width)
        left, right = slice(None, len(low) - step), slice(step, None)
        take = low[right] <= low[left]
        low, at = np.where(take, low[right], low[left]), np.where(take, at[right], at[left])
        width += step
    place = at[starts]
    apart = np.concatenate([[True], starts[1:] != starts[:-1] + 1])
    anchor = apart | np.concatenate([[True], place[1:] != place[:-1]])
    h = g[place]
    run = np.flatnonzero(apart | np.concatenate([[True], h[1:] != h[:-1]]))
    within = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
    first = np.flatnonzero(within % _MOST == 0)
    return h[first], starts[first], np.diff(np.append(first, len(starts))), np.maximum(np.add.reduceat(anchor.astype(np.int64), first), 1)


def _anchors(window: int, gram: int, rid_name: str, text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, text_name):
            words = Words(data, offsets)
            h, start, n, times = anchors_of(words.hashes(), words.bounds, window, gram)
            text = np.searchsorted(words.bounds, start, "right") - 1
            rid = column(batch, rid_name).to_numpy()[text]
            at = (start - words.bounds[text]) << _N_BITS | n
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rid), pa.array(at), pa.array(times)], names=["h", "rid", "at", "times"])

    return run


def _requests(window: int, buckets: int, most: int, rid_name: str, text_name: str, shared_name: str):
    """The window hashes around every shared anchor: (bucket, h, rid, at, windows); hot ones in buckets under 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, text_name):
            words = Words(data, offsets)
            shared = column(batch, shared_name)
            per_text = np.diff(shared.offsets.to_numpy())
            flat = shared.flatten()
            h, at, c = (flat.field(k).to_numpy() for k in range(3))
            text = np.repeat(np.arange(batch.num_rows), per_text)
            n = at & ((1 << _N_BITS) - 1)
            begins = np.cumsum(n) - n
            start = np.repeat((at >> _N_BITS) + words.bounds[text] - begins, n) + np.arange(int(n.sum()))
            spans = span_hashes(words.hashes(), start, start + window)
            rid = column(batch, rid_name).to_numpy()[text]
            bucket = np.where(c > most, -1 - rid % buckets, (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(h), pa.array(rid), pa.array(at), list_array(spans.view(np.int64), n, pa.int64())], names=["bucket", "h", "rid", "at", "windows"])

    return run


def _repeated(rows: pa.Table) -> pa.Table:
    """Of one bucket's windows, those that occur twice: (rid, at, mask), bit i for the anchor's i-th window.

    Windows are told apart by their anchor's hash and their own, since equal windows have equal anchors.
    """
    rows = rows.filter(pc.greater_equal(rows["bucket"], 0))
    lists = rows["windows"].combine_chunks()
    flat, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    anchor = np.repeat(rows["h"].to_numpy(), counts)
    order = np.lexsort((flat, anchor))
    equal = np.zeros(len(flat) + 1, bool)  # to the one before, in order
    equal[1:-1] = (flat[order[1:]] == flat[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
    twice = np.empty(len(flat), bool)
    twice[order] = equal[1:] | equal[:-1]
    begins = np.cumsum(counts) - counts
    bit = np.arange(len(flat)) - np.repeat(begins, counts)
    mask = np.add.reduceat(twice.astype(np.int64) << bit, begins) if len(flat) else np.zeros(0, np.int64)
    keep = mask != 0
    return pa.table({"rid": rows["rid"].to_numpy()[keep], "at": rows["at"].to_numpy()[keep], "mask": mask[keep]})


def _removal(window: int, names: list[str], text_name: str, marks_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = column(batch, text_name), column(batch, marks_name)
            ats, masks = (marks.flatten().field(k).to_numpy() for k in range(2))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
            kept, n_words, n_removed, spans = [], [], [], []
            for i, text in enumerate(texts):
                words = (text.as_py() or "").encode().split()
                a, b = ends[i - 1] if i else 0, ends[i]
                gone = []
                if b > a:
                    at, mask = ats[a:b], masks[a:b]
                    bit = np.arange(1 << _N_BITS)
                    row, off = np.nonzero(mask[:, None] >> bit & 1)
                    start = (at[row] >> _N_BITS) + bit[off]
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + window, -1)
                    covered = np.cumsum(change[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    gone = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                    n_removed.append(int(covered.sum()))
                    kept.append(b" ".join(compress(words, (~covered).tolist())).decode())
                else:
                    n_removed.append(0)
                    kept.append(b" ".join(words).decode())
                n_words.append(len(words))
                spans.append(gone)
            new = [pa.array(kept), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in names] + new, names=[*names, "kept_text", "n_words", "n_removed", "removed"])
        give_back()

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_above: int = HOT) -> DataFrame:
    """``docs`` with kept_text, n_words, n_removed and removed (maximal repeats as word positions).

    A word goes if a window of ``window`` words that covers it starts anywhere else too, in this or any
    other row; all windows are those of the input. Words are separated by spaces and tab to carriage
    return. A null, empty or short text loses nothing (kept_text is its words joined by single spaces,
    empty for null). Repeated rows repeat each other's windows. An empty table gives no rows. Columns of
    docs that have the names of new ones are replaced.
    """
    if not window - _MOST < gram <= window or gram < 1:
        raise ValueError(f"gram must lie in window - {_MOST - 1} .. window")
    names = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed", "removed")]
    rid, whole, shared, marked = private([*names, "kept_text", "n_words", "n_removed", "removed"], "rid", "whole", "shared", "marks")
    kept = docs.select(*named(*names))
    rows = kept.withColumns({rid: F.xxhash64("doc_id", "text"), whole: F.coalesce("text", F.lit(""))})
    buckets = max(LEAST_BUCKETS, docs.count() // ROWS_TOGETHER)
    anchors = rows.select(rid, whole).mapInArrow(_anchors(window, gram, rid, whole), "h long, rid long, at long, times long")
    often = anchors.groupBy("h").agg(F.sum("times").alias("c")).where("c > 1")
    seeds = anchors.join(often, "h").groupBy(F.col("rid").alias(rid)).agg(F.collect_set(F.struct("h", "at", "c")).alias(shared))
    # rows keep all their columns here so that they are shuffled once, for this join and the last
    asked = rows.join(seeds, rid).mapInArrow(_requests(window, buckets, hot_above, rid, whole, shared), "bucket int, h long, rid long, at long, windows array<long>").repartition("bucket")
    cold = asked.groupBy("bucket").applyInArrow(_repeated, "rid long, at long, mask long")
    # hot anchors: each distinct list of windows is counted once, as often as it occurs
    hot = asked.select(F.explode_outer(F.when(F.col("bucket") < 0, F.array(F.struct("h", "rid", "at", "windows")))).alias("x")).where("x is not null").select("x.*")
    hot = hot.withColumn("key", F.xxhash64("windows"))
    lists = hot.groupBy("h", "key").agg(F.first("windows").alias("windows"), F.count(F.lit(1)).alias("c")).select("h", "key", "c", F.posexplode("windows").alias("i", "w"))
    twice = lists.groupBy("h", "w").agg(F.sum("c").alias("c")).where("c > 1").select("h", "w")
    masks = lists.join(twice, ["h", "w"]).groupBy("h", "key").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    marks = cold.unionByName(hot.select("h", "rid", "at", "key").join(masks, ["h", "key"]).drop("h", "key")).groupBy(F.col("rid").alias(rid)).agg(F.collect_set(F.struct("at", "mask")).alias(marked))
    new = docs.sparkSession.createDataFrame([], "kept_text string, n_words long, n_removed long, removed array<struct<start:long,end:long>>").schema
    return rows.join(marks, rid, "left").mapInArrow(_removal(window, names, whole, marked), StructType([*kept.schema, *new]))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document when repeated passages of 35 words go."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM s),
d AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM g JOIN d USING (h)),
k AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
q AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS kept FROM p LEFT JOIN c USING (doc_id, j) WHERE c.j IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)
"""
