"""Op 5, packing token sequences by minimum bin slack.

Every document is encoded once; whole windows are cut off and what remains is packed. Remainders are
dealt evenly into buckets; in each, a window takes the largest length left and the multiset of other
lengths that fills it closest to capacity, found by a bitset subset-sum programme over the lengths'
counts and backtracked. A filling is repeated as often as the counts allow.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, column, cut, give_back, ragged, steps, table

CAPACITY = 2048
#: Documents to a bucket of remainders.
ROWS_TOGETHER = 1500
#: Distinct words that one call encodes, in a row.
WORDS_TOGETHER = 4096
#: Words whose token ids a Python worker keeps, for all its tasks, and their ids.
CACHED_WORDS = 1_000_000
CACHED_IDS = 8_000_000
#: Bytes of text that are encoded together.
ENCODE_BYTES = 1 << 19


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum within capacity: {length: times}.

    ``reach`` has bit s where some multiset of the lengths so far sums to s.
    """
    lengths = sorted((n for n in counts if n <= capacity and counts[n]), reverse=True)
    mask, reach, before = (1 << capacity + 1) - 1, 1, []
    for n in lengths:
        before.append(reach)
        left, step = min(counts[n], capacity // n), 1
        while left > 0:  # binary splitting of the count
            step = min(step, left)
            reach |= reach << (n * step) & mask
            left, step = left - step, step * 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for n, earlier in zip(reversed(lengths[: len(before)]), reversed(before), strict=True):
        times = 0
        while not earlier >> total & 1:
            total, times = total - n, times + 1
        if times:
            chosen[n] = times
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, until no length is left."""
    left, plan = {n: c for n, c in counts.items() if c}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        chosen = fill(left, capacity - largest)
        left[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(left[n] // t for n, t in chosen.items())
        plan.append((chosen, times))
        for n, t in chosen.items():
            left[n] -= t * times
            if not left[n]:
                del left[n]
    return plan


def pack_bucket(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each length, counted from 0, and its offset there."""
    order = np.argsort(lengths, kind="stable")
    values, begins, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    next_of = dict(zip(values.tolist(), begins.tolist(), strict=True))
    window, offset, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for chosen, times in minimum_bin_slack(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity):
        for _ in range(times):
            filled = 0
            for n, t in sorted(chosen.items(), reverse=True):
                for _ in range(t):
                    row = order[next_of[n]]
                    next_of[n] += 1
                    window[row], offset[row] = at, filled
                    filled += n
            at += 1
    return window, offset


class WordEncoder:
    """Token ids of many texts, each distinct word encoded once.

    The tokenizer must split at ASCII white space first and drop it, as ``word_bpe_49k`` does: then a text's
    ids are its words' ids in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.begins, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _new(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        new = self.known[at] != hashes
        self.again[at[~new]] = True
        return new

    def _forget(self) -> None:
        """Make room: only words that came again since the last time stay, if these leave half of it; most words come once."""
        kept = self.again
        if 2 * np.count_nonzero(kept) > CACHED_WORDS or 2 * int(self.counts[kept].sum()) > CACHED_IDS:
            kept = np.zeros(len(kept), bool)
        self.flat = self.flat[ragged(self.begins[kept], self.counts[kept])]
        self.known, self.counts = self.known[kept], self.counts[kept]
        self.begins, self.again = np.cumsum(self.counts, dtype=np.int64) - self.counts, np.zeros(len(self.known), bool)

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        counts, flat = [np.zeros(0, np.int64)], []
        for i in range(0, len(words), WORDS_TOGETHER):
            some = words[i : i + WORDS_TOGETHER]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            first = np.cumsum([0] + [len(w) + 1 for w in some])
            at = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            counts.append(np.bincount(np.searchsorted(first, at, "right") - 1, minlength=len(some)))
            flat += got.ids
        counts = np.concatenate(counts)
        begins = np.cumsum(counts) - counts + len(self.flat)
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
        place = np.searchsorted(self.known, hashes)  # hashes are sorted
        self.known, self.begins, self.counts, self.again = (np.insert(old, place, new) for old, new in ((self.known, hashes), (self.begins, begins), (self.counts, counts), (self.again, False)))

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        new = self._new(distinct)
        if len(self.known) + np.count_nonzero(new) > CACHED_WORDS or len(self.flat) > CACHED_IDS:
            self._forget()
            new = self._new(distinct)
        if new.any():
            data = words.data.tobytes()
            spell = [data[words.starts[i] : words.ends[i]].decode("utf-8", "replace") for i in first[new]]
            self._learn(spell, distinct[new])
        at = np.searchsorted(self.known, distinct)
        counts = self.counts[at][inverse]
        ends = np.cumsum(counts)
        places = np.repeat(self.begins[at][inverse] - (ends - counts), counts) + np.arange(ends[-1])
        return self.flat[places].astype("<u4", copy=False), counts


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, buckets: int) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, bucket): whole windows have bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = encoder_of(tokenizer), None
        for batch, data, offsets in steps(batches, step_bytes=ENCODE_BYTES):
            words = Words(data, offsets)
            ids, counts = encoder.encode(words)
            ends = np.concatenate([[0], np.cumsum(counts)])[words.bounds]
            out: list[tuple] = []
            for i, doc_id in enumerate(column(batch, "doc_id").to_pylist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                if turn is None:
                    turn = zlib.crc32(own) % buckets
                for start in range(0, len(own), capacity):
                    part = own[start : start + capacity]
                    turn = (turn + 1) % buckets
                    out.append((doc_id, start, len(part), part.tobytes(), len(own), -1 if len(part) == capacity else turn))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, rows_together: int = ROWS_TOGETHER) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, start, length, ids (its token ids, each as four bytes, the lowest first),
    doc_tokens, sequence_id, offset. A sequence is its pieces' ids by offset. A document is its text's ids and
    ``end_id``; a null or blank text is the end alone. It is cut only at multiples of the
    capacity. Repeated rows and null ids are packed as any other; an empty table gives no rows.
    Remainders are dealt to buckets in turn, so a bucket is as large whatever ids or lengths repeat.
    """
    n_buckets = max(1, math.ceil(docs.count() / rows_together))
    cut_up = cut(pieces(docs, tokenizer, capacity, end_id, n_buckets), "pieces")
    whole = cut_up.where("bucket < 0").withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")}).drop("bucket")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], kind="stable", ignore_index=True)
        window, offset = pack_bucket(rows["length"].to_numpy(), capacity)
        give_back()
        return rows.assign(sequence_id=2 * (window * n_buckets + rows["bucket"]), offset=offset).drop(columns="bucket")

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return whole.unionByName(cut_up.where("bucket >= 0").groupBy("bucket").applyInPandas(packed, schema))


def op5_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """All documents in sequences of 2048 tokens: their pieces, with ids and the checksums of the ids."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents") if docs is None else docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids"))
