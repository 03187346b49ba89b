"""Op 11, spelling variants: words one edit apart, and the frequent form of each.

Where two words of lengths n and n or n - 1 differ by one edit, at most one place of the longer is outside their
common prefix and suffix. So that place is cut into spans, and words that agree before and behind a span are met
there; a span that gathers many words is halved until few are left or it is one place. The words of a span are
compared densely: tiles of padded code-point matrices, whose common prefix plus suffix must reach the longer length
minus one. Of the places that fit a pair the last one counts, so each pair is found once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTES_SQL, CRC32_SQL, STEP_BYTES, column, cut, give_back, ragged, steps, table

#: Code points and occurrences that make a word; one run in so many loses a letter.
LEAST_LENGTH, LEAST_COUNT, DAMAGE = 5, 3, 97
#: Rows of a tile and cells of its matrix; words that a span may gather before it is halved; rows of a bucket.
TILE, TILE_CELLS, SPAN_WORDS, ROWS_TOGETHER = 256, 1 << 18, 1024, 60_000
#: How often the rows of a form's largest neighbour must exceed a word's own.
FORM_RATIO = 2
#: Runs of more bytes have their checksums taken one by one.
LONG_RUN = 64

_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), _LEAD]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC_TABLE = np.where(_CRC_TABLE & 1, (_CRC_TABLE >> 1) ^ np.uint32(0xEDB88320), _CRC_TABLE >> 1)


def _stretches(letter: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of about ``size`` bytes that cut no run of letters."""
    at = 0
    while at < len(letter):
        to = min(at + size, len(letter))
        if to < len(letter):
            back = int(letter[at:to][::-1].argmin())
            if letter[to - 1 - back]:  # letters all along
                on = int(letter[to:].argmin())
                to = len(letter) if letter[to + on] else to + on
            else:
                to -= back
        yield at, to
        at = to


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end], each going on from the checksum of what stands before it."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, LONG_RUN + 1), kind="stable")
    n_long = int(np.count_nonzero(lengths > LONG_RUN))
    short, out = order[n_long:], np.empty(len(starts), dtype=np.uint32)
    crc, at, left = states[short] ^ np.uint32(0xFFFFFFFF), starts[short], lengths[short]
    for k in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -k, "left"))  # those longer than k come first
        crc[:m] = _CRC_TABLE[(crc[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (crc[:m] >> np.uint32(8))
    out[short] = crc ^ np.uint32(0xFFFFFFFF)
    for i in order[:n_long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(states[i]))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each step's texts."""
    for batch, data, offsets in steps(batches):
        letter = _LETTER[data]
        letter[1:] |= data[:-1] == _LEAD
        ids = ["" if x is None else str(x) for x in column(batch, "doc_id").to_pylist()]
        before = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], dtype=np.uint32)
        lower = _LOWER[data]
        for a, b in _stretches(letter, 4 * STEP_BYTES):
            here = letter[a:b]
            first, last = here.copy(), here.copy()
            first[1:] &= ~here[:-1]
            last[:-1] &= ~here[1:]
            heads = offsets[(offsets > a) & (offsets < b)] - a  # a text that begins inside a stretch begins a run
            first[heads] = here[heads]
            last[heads - 1] = here[heads - 1]
            starts, ends = np.flatnonzero(first) + a, np.flatnonzero(last) + a + 1
            inner = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) == 0x80)])
            points = (ends - starts) - (inner[ends - a] - inner[starts - a])
            keep = points >= LEAST_LENGTH
            starts, ends, points = starts[keep], ends[keep], points[keep]
            if not len(starts):
                continue
            h = checksums(lower, starts, ends, before[np.searchsorted(offsets, starts, "right") - 1])
            hit = h % DAMAGE == 0
            damaged = []
            for i in np.flatnonzero(hit & (points > LEAST_LENGTH)):
                run, at = lower[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(points[i])
                damaged.append(run[:at] + run[at + 1 :])
            starts, ends = starts[~hit], ends[~hit]
            places = np.zeros(len(starts) + 1, dtype=np.int64)
            np.cumsum(ends - starts, out=places[1:])
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(lower[ragged(starts, ends - starts)]))
            found = pa.chunked_array([words, pa.array(damaged, pa.large_string())]).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of every (doc_id, text): runs of letters, one in DAMAGE without a letter, by the checksum of id and run.

    Null texts have none; a null doc_id is written as nothing. Texts of any length are counted in steps.
    """
    counts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the hash of what a word has before and behind its span; only words of one class and span can have the same."""
    behind = F.col("m") - 1 - F.col("hi")
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", F.left("word", F.col("lo")), F.right("word", behind)))


def spans(words: DataFrame, span_words: int = SPAN_WORDS) -> DataFrame:
    """(word, n, m, lo, hi, key): each word in the spans of the classes of its own length and of the next.

    Class m holds the pairs whose longer word has m code points.
    """
    at = F.char_length("word")

    def halves(m: Column, lo: Column, hi: Column) -> list[Column]:
        mid = F.floor((lo + hi) / 2).cast("int")
        return [F.struct(m.alias("m"), lo.cast("int").alias("lo"), mid.alias("hi")), F.struct(m.alias("m"), (mid + 1).alias("lo"), hi.cast("int").alias("hi"))]

    both = [s for m in (at, at + 1) for s in halves(m, F.lit(0), m - 1)]
    now, ended = cut(_keyed(words.where(at > 0).select("word", "n", F.inline(F.array(*both)))), "spans"), []
    while True:
        hot = now.where("hi > lo").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > span_words).select("key")
        hot = cut(hot, "hot")
        if hot.isEmpty():
            ended.append(now)
            break
        ended.append(now.join(hot, "key", "left_anti"))
        split = now.join(hot, "key", "left_semi").select("word", "n", F.inline(F.array(*halves(F.col("m"), F.col("lo"), F.col("hi")))))
        now = cut(_keyed(split), "spans")
    out = ended[0].select("word", "n", "m", "lo", "hi", "key")
    for part in ended[1:]:
        out = out.unionByName(part.select(*out.columns))
    return out


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many code points every row of a shares with every row of b at the front; the two are padded by different values."""
    alike, out = np.ones((len(a), len(b)), dtype=bool), np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(min(a.shape[1], b.shape[1])):
        alike &= a[:, k, None] == b[None, :, k]
        if not alike.any():
            break
        out += alike
    return out


def matrices(words: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded on the right, and from their ends, padded likewise."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows, at = np.repeat(np.arange(len(words)), lengths), ragged(np.zeros(len(words), dtype=np.int64), lengths)
    left = np.full((len(words), int(lengths.max(initial=0))), 0x110000 + pad, dtype=np.uint32)
    right = left.copy()
    left[rows, at] = points
    right[rows, np.repeat(lengths, lengths) - 1 - at] = points
    return left, right


def _blocks(words: list[str]) -> list[tuple[int, int]]:
    """Stretches of TILE words, of fewer where they are long."""
    out, at, widest = [], 0, 0
    for i, w in enumerate(words):
        widest = max(widest, len(w))
        if i > at and (i - at >= TILE or (i - at + 1) * widest > TILE_CELLS):
            out.append((at, i))
            at, widest = i, len(w)
    return out + [(at, len(words))] if words else out


def near_pairs(words: list[str], keys: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the words one edit apart whose last place that fits is in their common span; rows are in order of key."""
    lengths, blocks, found = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), _blocks(words), []
    code = np.stack([m, lo, hi], axis=1)
    for x, (a, b) in enumerate(blocks):
        left, right = matrices(words[a:b], 0)
        for y in range(x, len(blocks)):
            c, d = blocks[y]
            if y > x and keys[c] != keys[b - 1]:
                break
            other_left, other_right = matrices(words[c:d], 1)
            may = (keys[a:b, None] == keys[None, c:d]) & (code[a:b, None] == code[None, c:d]).all(axis=2)
            may &= np.maximum(lengths[a:b, None], lengths[None, c:d]) == m[a:b, None]
            if x == y:
                may = np.triu(may, 1)
            if not may.any():
                continue
            prefix = common_prefixes(left, other_left)
            near = may & (prefix >= lo[a:b, None]) & (prefix <= hi[a:b, None])
            near &= prefix + common_prefixes(right, other_right) >= m[a:b, None] - 1
            i, j = np.nonzero(near)
            found.append((i + a, j + c))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([f[k] for f in found] or [none]) for k in (0, 1))


def _met(group: pa.Table) -> pa.Table:
    """(word, n_near, near_n, near): of a bucket's words, how many near ones it holds and the most frequent of them."""
    keys = group["key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    group = group.take(pa.array(order))
    words, n = group["word"].to_pylist(), group["n"].to_numpy()
    i, j = near_pairs(words, keys[order], *[group[c].to_numpy() for c in ("m", "lo", "hi")])
    rank = np.empty(len(words), dtype=np.int64)  # Python orders text by code points
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    word, near = np.concatenate([i, j]), np.concatenate([j, i])
    # a word has a row in each of its spans: its name's first place stands for all
    firsts: dict[str, int] = {}
    name = np.fromiter((firsts.setdefault(w, k) for k, w in enumerate(words)), dtype=np.int64, count=len(words))
    word = name[word]
    at = np.lexsort((rank[near], -n[near], word))
    word, near = word[at], near[at]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, dtype=np.int64)
    texts = group["word"]
    out = pa.table({"word": texts.take(pa.array(word[starts])), "n_near": np.diff(np.append(starts, len(word))), "near_n": n[near[starts]], "near": texts.take(pa.array(near[starts]))})
    del group, words, firsts
    give_back()
    return out


def group_variants(words: DataFrame, span_words: int = SPAN_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words with their counts; other columns are not read.

    A null or empty word is near none; one without a near word has neither form nor another root.
    """
    words = words.select("word", "n")
    met = cut(spans(words, span_words), "met")
    buckets = max(1, math.ceil(met.count() / ROWS_TOGETHER))
    pairs = met.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(_met, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")  # the most frequent, of equal ones the first
    near = cut(pairs, "near", release=True).groupBy(F.col("word").alias("of")).agg(F.sum("n_near").alias("n_near"), best)
    rows = words.join(near, F.col("word") == F.col("of"), "left")
    larger = -F.col("best.less") >= FORM_RATIO * F.col("n")
    formed = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(larger, F.col("best.near")).alias("form"), F.when(larger, -F.col("best.less")).cast("long").alias("form_n")), "formed")
    ends = formed.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:  # doubles the distance: counts double with every form, so few rounds reach all roots
        ends = cut(ends, "roots")
        if ends.where("moved").isEmpty():
            break
        there = ends.select(F.col("word").alias("at"), F.col("root").alias("to"))
        ends = ends.join(there, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
    known = ends.select(F.col("word").alias("at"), "root")
    return formed.join(known, F.col("word") == F.col("at"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all ``documents`` with the frequent form that each is a variant of.

    Null and empty texts have no words, and rows that repeat count each time.
    """
    words = cut(count_words(table(spark, sf_dir, "documents")), "words", release=True)
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = f"""WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (SELECT run, c, {CRC32_SQL.format(BYTES_SQL.format("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)"))} AS h FROM runs
), words AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING sum(c) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}
), less AS (SELECT word, n, i, left(word, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest FROM words, range(1, length(word) + 1) r(i)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.rest = w.word
), best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FORM_RATIO} * n THEN near END AS form, CASE WHEN near_n >= {FORM_RATIO} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (SELECT word, word AS root, 0 AS steps FROM formed UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""
