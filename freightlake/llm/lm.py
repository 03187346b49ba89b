"""Op 6, scores of an interpolated modified Kneser-Ney model of word n-grams.

Spark counts the training words, then the n-grams of neighbouring words, in sorted arrays: each task counts
what it reads, and buckets of a hash range are merged where they meet. Grams that end in the same pair meet in
one bucket, so the distinct words that a shorter gram follows are counted there too. Every bucket is a file of
sorted hash arrays in the shared folder. Workers map these files into memory and look up what a text needs.
A context that was followed once, by one word, is not stored: it is there as a gram, so its counts are known.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, collect_garbage, column, cut, give_back, list_array, mix, shared_dir, steps, table
from .toxicity import fold

#: Bytes of text to a bucket, and the fewest buckets. Bytes of text that are counted together.
BYTES_TOGETHER, LEAST_BUCKETS, COUNT_BYTES = 13 << 20, 64, 4 << 20
#: Words to a gram in the registered query.
ORDER = 3
#: Files that a worker keeps mapped, or in memory if they are in a remote folder.
MAPPED, HELD = 20_000, 64
_END = np.uint64(0x5851F42D4C957F2D)


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array whole or not at all; a second attempt of a task writes the same."""
    system, path = _place(folder)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(part, f"{path}/{name}")


def save_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Several arrays in one file, after a head that tells where each of them is."""
    head, at, parts = {}, 0, []
    for key, x in arrays.items():
        data = np.ascontiguousarray(x).tobytes()
        head[key] = [at, len(x), x.dtype.str, list(x.shape[1:])]
        parts += [data, bytes(-len(data) % 8)]
        at += len(data) + len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    save_array(folder, name, np.frombuffer(b"".join([len(text).to_bytes(8, "little"), text, *parts]), np.uint8))


def map_array(folder: str, name: str, kind: str) -> np.ndarray:
    """An array file, mapped into memory; one of a remote folder is read. A file that is missing is an error, not an empty bucket."""
    return (_mapped if folder.startswith(("file:", "/")) else _held)(folder, name).view(kind)


@lru_cache(maxsize=MAPPED)
def _mapped(folder: str, name: str) -> np.ndarray:
    path = f"{_place(folder)[1]}/{name}"
    return np.memmap(path, dtype=np.uint8, mode="r")


@lru_cache(maxsize=HELD)
def _held(folder: str, name: str) -> np.ndarray:
    system, path = _place(folder)
    with system.open_input_stream(f"{path}/{name}") as source:
        return np.frombuffer(source.readall(), np.uint8)


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of one file, which must be there."""
    return (_heads if folder.startswith(("file:", "/")) else _arrays)(folder, name)


def _arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    data = map_array(folder, name, "u1")
    n = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + n].tobytes())
    return {key: data[8 + n + at : 8 + n + at + count * int(np.prod(shape, dtype=int)) * np.dtype(kind).itemsize].view(kind).reshape(count, *shape) for key, (at, count, kind, shape) in head.items()}


_heads = lru_cache(maxsize=MAPPED)(_arrays)


def keys_of(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted 64-bit keys, kept by their first 40 bits: of some hundred thousand in a bucket, one in millions is taken for another."""
    return {name: (keys >> np.uint64(32)).astype(np.uint32), f"{name}+": (keys >> np.uint64(24)).astype(np.uint8)}


def find(arrays: dict[str, np.ndarray], name: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``wanted`` of the keys that the arrays hold under that name, and where they are there."""
    known = arrays.get(name)
    if known is None or not len(known) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rest, first, more = arrays[f"{name}+"], (wanted >> np.uint64(32)).astype(np.uint32), (wanted >> np.uint64(24)).astype(np.uint8)
    at, todo, found = np.searchsorted(known, first), np.arange(len(wanted)), []
    while len(todo):  # the same 32 bits come twice at most, but for the rarest cases
        todo = todo[at[todo] < len(known)]
        todo = todo[known[at[todo]] == first[todo]]
        hit = rest[at[todo]] == more[todo]
        found.append(todo[hit])
        todo = todo[~hit]
        at[todo] += 1
    hits = np.concatenate(found)
    return hits, at[hits]


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _packed(bucket: np.ndarray, *columns: tuple[np.ndarray, pa.DataType], order: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket with lists of its entries of the columns."""
    order = np.argsort(bucket, kind="stable") if order is None else order
    present, counts = np.unique(bucket, return_counts=True)
    lists = [list_array(x[order], counts, kind) for x, kind in columns]
    return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *lists], names=["bucket", *ascii_lowercase[: len(lists)]])


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].combine_chunks().flatten().to_numpy()


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text's end included, and where the texts begin and end."""
    words = Words(data, offsets, lower=True)
    n = np.diff(words.bounds) + 1
    ends = np.cumsum(n)
    out = np.full(int(ends[-1]) if len(ends) else 0, _END)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = words.hashes()
    return out, np.concatenate([[0], ends])


@dataclass
class Vocabulary:
    """Training tokens: files of sorted hashes and counts, by the top bits of the hash. An id is a place in all of them."""

    folder: str
    bits: int
    begins: np.ndarray  # of each file's ids
    total: int

    @property
    def size(self) -> int:
        return int(self.begins[-1])

    @property
    def kind(self) -> str:
        """Numbers that no count of training tokens exceeds."""
        return "u4" if self.total < 1 << 32 else "u8"

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each of some sorted hashes; id -1 and count 0 where it is unknown."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for b, (i, j) in _runs((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            if self.begins[b] == self.begins[b + 1]:  # no file was written
                continue
            arrays = map_arrays(self.folder, f"words-{b}")
            known = arrays["hash"]
            at = np.searchsorted(known, hashes[i:j])
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes[i:j])
            ids[i + hit] = at[hit] + self.begins[b]
            counts[i + hit] = arrays["count"][at[hit]]
        return ids, counts

    def encode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, inverse = np.unique(tokens, return_inverse=True)
        ids, counts = self.look_up(distinct)
        return ids[inverse], counts[inverse]


def count_words(texts: DataFrame, folder: str, n_buckets: int) -> Vocabulary:
    bits = max(1, (n_buckets - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches, step_bytes=COUNT_BYTES):
            distinct, counts = np.unique(tokens_of(data, offsets)[0], return_counts=True)
            bucket = (distinct >> np.uint64(64 - bits)).astype(np.int32)
            yield _packed(bucket, (distinct.view(np.int64), pa.int64()), (counts, pa.int64()), order=np.arange(len(bucket)))

    def merge(rows: pa.Table) -> pa.Table:
        b = rows["bucket"][0].as_py()
        hashes, counts = _merged(_flat(rows, "a").view(np.uint64), _flat(rows, "b"))
        save_arrays(folder, f"words-{b}", {"hash": hashes, "count": counts})
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": [len(hashes)], "total": [int(counts.sum())]})

    packed = texts.mapInArrow(count, "bucket int, a array<long>, b array<long>")
    rows = packed.groupBy("bucket").applyInArrow(merge, "bucket int, n long, total long").collect()  # a row for each file
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r["bucket"]] = r["n"]
    return Vocabulary(folder, bits, np.concatenate([[0], np.cumsum(sizes)]), sum(r["total"] for r in rows))


def discounts(n: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose, from how many counts are 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [0.0]
    for k in (1, 2, 3):
        d.append(float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05, k - 0.05)) if n[k - 1] and n[k] else 0.5 * k)
    return np.array(d)


@dataclass
class GramModel:
    """Counts of word n-grams of 2 to ``order`` words by bucket, statistics of their contexts, and of last words by ranges of ids.

    Grams of the highest order are counted as they occur, shorter ones by how many distinct words they follow.
    """

    vocabulary: Vocabulary
    folder: str
    order: int
    buckets: int
    hot_above: int
    range_size: int
    gram_discounts: dict[int, np.ndarray]  # by number of words
    word_discounts: np.ndarray
    pairs: int
    rest: float  # weight of the uniform distribution
    written: dict[str, np.ndarray]  # which buckets have a file: a byte for each

    def arrays(self, kind: str, b: int) -> dict[str, np.ndarray]:
        """The arrays of a bucket: none if nothing fell into it."""
        return map_arrays(self.folder, f"{kind}-{b}") if self.written[kind][b] else {}

    def _contexts(self, k: int, keys: np.ndarray, v: np.ndarray, count: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Statistics of distinct contexts of k - 1 words, v their last, that are there: total, and next words seen 1, 2, 3 or more times."""
        out = np.zeros((len(keys), 4), np.int64)
        out[there] = (1, 1, 0, 0)  # what is there and not stored was followed once
        hot = count > self.hot_above
        for b, rows in _groups(np.where(there & hot, _spread(keys, self.buckets), -1)):
            if b >= 0:
                arrays = self.arrays(f"hot-{k}", b)
                hit, at = find(arrays, "key", keys[rows])
                out[rows[hit]] = arrays["stats"][at] if len(hit) else 0
        for b, rows in _groups(np.where(there & ~hot, bucket_of(v, v, np.zeros_like(count), self.buckets, self.hot_above), -1)):
            if b >= 0:
                arrays = self.arrays("grams", b)
                for name in (f"few{k}", f"some{k}"):
                    hit, at = find(arrays, name, keys[rows])
                    out[rows[hit]] = arrays[f"{name}-stats"][at] if len(hit) else 0
        return out

    def _times(self, k: int, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The count of each distinct gram of k words; keys are sorted."""
        out = np.zeros(len(keys), np.int64)
        for b, rows in _groups(bucket):
            if b >= 0:
                arrays = self.arrays("grams", b)
                out[rows[find(arrays, f"once{k}", keys[rows])[0]]] = 1
                for name in (f"more{k}", f"many{k}"):
                    hit, at = find(arrays, name, keys[rows])
                    out[rows[hit]] = arrays[f"{name}-times"][at] if len(hit) else 0
        return out

    def _words(self, w: np.ndarray) -> np.ndarray:
        """Probability of distinct words by how many first words they follow."""
        follows = np.zeros(len(w), np.int64)
        for b, rows in _groups(np.where(w < 0, -1, w // self.range_size)):
            if b >= 0 and self.written["second"][b]:
                follows[rows] = map_array(self.folder, f"second-{b}", "i8")[w[rows] - b * self.range_size]
        return (follows - self.word_discounts[np.minimum(follows, 3)]) / max(self.pairs, 1) + self.rest / (self.vocabulary.size + 1)

    def log10(self, grams: list[np.ndarray], count_v: np.ndarray, count: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of each last word after those before it, by ids; -1 is unknown, and the size of the vocabulary the begin. begins: where texts begin."""
        v, w = grams[-2:]
        words, at_w = np.unique(w, return_inverse=True)
        p = self._words(words)[at_w]
        seen = count > 0  # the gram of one word less that ends here
        for k in range(2, self.order + 1):
            some, lost = grams[-k:], self.gram_discounts[k]
            there = np.append(False, seen[:-1])  # what stands before a word is the gram that ends in the word before
            there[begins] = self.pairs > 0
            contexts, index, at = np.unique(_key(some[:-1]), return_index=True, return_inverse=True)
            first = self._contexts(k, contexts, v[index], count_v[index], there[index])[at]
            keys, index, at = np.unique(_key(some), return_index=True, return_inverse=True)
            known = there[index] & (w[index] >= 0)
            times = self._times(k, keys, np.where(known, bucket_of(v[index], w[index], count_v[index], self.buckets, self.hot_above), -1))[at]
            total = np.maximum(first[:, 0], 1)
            given = (times - lost[np.minimum(times, 3)]) / total + first[:, 1:] @ lost[1:] / total * p
            p = np.where(first[:, 0] > 0, given, p)
            seen = times > 0
        return np.log10(p)


def _key(ids: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the words' ids."""
    key = (ids[0] + 1).astype(np.uint64)
    for x in ids[1:]:
        key = mix(key) + (x + 1).astype(np.uint64)
    return mix(key)


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % np.uint64(buckets)).astype(np.int64)


def bucket_of(v: np.ndarray, w: np.ndarray, count: np.ndarray, buckets: int, hot_above: int) -> np.ndarray:
    """The bucket of a gram that ends in v, w: by v, or by both words where v is frequent.

    So a gram and all that it ends in, down to the pair, share a bucket, and what a shorter gram follows is counted there.
    """
    h = mix(v.astype(np.uint64) + np.uint64(7))
    return (np.where(count > hot_above, mix(h + w.astype(np.uint64)), h) % np.uint64(buckets)).astype(np.int64)


def _runs(files: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
    """(file, (begin, end)) of each run of equal numbers; files that none asks for cost nothing."""
    ends = [*np.flatnonzero(files[1:] != files[:-1]) + 1, len(files)] if len(files) else []
    for begin, end in zip([0, *ends], ends):  # noqa: B905
        yield int(files[begin]), (begin, end)


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    for b, rows in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        yield b, rows


def _grams(vocabulary: Vocabulary, tokens: np.ndarray, bounds: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(ids of each word and those before it, count of the word before, count of the word); before a text is an id of its own, and its count is that of all tokens."""
    w, count = vocabulary.encode(tokens)
    place = np.arange(len(w)) - np.repeat(bounds[:-1], np.diff(bounds))
    grams = [w]
    for k in range(1, order):
        inside = np.flatnonzero(place >= k)
        before = np.full(len(w), vocabulary.size, np.int64)
        before[inside] = w[inside - k]
        grams.insert(0, before)
    count_v = np.full(len(w), vocabulary.total, np.int64)  # as frequent as can be: always dealt by both words
    inside = np.flatnonzero(place >= 1)
    count_v[inside] = count[inside - 1]
    return grams, count_v, count


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of grams by their last pair, then by the words before it, nearest first; and where distinct ones begin in it."""
    order = np.lexsort([*grams[:-2], grams[-1], grams[-2]])
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in grams], axis=0)
    return order, np.flatnonzero(new)


def fit(texts: DataFrame, order: int = 2) -> GramModel:
    """Count texts and write the model's arrays to the shared folder."""
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = texts.sparkSession
    folder = f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    buckets = max(LEAST_BUCKETS, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_TOGETHER)
    vocabulary = count_words(texts, folder, buckets)
    collect_garbage(spark)
    hot_above = max(1000, vocabulary.total // buckets)
    range_size = max(1, -(-vocabulary.size // buckets))
    lists = ascii_lowercase[: order + 1]  # of a gram's words, then of counts
    wide = vocabulary.size >= (1 << 31) - 1
    kind, sql = (np.int64, "long") if wide else (np.int32, "int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches, step_bytes=COUNT_BYTES):
            grams, count_v, _ = _grams(vocabulary, *tokens_of(data, offsets), order)
            at, first = _distinct(grams)
            times = np.diff(np.append(first, len(at))).astype(np.int32)
            grams, count_v = [x[at[first]] for x in grams], count_v[at[first]]
            bucket = bucket_of(*grams[-2:], count_v, buckets, hot_above)
            yield _packed(bucket, *((x.astype(kind), pa.from_numpy_dtype(kind)) for x in grams), (times, pa.int32()))

    def merge(rows: pa.Table) -> pa.Table:
        b = rows["bucket"][0].as_py()
        grams = [_flat(rows, c).astype(np.int64) for c in lists[:-1]]
        at, first = _distinct(grams)
        times = np.add.reduceat(_flat(rows, lists[-1]).astype(np.int64)[at], first)
        grams, out, arrays = [x[at[first]] for x in grams], [], {}
        for k in range(order, 1, -1):
            if k < order:  # what a shorter gram follows: it is sorted by its last words, each of the longer ones a row
                grams = grams[1:]
                new = np.ones(len(times), bool)
                new[1:] = np.any([x[1:] != x[:-1] for x in grams], axis=0)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(times)))
                grams = [x[first] for x in grams]
            out.append((0, k, np.array([(times == n).sum() for n in (1, 2, 3, 4)]), np.zeros(0, np.int64)))
            keys = _key(grams)
            by = np.argsort(keys)
            keys, sorted_times = keys[by], times[by]
            more, many = (sorted_times > 1) & (sorted_times < 256), sorted_times > 255
            arrays |= keys_of(f"once{k}", keys[sorted_times == 1]) | keys_of(f"more{k}", keys[more]) | keys_of(f"many{k}", keys[many])
            arrays |= {f"more{k}-times": sorted_times[more].astype(np.uint8), f"many{k}-times": sorted_times[many].astype(vocabulary.kind)}
            keys = _key(grams[:-1])
            by = np.argsort(keys, kind="stable")
            keys, sorted_times = keys[by], times[by]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            stats = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (sorted_times, sorted_times == 1, sorted_times == 2, sorted_times > 2)], 1)
            last, keys = grams[-2][by[first]], keys[first]
            some, at = np.unique(last, return_inverse=True)
            hot = (vocabulary_counts(vocabulary, some) > hot_above)[at]  # dealt by both words: these are parts of its statistics
            few, some = ~hot & (stats[:, 0] > 1) & (stats[:, 0] < 256), ~hot & (stats[:, 0] > 255)
            arrays |= keys_of(f"few{k}", keys[few]) | keys_of(f"some{k}", keys[some])
            arrays |= {f"few{k}-stats": stats[few].astype(np.uint8), f"some{k}-stats": stats[some].astype(vocabulary.kind)}
            out += [(k, c, keys[hot][part].view(np.int64), stats[hot][part].ravel()) for c, part in _groups(_spread(keys[hot], buckets))] if hot.any() else []
        save_arrays(folder, f"grams-{b}", arrays)
        give_back()
        seconds, follows = np.unique(grams[-1], return_counts=True)  # of pairs
        out += [(1, r, seconds[part], follows[part]) for r, part in _groups(seconds // range_size)]
        out.append((-1, b, np.zeros(0, np.int64), np.zeros(0, np.int64)))
        kind, key, a, b = zip(*out, strict=True)
        return pa.table({"kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int64()), "a": pa.array(a, pa.list_(pa.int64())), "b": pa.array(b, pa.list_(pa.int64()))})

    packed = texts.mapInArrow(count, f"bucket int, {', '.join(f'{c} array<{sql}>' for c in lists[:-1])}, {lists[-1]} array<int>")
    found = cut(packed.groupBy("bucket").applyInArrow(merge, "kind int, key long, a array<long>, b array<long>"), "gram-stats", release=True)

    def add_up(rows: pa.Table) -> pa.Table:
        kind, r = rows["kind"][0].as_py(), rows["key"][0].as_py()
        a, b, n = _flat(rows, "a"), _flat(rows, "b"), [0] * 6
        if kind == 1:
            follows = np.zeros(range_size, np.int64)
            np.add.at(follows, a - r * range_size, b)
            save_array(folder, f"second-{r}", follows)
            n = [int((follows == k).sum()) for k in (1, 2, 3, 4)] + [int((follows > 2).sum()), int(follows.sum())]
        else:
            keys, at = np.unique(a.view(np.uint64), return_inverse=True)
            stats = np.zeros((len(keys), 4), np.int64)
            np.add.at(stats, at, b.reshape(-1, 4))
            save_arrays(folder, f"hot-{kind}-{r}", keys_of("key", keys) | {"stats": stats.astype(vocabulary.kind)})
        return pa.table({"kind": pa.array([kind], pa.int32()), "key": [r], "n": pa.array([n], pa.list_(pa.int64()))})

    ranges = cut(found.where("kind > 0").groupBy("kind", "key").applyInArrow(add_up, "kind int, key long, n array<long>"), "gram-ranges")
    n_ranges = -(-vocabulary.size // range_size)
    written = {"grams": np.zeros(buckets, bool), "second": np.zeros(n_ranges, bool)} | {f"hot-{k}": np.zeros(buckets, bool) for k in range(2, order + 1)}
    for r in found.where("kind = -1").select("kind", "key").unionByName(ranges.select("kind", "key")).distinct().toLocalIterator():
        written[{-1: "grams", 1: "second"}.get(r["kind"], f"hot-{r['kind']}")][r["key"]] = True
    n = np.array([x or 0 for x in ranges.agg(*[F.sum(F.element_at("n", k + 1)).alias(f"n{k}") for k in range(6)]).first()])
    word_d = discounts(n[:4])
    pairs = int(n[5])
    rest = float(word_d[1:] @ np.array([n[0], n[1], n[4]])) / pairs if pairs else 1.0
    of_counts = found.where("kind = 0").groupBy("key").agg(*[F.sum(F.element_at("a", k)).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()  # a row for each order
    of_counts = {r["key"]: np.array(r[1:]) for r in of_counts}
    gram_d = {k: discounts(of_counts.get(k, np.zeros(4, np.int64))) for k in range(2, order + 1)}
    return GramModel(vocabulary, folder, order, buckets, hot_above, range_size, gram_d, word_d, pairs, rest, written)


def vocabulary_counts(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Training counts of sorted ids; that of the begin of a text is as frequent as can be."""
    out = np.full(len(ids), vocabulary.total, np.int64)
    ids_known = ids[ids < vocabulary.size]
    for b, (i, j) in _runs(np.searchsorted(vocabulary.begins, ids_known, "right") - 1):
        out[i:j] = map_arrays(vocabulary.folder, f"words-{b}")["count"][ids_known[i:j] - vocabulary.begins[b]]
    return out


def score_texts(docs: DataFrame, model: GramModel) -> DataFrame:
    """docs (doc_id, held_out, text) with n_tokens, n_known, train_tokens, base_score and score."""
    vocabulary = model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10(float(vocabulary.total) + vocabulary.size + 1)
        for batch, data, offsets in steps(batches):
            tokens, bounds = tokens_of(data, offsets)
            grams, count_v, count = _grams(vocabulary, tokens, bounds, model.order)
            add = lambda x, at=bounds[:-1]: np.add.reduceat(x, at)  # noqa: E731  every text has its end
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(np.diff(bounds), pa.int64()), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(batch.num_rows, vocabulary.total)), pa.array(add(np.log10(count + 1.0) - base)), pa.array(add(model.log10(grams, count_v, count, bounds[:-1])))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scores(spark: SparkSession, sf_dir: str, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out.

    A null or empty text is its end alone. A null id is not held out. Repeated rows count and return as often
    as they are there. Without training rows the model is uniform over nothing: every token has probability 1.
    An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out"), "text")
    model = fit(docs.where(~F.col("held_out")).select("text"), order)
    return score_texts(docs, model)
