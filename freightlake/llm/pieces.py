"""Op 3, SentencePiece encoding and decoding on a relational lattice.

Texts are split where no piece can reach across, and each distinct part (a word with its leading spaces) is
encoded once: its substrings of bounded length meet the piece table and become the edges of the word's lattice.
For unigram models these are DataFrame steps (explode, equi-join, group) and the Viterbi path is folded with
``aggregate``. Byte-pair models do not choose the path of largest score but merge best neighbours first, so
Viterbi gives other ids than the model; for them the merges run over the lattices of many words at once inside
Arrow batches. The words' ids are written as sorted hash arrays that the tasks which put texts together map into
memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import bytes_array, column, list_array, named, private, ragged, shared_dir, span_hashes, steps, table, text_buffers
from .lm import _flat, _place, map_array, save_array

UNIGRAM, BPE = 1, 2
#: Characters that begin and end a word by themselves; no piece may hold them next to others.
BREAKS = "\n\t"
#: What a character without piece costs a unigram path more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of text whose distinct words are found together; of words whose lattices are built together; of all texts to a file of the dictionary.
WORD_BYTES, LATTICE_BYTES, FILE_BYTES = 2 << 20, 1 << 17, 128 << 20
_MARK = "▁"


@dataclass(frozen=True)
class Model:
    """Pieces with spaces for marks, their ids and scores; the id of byte 0, or -1; and the kind of model."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    bytes_from: int
    unknown: int
    kind: int

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


@lru_cache
def read_model(path: str) -> Model:
    """The piece table of a model without normalisation that escapes spaces and adds one in front."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    p, spec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    n = spec.normalizer_spec
    if n.name != "identity" or not n.add_dummy_prefix or n.remove_extra_whitespaces:
        raise ValueError("only models without normalisation are read")
    own = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    pieces = tuple(p.id_to_piece(i).replace(_MARK, " ") for i in own)
    if any(len(x) > 1 and (any(c in x for c in BREAKS) or " " in x.lstrip(" ")) for x in pieces):
        raise ValueError("a piece reaches across words")
    return Model(pieces, tuple(own), tuple(p.get_score(i) for i in own), p.piece_to_id("<0x00>") if p.is_byte(p.piece_to_id("<0x00>")) else -1, p.unk_id(), spec.trainer_spec.model_type)


def prepared(text: Column) -> Column:
    """A text as the model sees it: with a space in front, marks as spaces; empty stays empty."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(" "))
    return F.when(plain == "", plain).otherwise(F.concat(F.lit(" "), plain))


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, edges): every piece in each word as (s, e, cost, id), and single characters without piece with no id."""
    spark = words.sparkSession
    rows = list(zip(model.pieces, model.ids, model.scores, strict=True))  # as many as the model has
    table_of_pieces = F.broadcast(spark.createDataFrame(rows, "piece string, id int, score double"))
    n = F.char_length("word")
    starts = words.select("word", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    spans = starts.select("word", "n", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("i") + 1))).alias("k"))
    found = spans.withColumn("piece", F.substring("word", F.col("i"), F.col("k"))).join(table_of_pieces, "piece", "left").where("id is not null or k = 1")
    edge = F.struct((F.col("i") - 1).alias("s"), (F.col("i") - 1 + F.col("k")).alias("e"), (-F.col("score")).alias("cost"), F.col("id"))
    return found.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))


def _once(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def viterbi_bounds(n: Column, edges: Column, unknown_cost: float) -> Column:
    """The bounds of the pieces on the cheapest path; of equally cheap ones that whose last piece begins first."""
    kind = "array<struct<cost:double,s:int>>"
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("s"))).cast(kind)

    def reach(best: Column, j: Column) -> Column:
        into = F.filter(edges, lambda x: x["e"] == j)
        ways = F.transform(into, lambda x: F.struct((F.element_at(best, x["s"] + 1)["cost"] + F.coalesce(x["cost"], F.lit(unknown_cost))).alias("cost"), x["s"].alias("s")))
        return F.concat(best, F.array(F.array_min(ways))).cast(kind)

    best = F.aggregate(F.sequence(F.lit(1), n), start, reach)

    def back(bounds: Column, _: Column) -> Column:
        first = F.element_at(bounds, 1)
        return F.when(first == 0, bounds).otherwise(F.concat(F.array(F.element_at(best, first + 1)["s"]), bounds))

    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)


class Merges:
    """The lattice and the merges of a byte-pair model, for many words at once.

    Substrings of bounded length meet the pieces by two hashes (128 bits); best neighbours merge first, the leftmost
    where they tie. Short words merge in step with each other, long ones by a heap each.
    """

    LONG, NEVER = 64, np.iinfo(np.int64).max

    def __init__(self, model: Model):
        chars = np.frombuffer("".join(model.pieces).encode("utf-32-le"), np.uint32)
        size = np.array([len(x) for x in model.pieces], np.int64)
        begin = np.cumsum(size) - size
        h = span_hashes(chars, begin, begin + size)
        order = np.argsort(h)
        self.model, self.h, self.second = model, h[order], span_hashes(chars, begin, begin + size, second=True)[order]
        self.ids, self.rank = np.array(model.ids)[order], np.unique(-np.array(model.scores), return_inverse=True)[1][order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[h >> np.uint64(44)] = True

    def lattice(self, chars: np.ndarray, left: np.ndarray) -> np.ndarray:
        """By length less one and place: the piece that these characters spell, or -1. left: characters to the end of the word."""
        out = np.full((self.model.longest, len(chars)), -1, np.int32)
        for k in range(1, self.model.longest + 1):
            p = np.flatnonzero(left >= k)
            h = span_hashes(chars, p, p + k)
            some = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.h, h[some]), len(self.h) - 1)
            hit = self.h[at] == h[some]
            p, at = p[some[hit]], at[hit]
            hit = self.second[at] == span_hashes(chars, p, p + k, second=True)
            out[k - 1, p[hit]] = at[hit]
        return out

    def _ranks(self, found: np.ndarray, p: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
        """What merging each symbol at p with the next costs: its rank, then its place; NEVER if no piece spells both."""
        both = size[p]
        both = np.where(left[p] > both, both + size[np.minimum(p + both, len(size) - 1)], len(found) + 1)
        piece = np.where(both <= len(found), found[np.minimum(both, len(found)) - 1, p], -1)
        return np.where(piece >= 0, self.rank[piece] << np.int64(32) | p, self.NEVER)

    def _together(self, found: np.ndarray, begins: np.ndarray, counts: np.ndarray, size: np.ndarray, left: np.ndarray) -> None:
        """Merge in all these words, one merge each in a step; size gets each symbol's length at its place, 0 elsewhere."""
        before = np.arange(len(size)) - 1
        cost = np.full(len(size), self.NEVER)
        at = ragged(begins, counts)
        cost[at] = self._ranks(found, at, size, left)
        while len(begins):
            best = np.minimum.reduceat(cost[at], np.cumsum(counts) - counts)
            on = best < self.NEVER
            if on.sum() * 2 < len(on):  # leave out what is done
                begins, counts, best = begins[on], counts[on], best[on]
                at = ragged(begins, counts)
            p = best[best < self.NEVER] & np.int64(0xFFFFFFFF)
            q = p + size[p]
            size[p] += size[q]
            size[q], cost[q] = 0, self.NEVER
            after = (p + size[p])[left[p] > size[p]]
            before[after] = p[left[p] > size[p]]
            cost[p] = self._ranks(found, p, size, left)
            b = before[p]
            b = b[(b >= 0) & (left[b] > left[p])]  # in the same word
            cost[b] = self._ranks(found, b, size, left)

    def _alone(self, found: np.ndarray, begin: int, n: int, size: np.ndarray) -> None:
        """Merge in one long word."""
        end, longest = begin + n, len(found)
        sizes, before = [1] * n, list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(p: int) -> None:
            q = p + sizes[p]
            if p >= 0 and q < n and (both := sizes[p] + sizes[q]) <= longest and (piece := found[both - 1, begin + p]) >= 0:
                heappush(heap, (int(self.rank[piece]), p, both))

        for p in range(n - 1):
            offer(p)
        while heap:
            _, p, both = heappop(heap)
            if not sizes[p] or (q := p + sizes[p]) >= n or sizes[p] + sizes[q] != both:
                continue  # one of the two has merged since
            sizes[p], sizes[q] = both, 0
            if p + both < n:
                before[p + both] = p
            offer(p)
            if before[p] >= 0:
                offer(before[p])
        size[begin:end] = sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; data and offsets are UTF-8."""
        model = self.model
        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        bounds = np.searchsorted(byte, offsets)
        counts = np.diff(bounds)
        left = np.repeat(bounds[1:], counts) - np.arange(len(chars))
        found, size = self.lattice(chars, left), np.ones(len(chars), np.int64)
        short = (counts <= self.LONG) & (counts > 0)
        self._together(found, bounds[:-1][short], counts[short], size, left)
        for w in np.flatnonzero(counts > self.LONG):
            self._alone(found, int(bounds[w]), int(counts[w]), size)
        p = np.flatnonzero(size)
        piece = found[size[p] - 1, p]
        spelled = (piece < 0) & (model.bytes_from >= 0)  # by its bytes
        n = np.where(spelled, np.diff(byte)[p], 1)
        ends = np.cumsum(n)
        out = np.full(int(ends[-1]) if len(ends) else 0, model.unknown, np.int64)
        out[(ends - n)[piece >= 0]] = self.ids[piece[piece >= 0]]
        out[ragged((ends - n)[spelled], n[spelled])] = data[ragged(byte[p[spelled]], n[spelled])].astype(np.int64) + model.bytes_from
        return out, np.diff(np.append(0, ends)[np.searchsorted(p, bounds)])


def merged_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) for distinct non-empty words by a byte-pair model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(model)
        for batch, data, offsets in steps(batches, "word", LATTICE_BYTES):
            ids, counts = merges.encode(data, offsets)
            yield pa.RecordBatch.from_arrays([column(batch, "word"), list_array(ids.astype(np.int32), counts, pa.int32())], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def best_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) for distinct non-empty words by a unigram model: the cheapest path of each word's lattice."""
    worst = max((-s for s in model.scores), default=0.0) + UNKNOWN_PENALTY
    edges = F.col("edges")
    cut_up = lattice(words, model).withColumn("bounds", viterbi_bounds(F.col("n"), edges, worst))
    b = F.col("bounds")

    def spelled(s: Column) -> Column:
        if model.bytes_from < 0:
            return F.array(F.lit(model.unknown))
        code = F.hex(F.encode(F.substring("word", s + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + model.bytes_from)

    def ids(s: Column, i: Column) -> Column:
        e = F.element_at(b, i + 2)
        edge = F.filter(edges, lambda x: (x["s"] == s) & (x["e"] == e))
        return _once(F.element_at(edge, 1)["id"], lambda k: F.when(k.isNull(), spelled(s)).otherwise(F.array(k)))

    return cut_up.select("word", F.flatten(F.transform(F.slice(b, F.lit(1), F.size(b) - 1), ids)).alias("ids"))


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) for distinct non-empty words."""
    return merged_words(words, model) if model.kind == BPE else best_words(words, model)


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin among the bytes of prepared texts: as the pattern in ``write_dictionary`` has it."""
    if not len(data):
        return np.zeros(0, np.int64)
    space, single = data == 0x20, np.isin(data, np.frombuffer(BREAKS.encode(), np.uint8))
    first = single | space
    first[1:] &= single[1:] | ~space[:-1]
    first[1:] |= single[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


def distinct_words(texts: DataFrame) -> DataFrame:
    """All distinct words of prepared texts (column text); each task sends a word once for each of its steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches, step_bytes=WORD_BYTES):
            starts = _word_starts(data, offsets)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            _, once = np.unique(span_hashes(data, starts, ends), return_index=True)
            size = (ends - starts)[once]
            yield pa.RecordBatch.from_arrays([bytes_array(data[ragged(starts[once], size)], size)], names=["word"])

    return texts.mapInArrow(run, "word binary").distinct().select(F.col("word").cast("string").alias("word"))


@dataclass(frozen=True)
class Dictionary:
    """The ids of words: files by the first bits of a word's hash, each with sorted hashes and the ids of their words."""

    folder: str
    bits: int

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct sorted words in a row, and how many each has."""
        counts, flat = np.zeros(len(hashes), np.int64), []
        files = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        begins = np.flatnonzero(np.append(True, files[1:] != files[:-1])) if len(files) else np.zeros(0, np.int64)
        for i, j in zip(begins, np.append(begins[1:], len(hashes)), strict=True):
            known, end, ids = (map_array(self.folder, f"{name}-{files[i]}", kind) for name, kind in (("word", "u8"), ("end", "i8"), ("ids", "i4")))
            at = np.searchsorted(known, hashes[i:j])
            if len(at) and (not len(known) or at[-1] >= len(known) or (known[at] != hashes[i:j]).any()):
                raise LookupError(f"{self.folder}: file {files[i]} lacks words that were encoded")
            begin = np.where(at > 0, end[at - 1], 0)
            counts[i:j] = end[at] - begin
            flat.append(ids[ragged(begin, counts[i:j])])
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), counts


def write_dictionary(texts: DataFrame, model: Model) -> Dictionary:
    """Encode all distinct words of prepared texts (column text) and write their ids to the shared folder."""
    spark = texts.sparkSession
    folder = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (total // FILE_BYTES).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "word"))
            h = span_hashes(data, offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - bits)).astype(np.int32)), pa.array(h.view(np.int64)), column(batch, "ids")], names=["bucket", "h", "ids"])

    def write(rows: pa.Table) -> pa.Table:
        b = rows["bucket"][0].as_py()
        rows = rows.take(pa.array(np.argsort(rows["h"].to_numpy().view(np.uint64), kind="stable")))
        save_array(folder, f"word-{b}", rows["h"].to_numpy())
        save_array(folder, f"end-{b}", np.cumsum(np.diff(rows["ids"].combine_chunks().offsets.to_numpy())).astype(np.int64))
        save_array(folder, f"ids-{b}", _flat(rows, "ids").astype(np.int32))
        return pa.table({"bucket": pa.array([b], pa.int32())})

    encoded = encode_words(distinct_words(texts), model).mapInArrow(pack, "bucket int, h long, ids array<int>")
    encoded.groupBy("bucket").applyInArrow(write, "bucket int").write.format("noop").mode("overwrite").save()  # the files are the result
    return Dictionary(folder, bits)


def encode(docs: DataFrame, model: Model, out: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` (text and any other columns) with the ids of each whole text.

    As the sentencepiece library encodes: characters without piece become bytes. A null or empty text has no
    ids. Repeated rows each return; an empty table gives no rows. A column of docs named as ``out`` is replaced.
    Without keep_text the text itself goes no further, which halves what tasks hold.
    """
    names = [c for c in docs.columns if c != out and (keep_text or c != "text")]
    words = write_dictionary(docs.select(prepared(F.col("text")).alias("text")), model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, whole):
            starts = _word_starts(data, offsets)
            distinct, inverse = np.unique(span_hashes(data, starts, np.append(starts[1:], len(data))), return_inverse=True)
            ids, counts = words.look_up(distinct)
            n = counts[inverse]
            ends = np.cumsum(n)
            begins = np.cumsum(counts) - counts
            flat = ids[np.repeat(begins[inverse] - (ends - n), n) + np.arange(int(n.sum()))]
            bounds = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in names] + [list_array(flat, np.diff(bounds), pa.int32())], names=[*names, out])

    kept, (whole,) = named(*names), private(docs.columns, "prepared")
    schema = StructType([*docs.select(*kept).schema, StructField(out, ArrayType(IntegerType()))])
    return docs.select(*kept, prepared(F.col("text")).alias(whole)).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: bytes that are no UTF-8 become U+FFFD, ids without text nothing, null ids null."""
    names = [c for c in encoded.columns if c != out]
    spell = [b""] * (max(max(model.ids, default=0), model.bytes_from + 255, model.unknown) + 1)
    for piece, i in zip(model.pieces, model.ids, strict=True):
        spell[i] = piece.encode()
    if model.bytes_from >= 0:
        spell[model.bytes_from : model.bytes_from + 256] = [bytes([b]) for b in range(256)]
    size = np.array([len(x) for x in spell])
    flat, begin = np.frombuffer(b"".join(spell), np.uint8), np.cumsum(size) - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = column(batch, ids)
                k = lists.flatten().to_numpy()
                ends = np.cumsum(size[k])
                data = flat[np.repeat(begin[k] - (ends - size[k]), size[k]) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
                bounds = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]])
                texts = [data[i:j].decode("utf-8", "replace").removeprefix(" ") if ok else None for i, j, ok in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, c) for c in names] + [pa.array(texts, pa.string())], names=[*names, out])

    rows = encoded.select(*named(*names))
    return rows.mapInArrow(run, StructType([*rows.schema, StructField(out, StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' piece ids, and the checksum of what they decode to."""
    import public_tokenizers

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = decode(encode(docs, model, keep_text=False), model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
