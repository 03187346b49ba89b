"""Op 8, a quality classifier: a byte-level convolutional network in numpy.

A text's bytes, each marked if its word repeats the word before, are cut into overlapping chunks that cover
the whole text. Learned filters run over each chunk; each filter's largest response in a chunk is kept, and
the mean and the largest of these over all chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SPACES, Words, column, cut, named, ragged, steps, table
from .toxicity import fold

#: Bytes of a chunk and from one chunk's start to the next one's; a filter's width and step.
CHUNK, HOP, WIDTH, STRIDE = 256, 224, 8, 2
FILTERS, EMBEDDING, SYMBOLS = 16, 8, 513
#: Training: labelled rows at most; chunks that stand for a text, drawn from all over it; of these in a round; rounds.
TRAIN_ROWS, TRAIN_CHUNKS, ROUND_CHUNKS, EPOCHS = 1500, 64, 8, 6
ACCEPT = 0.3
#: Bytes of a long text whose words are found together, and chunks whose responses are held together.
BLOCK_BYTES, POOL_CHUNKS = 1 << 20, 4096


@dataclass
class Network:
    embedding: np.ndarray  # symbol, dimension
    filters: np.ndarray  # place in the width, dimension, filter
    bias: np.ndarray
    weights: np.ndarray  # mean of every filter, then largest of every filter
    intercept: float

    def tables(self) -> np.ndarray:
        """Each filter's response to each symbol at each place of its width."""
        return np.stack([self.embedding @ w for w in self.filters]).astype(np.float32)


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK_BYTES that end where a word does."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        while end < len(data) and data[end] not in SPACES:
            spaces = np.flatnonzero(np.isin(data[end : end + BLOCK_BYTES], SPACES))
            end = end + int(spaces[0]) if len(spaces) else min(end + BLOCK_BYTES, len(data))
        yield at, end
        at = end


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes + 1, 256 more in words that repeat the word before, then zeros (a filter's width and to an even place); and the texts' begins."""
    size = np.diff(offsets)
    room = size + WIDTH + (size & 1)
    begins = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.int16)
    before, text_before = None, -1  # the last word of the block before, and its text
    for at, end in _blocks(data):
        texts = np.arange(int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, end, "left")))
        bounds = np.clip(np.append(offsets[texts], offsets[texts[-1] + 1]), at, end) - at
        words = Words(data[at:end], bounds)
        h, of = words.hashes(), texts[words.text_of()]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        if len(h):
            same[0] = before == h[0] and text_before == of[0]
            before, text_before = h[-1], of[-1]
        change = np.zeros(end - at + 1, np.int16)
        change[words.starts[same]] += 256
        change[words.ends[same]] -= 256
        counts = np.diff(bounds)
        out[ragged(begins[texts] + bounds[:-1] + at - offsets[texts], counts)] = data[at:end].astype(np.int16) + 1 + np.cumsum(change[:-1], dtype=np.int16)
    return out, begins


def chunk_bounds(begins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all chunks, in steps of the filters; an empty text has one chunk of zeros."""
    n = np.maximum(1, -(-(size - (CHUNK - HOP)) // HOP))
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = begins[text] + k * HOP
    end = np.minimum(start + CHUNK, begins[text] + np.maximum(size[text], 1))
    return text, start // STRIDE, -(-end // STRIDE)


def score_texts(net: Network, tables: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text."""
    sym, begins = symbols(data, offsets)
    text, start, end = chunk_bounds(begins, np.diff(offsets))
    pooled = np.empty((len(text), FILTERS), np.float32)
    for a in range(0, len(text), POOL_CHUNKS):
        part = slice(a, a + POOL_CHUNKS)
        low, high = int(start[a]), int(end[part].max())
        response = np.tile(net.bias.astype(np.float32), (high - low + 1, 1))
        for j in range(WIDTH):
            response[:-1] += tables[j].take(sym[STRIDE * low + j : STRIDE * high + j : STRIDE], axis=0)
        pooled[part] = np.maximum(np.maximum.reduceat(response, np.stack([start[part], end[part]], 1).ravel() - low, axis=0)[::2], 0)
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    mean = np.add.reduceat(pooled, first, axis=0) / np.diff(np.append(first, len(text)))[:, None]
    top = np.maximum.reduceat(pooled, first, axis=0)
    z = np.concatenate([mean, top], 1).astype(np.float64) @ net.weights + net.intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def drawn_chunks(doc_id: int, data: np.ndarray, most: int = TRAIN_CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a whole text's chunks, or of ``most`` of them drawn at random, and how many steps of the filters each has."""
    size = np.array([len(data)])
    sym, begins = symbols(data, np.array([0, len(data)]))
    _, start, end = chunk_bounds(begins, size)
    rng = np.random.default_rng([8, doc_id & 0xFFFFFFFF])
    chosen = np.arange(len(start)) if len(start) <= most else np.sort(rng.choice(len(start), most, replace=False))
    padded = np.append(sym, np.zeros(CHUNK + WIDTH, np.int16))
    return padded[STRIDE * start[chosen][:, None] + np.arange(CHUNK + WIDTH)], (end - start)[chosen]


def gradients(p: dict[str, np.ndarray], chunks: np.ndarray, steps_in: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss of texts of ``counts`` chunks each, and its gradient (the filters' and weights' with their decay)."""
    span = CHUNK // STRIDE
    at = np.arange(span)[None, :].repeat(len(chunks), 0)
    at[at >= steps_in[:, None]] = 0  # beyond the text: its first step once more
    windows = np.take_along_axis(chunks, (at[..., None] * STRIDE + np.arange(WIDTH)).reshape(len(chunks), -1), 1).reshape(len(chunks), span, WIDTH)
    flat = p["e"][windows].reshape(-1, WIDTH * EMBEDDING)
    response = (flat @ p["f"] + p["b"]).reshape(len(chunks), span, FILTERS)
    best = response.argmax(1)
    peak = np.take_along_axis(response, best[:, None], 1)[:, 0]
    pooled = np.maximum(peak, 0)
    first = np.cumsum(counts) - counts
    mean = np.add.reduceat(pooled, first, axis=0) / counts[:, None]
    top = np.maximum.reduceat(pooled, first, axis=0)
    x = np.concatenate([mean, top], 1)
    z = np.clip(x @ p["w"] + p["c"], -30, 30)
    error = (1 / (1 + np.exp(-z)) - labels) / len(labels)
    dx = error[:, None] * p["w"]
    doc = np.repeat(np.arange(len(labels)), counts)
    holds = (pooled == top[doc]).astype(x.dtype)
    holds /= np.add.reduceat(holds, first, axis=0)[doc]  # chunks that tie share what the largest response gets
    d_pooled = dx[doc, :FILTERS] / counts[doc][:, None] + dx[doc, FILTERS:] * holds
    d_peak = d_pooled * (peak > 0)
    row = (np.arange(len(chunks))[:, None] * span + best).ravel()
    patch = flat[row].reshape(len(chunks), FILTERS, -1)
    grad = {"w": x.T @ error + 1e-4 * p["w"], "c": error.sum(), "b": d_peak.sum(0), "f": np.einsum("cfd,cf->df", patch, d_peak) + 1e-4 * p["f"]}
    d_patch = (d_peak[..., None] * p["f"].T[None]).reshape(-1, EMBEDDING)
    grad["e"] = np.zeros_like(p["e"])
    np.add.at(grad["e"], windows.reshape(-1, WIDTH)[row].ravel(), d_patch)
    return float(np.mean(np.logaddexp(0, z) - labels * z)), grad


def train(chunks: list[np.ndarray], steps_in: list[np.ndarray], labels: np.ndarray, seed: int = 8) -> Network:
    """Fit all parameters to labelled texts, each given by its chunks, by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 0.3, (SYMBOLS, EMBEDDING)),
        "f": rng.normal(0, 0.18, (WIDTH * EMBEDDING, FILTERS)),
        "b": np.zeros(FILTERS),
        "w": rng.normal(0, 0.1, 2 * FILTERS),
        "c": np.array(float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 32)):
            own = [np.arange(len(chunks[i])) if len(chunks[i]) <= ROUND_CHUNKS else np.sort(rng.choice(len(chunks[i]), ROUND_CHUNKS, replace=False)) for i in batch]
            _, grad = gradients(p, np.concatenate([chunks[i][k] for i, k in zip(batch, own, strict=True)]), np.concatenate([steps_in[i][k] for i, k in zip(batch, own, strict=True)]), np.array([len(k) for k in own]), labels[batch])
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] = (p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(p["e"], p["f"].reshape(WIDTH, EMBEDDING, FILTERS), p["b"], p["w"].astype(np.float64), float(p["c"]))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS, train_chunks: int = TRAIN_CHUNKS, accept: float = ACCEPT) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with score and predicted.

    The network learns ``labels.quality`` from labelled rows where ``learn`` (over doc_id) holds: about
    train_rows at most, whatever the length of their texts; a long text is stood for by train_chunks of its
    chunks, drawn at random from the whole of it. Scores cover whole texts. Null labels are none;
    of several labels for an id the smallest counts. A null text is empty, and an empty text is one chunk of
    padding. Without labels of both classes every score is the one class there is, 1 if none. Repeated rows
    each return; an empty table gives no rows. Columns of docs named score or predicted are replaced.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).where(learn)
    n = known.count()
    kept = cut(known.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(max(n, 1))) < train_rows), "known")  # small enough to broadcast

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            for i, (doc_id, label) in enumerate(zip(column(batch, "doc_id").to_pylist(), column(batch, "label").to_pylist(), strict=True)):
                chunks, steps_in = drawn_chunks(int(doc_id), data[offsets[i] : offsets[i + 1]], train_chunks)
                yield pa.RecordBatch.from_arrays([pa.array([int(doc_id)], pa.int64()), pa.array([label], pa.int32()), pa.array([chunks.tobytes()]), pa.array([steps_in.tolist()], pa.list_(pa.int32()))], names=["doc_id", "label", "chunks", "steps"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(kept), "doc_id")
    drawn = texts.mapInArrow(draw, "doc_id long, label int, chunks binary, steps array<int>")
    sample = drawn.groupBy("doc_id", "label").agg(F.min("chunks").alias("chunks"), F.min_by("steps", "chunks").alias("steps")).toArrow().sort_by("doc_id")
    y = sample["label"].to_numpy().astype(np.float32)
    chunks = [np.frombuffer(x, np.int16).reshape(-1, CHUNK + WIDTH) for x in sample["chunks"].to_pylist()]
    net = train(chunks, [np.array(x) for x in sample["steps"].to_pylist()], y) if 0 < y.sum() < len(y) else None
    constant = float(y[0]) if len(y) else 1.0

    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch, data, offsets in steps(batches):
            score = score_texts(net, tables, data, offsets) if net else np.full(batch.num_rows, constant)
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in names] + [pa.array(score)], names=[*names, "score"])

    rows = docs.select(*named(*names))
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("score", DoubleType())])).withColumn("predicted", (F.col("score") >= accept).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
