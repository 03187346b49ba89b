"""Top-k search, SentencePiece, packing, language model and classifiers: against brute force, round trips and held-out labels."""

import math
import random
import tempfile
import zlib
from collections import Counter
from itertools import product

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from freightlake.llm import lm, packing, pieces, quality, topk, toxicity

BPE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def best(vectors, k, scale=64):
    ok = {i: [math.floor(scale * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in (i for i in ok if i % 20 == 0):
        found = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("d", [1, 20, 64])
def test_top_k(spark, d):
    rng = random.Random(d)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    vectors = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(300)]
    vectors += [(400, None), (420, [1.0] * (d - 1) + [None]), (440, [1.0] * (d - 1) + [float("nan")]), (460, [float("inf")] * d), (480, [0.5] * (d + 1)), (None, [1.0] * d)]
    vectors += [(500 + i, [0.25] * d) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20)
    assert sorted(tuple(r) for r in got.collect()) == best(vectors, 20)


def test_top_k_of_repeated_ids(spark):
    rng = random.Random(3)
    vectors = [(i // 3, [float(rng.randrange(-2, 3)) for _ in range(6)]) for i in range(240)]
    vectors += vectors[:20] + vectors[57:70] + [(40, [9.0] * 6)] * 30
    ints = [[math.floor(64 * x) for x in v] for _, v in vectors]
    want, asked = Counter(), set()
    for n, (i, v) in enumerate(vectors):
        if i % 20 == 0 and (i, tuple(v)) not in asked:
            asked.add((i, tuple(v)))
            found = sorted((-sum(a * b for a, b in zip(ints[n], x)), vectors[m][0]) for m, x in enumerate(ints) if m != n)[:20]
            want.update((i, rank + 1, c, -s) for rank, (s, c) in enumerate(found))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    df.write.parquet(str(folder := tempfile.mkdtemp()) + "/embeddings.parquet")
    assert Counter(tuple(r) for r in topk.op1_topk(spark, folder).collect()) == want
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert Counter(duck.sql(topk.OP1_SQL).fetchall()) == want


def test_top_k_of_large_numbers_and_of_nothing(spark):
    vectors = [(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [-1e6, 5.0]), (3, [1e30, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got[0] == (0, 1, 3, (1 << 63) - 1)
    assert [g[2] for g in got] == [3, 1, 2]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_pieces_as_the_library_has_them(spark, docs, rows):
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=BPE_MODEL), pieces.read_model(BPE_MODEL)
    odd = ["a  b\n c", " ", "  é é ﬁ​① a▁b \t\t x\r\n  y    z", "梦 想\x00\x01", "a" * 66, " \n "]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = pieces.decode(pieces.encode(more, model), model).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
    assert pieces.encode(docs.limit(0), model).count() == 0


def test_viterbi_path_of_a_unigram_model(spark):
    scores = {" ": -2.0, "a": -3.0, "b": -3.5, " a": -3.1, "ab": -4.0, "ba": -5.5, "aba": -6.0, "bb": -8.0}
    model = pieces.Model(tuple(scores), tuple(range(1, 9)), tuple(scores.values()), -1, 0, pieces.UNIGRAM)
    words = [" " + "".join(x) for n in (1, 4, 6) for x in product("abq", repeat=n)]
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    worst, names = -min(scores.values()) + pieces.UNKNOWN_PENALTY, dict(zip(model.ids, model.pieces))
    cost = lambda p: -scores[p] if p in scores else worst
    for w in words:
        least = [0.0] + [math.inf] * len(w)
        for e in range(1, len(w) + 1):
            least[e] = min(least[s] + cost(w[s:e]) for s in range(max(0, e - 3), e) if w[s:e] in scores or e - s == 1)
        assert abs(sum(cost(names[i]) if i else worst for i in got[w]) - least[-1]) < 1e-9


def test_fillings_are_the_best():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        sums = {sum(n * t for n, t in zip(counts, times)) for times in product(*(range(c + 1) for c in counts.values()))}
        chosen = packing.fill(counts, room)
        assert all(t <= counts[n] for n, t in chosen.items())
        assert sum(n * t for n, t in chosen.items()) == max(s for s in sums if s <= room)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(WORD_TOKENIZER)
    got = packing.pack(docs, WORD_TOKENIZER, capacity=512).collect()
    need = Counter()
    for i, t in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 512):
            part = ids[s : s + 512]
            need[i, s, len(part), b"".join(x.to_bytes(4, "little") for x in part), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == need
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        ends = [o + n for o, n in sorted(w)]
        assert [o for o, _ in sorted(w)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(windows) <= math.ceil(sum(r["length"] for r in got) / 512) + 1
    assert packing.pack(docs.limit(0), WORD_TOKENIZER).count() == 0


def test_packing_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op5_packing(spark, str(tmp_path)).collect()
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] for r in got)
    assert sum(r["length"] for r in got if r["start"] == 0) and max(r["offset"] + r["length"] for r in got) <= 2048


def test_language_model(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    import re

    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            x = tokens(t)
            words.update(x)
            pairs.update(zip(["\t", *x[:-1]], x))
    follows, n, v = Counter(w for _, w in pairs), sum(words.values()), len(words)
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    import numpy as np

    d2, d1 = lm.discounts(np.array(of(pairs))), lm.discounts(np.array(of(follows)))
    rest = sum(d1[min(c, 3)] for c in follows.values()) / len(pairs)
    total, left = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        left[a] += d2[min(c, 3)]
    one = lambda w: (follows[w] - d1[min(follows[w], 3)]) / len(pairs) + rest / (v + 1)
    p = lambda a, w: (pairs[a, w] - d2[min(pairs[a, w], 3)]) / total[a] + left[a] / total[a] * one(w) if total[a] else one(w)
    assert abs(sum(map(one, words)) + rest / (v + 1) - 1) < 1e-9
    need = Counter()
    for i, t in rows:
        x = tokens(t)
        base, score = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in x), sum(math.log10(p(a, w)) for a, w in zip(["\t", *x[:-1]], x))
        need[i, held(i), len(x), sum(words[w] > 0 for w in x), n, round(base, 4), round(score, 4)] += 1
    got = lm.op6_lm_scores(spark, str(tmp_path), order=2).collect()
    assert Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 4), round(r[6], 4)) for r in got) == need


def test_language_model_of_nothing(spark, empty, tmp_path):
    empty.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert lm.op6_lm_scores(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(20, 200))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            w[len(w) // 2 : len(w) // 2] = ["you", "are", "an", "idiot"] if i % 2 else ["zorgle" + word()]
        docs.append((i, " ".join(x.upper() + "!!" if bad else x for x in w), "x"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(900, None, "x"), (901, "", "x"), (None, "text without id", "x"), (902, "twice", "x"), (902, "twice", "x")]
    labels += [(902, None, None), (None, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, predicted string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(scored, labels, name, mod):
    rows = scored.join(labels.where(f"{name} is not null"), "doc_id").where(toxicity.fold(mod[0]) == mod[1]).select("score", name).collect()
    good, bad = [r["score"] for r in rows if r[name] == 1], [r["score"] for r in rows if r[name] == 0]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_quality(labelled):
    docs, labels = labelled
    scored = quality.score_quality(docs, labels, toxicity.fold(5) != 0).cache()
    assert scored.count() == docs.count() and dict(scored.dtypes)["predicted"] == "int"
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert held_out(scored, labels, "quality", (5, 0)) > 0.95
    assert quality.score_quality(docs.limit(0), labels, toxicity.fold(5) != 0).count() == 0


def test_quality_without_labels(labelled):
    docs, labels = labelled
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0), F.lit(True)).collect()} == {1.0}


def test_toxicity(labelled):
    docs, labels = labelled
    scored = toxicity.score_toxicity(docs, labels, toxicity.fold(3) != 1).cache()
    assert scored.count() == docs.count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert held_out(scored, labels, "toxic", (3, 1)) > 0.95
    assert toxicity.score_toxicity(docs.limit(0), labels, toxicity.fold(3) != 1).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
