"""What decides about scale and odd inputs: candidates of unlike sets, alike families, long words and texts, clashing names, frequent ids, SQL."""

import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freightlake.llm import fingerprints, jaccard, pieces, quality, registry, substrings

SF = "/root/testdata/sf0.001"


def members_of_groups(n, size):
    """How many members have the groups in which sets that share nothing meet."""
    shingles = np.random.default_rng(n + size).integers(0, 2**63, (n, size)).astype(np.uint64)
    shingles.sort(1)
    sig, place, role = jaccard.Signatures(80).of(shingles.ravel(), np.arange(n + 1) * size)
    order = np.lexsort((place, sig))
    sig, place, role = sig[order], place[order], role[order]
    first = jaccard._starts(sig, place)
    sig, role = sig[first], np.bitwise_or.reduceat(role[first], np.arange(len(first)))
    begins = jaccard._starts(sig)
    counts = np.diff(np.append(begins, len(sig)))
    some = lambda bit: np.add.reduceat((role & bit > 0).astype(int), begins) > 0
    return int(counts[(counts > 1) & some(jaccard.PROBES) & some(jaccard.INDEXED)].sum())


@pytest.mark.parametrize("size", [8, 12, 20, 80])
def test_unlike_sets_seldom_meet(size):
    few, many = members_of_groups(4000, size), members_of_groups(16_000, size)
    assert few <= 400 and many <= 1600  # of 4,000 and 16,000 sets with 13 signatures and more


def linked(rows, percent=80):
    """Brute force: (id, set size, smallest id of its component)."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in rows for w in [t.split()]]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                label[high] = low
    return {(i, len(sets[k]), rows[find(k)][0]) for k, (i, _) in enumerate(rows)}


def test_sets_of_all_sizes_near_the_threshold(spark):
    rng, rows = random.Random(3), []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 25, 30, 40, 60, 90, 97, 120, 200) * 3:
        base = [rng.randrange(10**6) for _ in range(n + 4)]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(max(2, n // 8 + 1))):
                at, kind = rng.randrange(len(words)), rng.random()
                words[at : at + (kind < 0.7 and len(words) > 1)] = [rng.randrange(10**6)] if kind < 0.4 or kind >= 0.7 else []
            rows.append((len(rows), " ".join(map(str, words))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard.with_components(df).collect()} == linked(rows)


def test_a_family_under_the_threshold_and_one_over_it(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_PART", 50)  # both families are split
    monkeypatch.setattr(jaccard, "CELL_PART", 40)
    rng, rows = random.Random(4), []
    for changes in (3, 2):
        base = [f"{changes}w{i}" for i in range(100)]
        for _ in range(120):
            words = list(base)
            for at in rng.sample(range(100), changes):
                words[at] = str(rng.randrange(10**9))
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard.with_components(df).collect()} == linked(rows)


def test_a_network_by_the_book():
    rng = np.random.default_rng(0)
    p = {"e": rng.normal(0, 0.3, (quality.SYMBOLS, 8)), "f": rng.normal(0, 0.2, (64, 16)), "b": rng.normal(0, 0.1, 16), "w": rng.normal(0, 0.3, 32), "c": np.array(0.1)}
    net = quality.Network(p["e"], p["f"].reshape(8, 8, 16), p["b"], p["w"], 0.1)
    texts = [b"", b"a", b"the the the cat  cat\nsat", bytes(rng.integers(32, 120, 3000).astype(np.uint8)), b"x" * 2000, b"abc abc " * 300]

    def naive(t):
        s, last, size = [b + 1 for b in t], None, len(t)
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", t):
            for i in range(*m.span()) if last == m.group() else ():
                s[i] += 256
            last = m.group()
        s += [0] * (8 + size % 2)
        pooled = []
        for k in range(max(1, -(-(size - 32) // 224))):
            steps = range(k * 112, -(-min(k * 224 + 256, max(size, 1)) // 2))
            pooled.append(np.maximum(np.max([p["b"] + sum(p["e"][s[2 * q + j]] @ net.filters[j] for j in range(8)) for q in steps], 0), 0))
        return 1 / (1 + np.exp(-(np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)]) @ p["w"] + 0.1)))

    data, offsets, want = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), [naive(t) for t in texts]
    assert np.allclose(quality.score_texts(net, net.tables(), data, offsets), want, atol=1e-6)
    with pytest.MonkeyPatch.context() as patch:  # in slices, as a long text is
        patch.setattr(quality, "BLOCK_BYTES", 37)
        patch.setattr(quality, "POOL_CHUNKS", 3)
        assert np.allclose(quality.score_texts(net, net.tables(), data, offsets), want, atol=1e-6)
    drawn = [quality.drawn_chunks(i, np.frombuffer(t, np.uint8), 5) for i, t in enumerate(texts)]
    given = np.concatenate([c for c, _ in drawn]), np.concatenate([s for _, s in drawn]), np.array([len(c) for c, _ in drawn]), np.array([0, 1, 0, 1, 1, 0.0])
    _, grad = quality.gradients(p, *given)
    for k, x in p.items():
        flat, g = x.reshape(-1), np.asarray(grad[k]).reshape(-1)
        for i in np.argsort(-abs(g))[:4]:
            was, loss = flat[i], []
            for by in (1e-6, -1e-6):
                flat[i] = was + by
                loss.append(quality.gradients(p, *given)[0])
            flat[i] = was
            assert abs((loss[0] - loss[1]) / 2e-6 + (1e-4 * was if k in "wf" else 0) - g[i]) < 1e-5


def test_long_words_as_the_library_has_them():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.read_model(path), random.Random(2)
    merges = pieces.Merges(model)
    words = [" " + "".join(rng.choice("thenadiorslé") for _ in range(n)) for n in (1, 63, 64, 65, 20_000)] + [" " * 20_000, " e" + "e" * 3000, " 数据\x00🙂q"]
    offsets = np.cumsum([0, *(len(w.encode()) for w in words)])
    began = time.process_time()
    ids, counts = merges.encode(np.frombuffer("".join(words).encode(), np.uint8), offsets)
    assert time.process_time() - began < 20
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [library.encode(w[1:]) for w in words]


CLASHES = "score predicted shared marks whole rid one number n_words n_removed kept_text removed hidden words node rest row label".split()


def test_stages_leave_columns_of_any_name(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)
        if name in ("near_duplicates", "substrings"):
            assert sorted((tuple(r[c] for c in docs.columns) for r in rows), key=repr) == sorted(map(tuple, stage(spark, docs, SF).collect()), key=repr)
    removed = substrings.remove_repeats(docs.select("doc_id", "text", F.lit(1).alias("shared"), F.lit(2).alias("marks")))
    assert {(r["shared"], r["marks"]) for r in removed.select("shared", "marks").distinct().collect()} == {(1, 2)}


@pytest.mark.parametrize("bounds", [10_000, 3])
def test_next_of_frequent_and_null_ids(spark, monkeypatch, bounds):
    monkeypatch.setattr(fingerprints, "ROWS_TOGETHER", 20)
    monkeypatch.setattr(fingerprints, "MOST_BOUNDS", bounds)
    rng = random.Random(6)
    rows = [(i, f"text {rng.random()}") for i in [None] * 60 + [5] * 90 + [6] * 70 + [(1 << 63) - 1] * 50 + list(range(-40, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashed = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]
    order = sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    want = {(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])}
    assert {(r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(df).collect()} == want


@pytest.mark.parametrize("name", ["op1_topk", "op2_substrings", "op7_jaccard_join"])
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(registry.oracles()[name])
    got = registry.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
