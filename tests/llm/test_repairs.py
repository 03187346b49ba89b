"""Sets of one number, files that are missing, look-ups over many files."""

import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlake.llm import jaccard, lm, pieces, topk
from freightlake.llm.common import shared_dir


@pytest.mark.parametrize("bits", [1, 4])
def test_unlike_sets_of_one_number_lose_no_link(spark, docs, bits):
    """Nearly all sets share their number with others, and the components are as they are without."""

    def groups(**kw):
        members, links = jaccard.near_duplicates(docs.where("doc_id is not null"), **kw)
        assert members.select("node", "n_shingles").distinct().groupBy("node").count().where("count > 1").count() == 0
        rows, pairs = members.collect(), links.collect()
        root = {r["node"]: r["node"] for r in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in pairs:
            root[find(u)] = find(v)
        out = {}
        for r in rows:
            if r["n_shingles"]:
                out.setdefault(find(r["node"]), []).append(r["doc_id"])
        return Counter(tuple(sorted(x)) for x in out.values())

    assert groups(bits=bits) == groups()


def test_missing_files_of_a_model_are_errors(spark):
    texts = spark.createDataFrame([("a b c a b",), ("b c d e",), ("the end of it",)], "text string")
    model = lm.fit(texts, 3)
    assert model.written["grams"].any() and not model.written["grams"].all()
    names = {p.name for p in Path(model.folder.removeprefix("file://")).iterdir()}
    for kind, there in model.written.items():
        assert {f"{kind}-{b}" for b in np.flatnonzero(there)} == {n for n in names if n.startswith(f"{kind}-")}
    rows = spark.createDataFrame([(1, False, "a b c")], "doc_id long, held_out boolean, text string")
    assert lm.score_texts(rows, model).count() == 1
    gone = Path(model.folder.removeprefix("file://")) / f"words-{int(np.flatnonzero(np.diff(model.vocabulary.begins))[0])}"
    gone.rename(gone.with_name("elsewhere"))
    lm._heads.cache_clear()
    lm._mapped.cache_clear()
    hashes = np.sort(lm.tokens_of(np.frombuffer(b"a b c d e the end of it", np.uint8), np.array([0, 23]))[0])
    with pytest.raises(FileNotFoundError):
        model.vocabulary.look_up(hashes)


def test_a_look_up_costs_what_it_asks_for(tmp_path):
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2))
    took = {}
    for bits in (10, 20):
        begins = np.zeros((1 << bits) + 1, np.int64)
        vocabulary = lm.Vocabulary(f"file://{tmp_path}", bits, begins, 0)
        began = time.perf_counter()
        for _ in range(20):
            ids, counts = vocabulary.look_up(hashes)
        took[bits] = time.perf_counter() - began
        assert (ids == -1).all() and (counts == 0).all()
    assert took[20] < 20 * took[10] + 0.1


def test_a_dictionary_without_a_word_says_so(spark, tmp_path):
    folder = f"{shared_dir(spark)}/dictionary-of-a-test"
    system, path = lm._place(folder)
    system.create_dir(path, recursive=True)
    lm.save_array(folder, "word-0", np.array([5, 9], np.uint64))
    lm.save_array(folder, "end-0", np.array([1, 3], np.int64))
    lm.save_array(folder, "ids-0", np.array([7, 8, 9], np.int32))
    known = pieces.Dictionary(folder, 6)
    ids, counts = known.look_up(np.array([5, 9], np.uint64))
    assert ids.tolist() == [7, 8, 9] and counts.tolist() == [1, 2]
    for lacking in (6, 10):
        with pytest.raises(LookupError):
            known.look_up(np.array([5, lacking], np.uint64))


def test_blocks_that_know_bounds_give_the_same(spark, monkeypatch):
    """Many blocks, a sample, equal vectors and ids, two lengths: the k best are those of all pairs."""
    rng = np.random.default_rng(19)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(int(i), rows[3][1]) for i in range(1000, 1040)] + [(20, rows[5][1])] * 3 + [(int(i), rng.normal(size=5).astype(np.float32).tolist()) for i in range(2000, 2060)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    ints = [np.floor(64 * np.asarray(v, np.float32).astype(np.float64)) for _, v in rows]
    want, asked = [], set()
    for i, (vec_id, v) in enumerate(rows):
        if vec_id % 20 == 0 and (vec_id, tuple(v)) not in asked:
            asked.add((vec_id, tuple(v)))
            scores = sorted((-int(ints[i] @ ints[j]), rows[j][0]) for j in range(len(rows)) if j != i and len(ints[j]) == len(ints[i]))[:7]
            want += [(vec_id, rank, other, -less) for rank, (less, other) in enumerate(scores, 1)]
    for block_bytes, sample in ((1 << 11, 30), (1 << 12, 5), (1 << 25, 100)):
        monkeypatch.setattr(topk, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(topk, "SAMPLE", sample)
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()
        assert Counter(map(tuple, got)) == Counter(want)
