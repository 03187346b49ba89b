"""The language model of any order, against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from freightlake.llm import lm, registry

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def grams_of(text, order):
    x = ["\t"] * (order - 1) + tokens(text)
    return list(zip(*(x[i:] for i in range(order)), strict=False))


def brute_force(rows, order):
    """Score of each row: counts at the highest order, continuation counts at all others."""
    counts = {order: Counter(g for i, t in rows if not held(i) for g in grams_of(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    vocabulary = len({g for i, t in rows if not held(i) for g in tokens(t)})
    lost = {k: lm.discounts(np.array([sum(x == n for x in c.values()) for n in (1, 2, 3, 4)])) for k, c in counts.items()}
    total, left = Counter(), Counter()
    for k, c in counts.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            left[k, g[:-1]] += lost[k][min(n, 3)]

    def p(g):
        k, lower = len(g), p(g[1:]) if len(g) > 1 else 1 / (vocabulary + 1)
        n, n_all = counts[k][g], total[k, g[:-1]]
        return (n - lost[k][min(n, 3)]) / n_all + left[k, g[:-1]] / n_all * lower if n_all else lower

    return Counter((i, round(sum(math.log10(p(g)) for g in grams_of(t, order)), 4)) for i, t in rows)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_order(spark, docs, rows, tmp_path, order):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = lm.op6_lm_scores(spark, str(tmp_path), order=order).collect()
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in got) == brute_force(rows, order)


def test_frequent_words(spark, rows, tmp_path):
    rows = rows + [(3000 + i, " ".join(f"the {'of' if (i + k) % 3 else 'w'}{k % 7} the the w{k * i % 11}" for k in range(40))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = lm.op6_lm_scores(spark, str(tmp_path), order=3).collect()
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in got) == brute_force(rows, 3)


def test_registered_order(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["op6_lm_scores"](spark, str(tmp_path)).collect()
    assert lm.ORDER == 3 and Counter((r["doc_id"], round(r["score"], 4)) for r in got) == brute_force(rows, 3)


def test_language_model_of_nothing_of_order(spark, empty, tmp_path):
    empty.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert lm.op6_lm_scores(spark, str(tmp_path), order=3).count() == 0
