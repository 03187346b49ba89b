"""Sharding, fingerprints, repeated passages, near duplicates: against brute force on rows with every odd case."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from freightlake.llm import fingerprints, jaccard, sharding, substrings

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return SPLIT.findall(text or "")


def test_shards_hold_all_rows_evenly(docs, rows, spark, tmp_path):
    records = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    got = sharding.shuffle_into_shards(records, 7, bucket_bytes=20_000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    sharding.write_shards(spark.createDataFrame(got), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_shards_of_nothing(empty):
    assert sharding.shuffle_into_shards(empty.withColumn("size", F.lit(1)), 3).count() == 0


def kept_grams(text):
    """Winnowing by the book: word grams, smallest per window, rightmost tie; gram identity instead of its hash."""
    w = text.split()
    k = min(len(w), fingerprints.GRAM)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def test_fingerprints_hold_the_guarantee(spark):
    common = " ".join(f"c{i}" for i in range(fingerprints.GRAM + fingerprints.WINDOW - 1))
    texts = {1: f"a b c d e f {common} g h", 2: f"{common} z", 3: "tie tie tie tie tie tie tie tie tie", 4: "", 5: "one", 6: None}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: r["f"] for r in fingerprints.with_fingerprint(df, "text", "f").collect()}
    place = lambda x: fingerprints._LAST - (x & fingerprints._LAST)
    name = lambda x: x >> fingerprints.POSITION_BITS
    assert {name(x) for x in got[1]} & {name(x) for x in got[2]}
    assert got[4] == [] and got[6] == [] and len(got[5]) == 1
    n = len(texts[3].split()) - fingerprints.GRAM + 1
    assert [place(x) for x in got[3]] == list(range(fingerprints.WINDOW - 1, n))  # the rightmost of every window
    for i, t in texts.items():
        grams = kept_grams(t or "")
        names = {}
        for x in got[i]:
            assert names.setdefault(grams[place(x)], name(x)) == name(x)
        for start in range(len(grams) - fingerprints.WINDOW + 1):
            assert any(start <= place(x) < start + fingerprints.WINDOW for x in got[i])


def fingerprint_by_the_book(text):
    """(hash, position) of the kept grams: each gram's polynomial from its words, each window's least, rightmost on ties."""
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words_of(text)]
    words = [(h - (1 << 64) if h >> 63 else h) % fingerprints.PRIME for h in words]
    k = min(len(words), fingerprints.GRAM)
    grams = [sum(h * fingerprints.BASE ** (k - 1 - j) for j, h in enumerate(words[i : i + k])) % fingerprints.PRIME for i in range(len(words) - k + 1)] if words else []
    ends = range(min(fingerprints.WINDOW, len(grams)), len(grams) + 1) if grams else ()
    return sorted({min(((grams[i], -i) for i in range(max(0, e - fingerprints.WINDOW), e))) for e in ends}, key=lambda x: -x[1])


def as_string(found):
    return " ".join(f"{h:x}@{-i}" for h, i in found)


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_as_by_the_book(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text").where("doc_id is not null and doc_id not in (14, 15)").write.parquet(str(tmp_path / "documents.parquet"))
    texts = sorted(((i, t or "") for i, t in rows if i is not None and i not in (14, 15)), reverse=True)
    want = {}
    for (i, own), (_, after) in zip(texts, texts[1:] + texts[:1]):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        f, e, x = map(fingerprint_by_the_book, (own, edited, after))
        want[i] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), as_string(f), as_string(e), alike(f, e), alike(f, x))
    got = fingerprints.op9_fingerprints(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got} == want


def test_next_documents_and_edited_texts(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r for r in fingerprints.op9_fingerprints(spark, str(tmp_path)).collect() if r["doc_id"] is not None]
    assert len(got) == sum(i is not None for i, _ in rows)
    order = sorted({i for i, _ in rows if i is not None}, reverse=True)
    text = {i: t or "" for i, t in rows}
    for r in got:
        own, at = text[r["doc_id"]], order.index(r["doc_id"])
        if r["doc_id"] in (15, 14, 1) or at + 1 == len(order) or order[at + 1] in (15, 14):
            continue
        half = len(own) // 2
        edited = own[: len(own) - half] + text[order[at + 1]][:half]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_fingerprints_of_nothing_and_of_one(spark, empty, tmp_path):
    empty.select("doc_id", "text").write.parquet(str(tmp_path / "a/documents.parquet"))
    assert fingerprints.op9_fingerprints(spark, str(tmp_path / "a")).count() == 0
    spark.createDataFrame([(1, "only one here")], "doc_id long, text string").write.parquet(str(tmp_path / "b/documents.parquet"))
    (row,) = fingerprints.op9_fingerprints(spark, str(tmp_path / "b")).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"only onsonly o"[:7] + b"only o").hexdigest()


def without_repeats(rows, window):
    seen = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words_of(t)] for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def test_repeated_passages(docs, rows):
    for hot in (substrings.HOT, 1):
        got = substrings.remove_repeats(docs, hot_above=hot)
        assert set(docs.columns) < set(got.columns)
        got = got.collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == without_repeats(rows, substrings.WINDOW)
        assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)
    short = substrings.remove_repeats(docs, window=8, gram=3).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in short) == without_repeats(rows, 8)


def test_repeated_passages_of_nothing(empty):
    assert substrings.remove_repeats(empty).count() == 0


def shingles(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, percent=80):
    """(the contract's rows, the number of components with words)."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc)
    small = lambda i: min((x for x in names[find(i)] if x is not None), default=None)
    return Counter((d, len(sets[i]), small(i) if sets[i] else d) for i, (d, _) in enumerate(rows)), len({find(i) for i in range(len(rows)) if sets[i]})


def test_near_duplicate_components(docs, rows, spark):
    got = jaccard.with_components(docs)
    assert Counter(tuple(r) for r in got.collect()) == components(rows)[0]
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    words = [r for r in kept.collect() if words_of(r["text"])]
    assert len(words) == components(rows)[1]


def test_chains_of_edits_link(spark):
    import random

    rng, out = random.Random(2), []
    for family in range(25):
        words = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.choice([6, 9, 14, 25, 60, 130, 400]))]
        for k in range(rng.randrange(2, 9)):
            out.append((family * 100 + k, " ".join(words)))
            for _ in range(max(1, len(words) // 25)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    got = jaccard.with_components(spark.createDataFrame(out, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == components(out)[0]


def test_near_duplicates_of_nothing(empty):
    assert jaccard.with_components(empty).count() == 0
    assert jaccard.drop_near_duplicates(empty).count() == 0


def test_allocation_meets_the_need():
    thresholds = jaccard.allocate([1, 50, 1, 1], [9, 9, 2, 9], 4)
    assert sum(x + 1 for x in thresholds) >= 4 and thresholds[1] == -1


def test_checksums_of_sizes(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.op4_sharding(spark, str(tmp_path)).collect())
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
