"""The pipeline keeps what it should on the smallest tables, and each stage does what its brute-force version does."""

import zlib
from collections import Counter

import public_tokenizers
import pytest
from test_text_operators import components, without_repeats, words_of
from tokenizers import Tokenizer

import corpus_pipeline
from freightlake.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_of_nothing(spark):
    docs = corpus_pipeline.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize(("stage", "query", "predicted", "label"), [("toxicity", "op10_toxicity", 0, "toxic"), ("quality", "op8_quality", 1, "quality")])
def test_classifier_stages_keep_what_is_accepted(spark, stage, query, predicted, label):
    docs = corpus_pipeline.table(spark, SF, "documents")
    kept = {tuple(r) for r in getattr(corpus_pipeline, stage)(spark, docs, SF).collect()}
    scored = registry.queries()[query](spark, SF).collect()
    accepted = {r["doc_id"] for r in scored if r["predicted"] == predicted}
    assert kept == {tuple(r) for r in docs.collect() if r["doc_id"] in accepted}
    good = {r["doc_id"] for r in corpus_pipeline.table(spark, SF, "labels").collect() if r[label] == predicted}
    fresh = {r["doc_id"] for r in scored if r["held_out"]} & good
    assert len(fresh & accepted) >= 0.9 * len(fresh)


def test_near_duplicate_stage_by_brute_force(spark, docs, rows):
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = Counter((r["doc_id"], r["text"], r["lang"], r["score"], r["rid"]) for r in kept.collect())
    stay = [r for r in got.elements() if words_of(r[1])]
    assert got - Counter(stay) == Counter((i, t, "en", 1, "x") for i, t in rows if not words_of(t))
    assert {r[:2] for r in stay} <= set(rows)
    labelled, n_components = components(rows)
    assert {r[0] for r in stay} == {c for _, n, c in labelled if n} and len(stay) == n_components


def test_substring_stage_by_brute_force(spark, docs, rows):
    got = corpus_pipeline.substrings(spark, docs.withColumn("n_chars", docs.score), SF)
    assert got.columns == [*docs.columns, "n_chars"]
    stripped = without_repeats(rows, 35)
    whole = [(i, t) for i, t in rows if (i, len(words_of(t)), 0, " ".join(words_of(t))) in stripped]
    changed = [(i, kept) for i, _, gone, kept in stripped.elements() if gone]
    assert changed
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == Counter([(i, t, 1) for i, t in whole] + [(i, kept, len(kept)) for i, kept in changed])


def test_packing_stage_by_brute_force(spark, docs, rows):
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    need = Counter()
    for i, t in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            need[i, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)] += 1
    got = corpus_pipeline.packing(spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == need
