"""The sharding query moves and writes whole records."""

import zlib
from collections import Counter

from freightlake.llm import sharding


def test_query_writes_whole_texts(spark, docs, rows, empty, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    written, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda sharded, path: (write(sharded, path), written.append(path)))
    got = sharding.op4_sharding(spark, str(tmp_path)).collect()
    stored = spark.read.parquet(*written).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in stored) == Counter((i, t, "en") for i, t in rows)
    row = lambda i, t, shard, slot: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), shard, slot)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == Counter(row(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in stored)
    empty.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert sharding.op4_sharding(spark, str(tmp_path / "none")).count() == 0
