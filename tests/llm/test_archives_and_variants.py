"""Spelling variants, Merkle manifests and web archives: against brute force on rows with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from freightlake.llm import merkle, registry, variants, warc
from freightlake.llm.common import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling variants


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % variants.DAMAGE == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def edits(a, b):
    """Whether a and b differ by exactly one code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(a[:k] == b[:k] and a[k + (len(a) == len(b)) :] == b[k + 1 :] for k in range(len(b)))


def grouped(words):
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if edits(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near))
    roots = {}
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        roots[w] = root
    return {w: (*out[w], forms[w], None if forms[w] is None else words[forms[w]], roots[w]) for w in words}


def odd_texts():
    rng = random.Random(11)
    stems = ["strasse", "überall", "naïveté", "mississippi", "aaaaa", "aaaaaa", "Aaaaaaa", "ÀÉÎõü", "àéîõü"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeß÷") + w[at:], w[:at] + rng.choice("xyÿ") + w[at + 1 :]])
            words.append(w)
        rows.append((i, rng.choice(["", "¡", "数"]) + rng.choice([" ", "-", "\n", "1", "ā"]).join(words)))
    long = "z" * 300 + "y"
    rows += [(None, "straße strasse"), (500, None), (501, ""), (502, "12 !? 数据"), *[(503, f"{long} {long[1:]} {'q' * 70}")] * 4, (504, "abcde" * 40_000)]
    return rows


def test_words_are_counted_as_by_the_book(spark):
    rows = odd_texts()
    got = {r["word"]: r["n"] for r in variants.count_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == counted(rows) and any(len(w) > variants.LONG_RUN for w in got)


def test_long_texts_are_cut_between_runs(spark, monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beetle", "éclair", "gamma1delta", "x" * 90]) for _ in range(4000))
    rows = [(1, text), (2, "alpha" + text)]
    monkeypatch.setattr(variants, "STEP_BYTES", 40)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [t for _, t in rows]})
    total = Counter()
    for out in variants._counted(iter([batch])):
        for w, n in zip(out["word"].to_pylist(), out["n"].to_pylist()):
            total[w] += n
    assert {w: n for w, n in total.items() if n >= 3 and len(w) >= 5} == counted(rows)


@pytest.mark.parametrize("span_words", [3, 1024])
def test_variants_as_by_the_book(spark, span_words):
    words = counted(odd_texts())
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n long, best string, of int").repartition(3)
    got = {r["word"]: tuple(r)[1:] for r in variants.group_variants(df, span_words).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == grouped(words) and sum(v[2] is not None for v in got.values()) > 20


def test_tiles_of_any_width(spark, monkeypatch):
    monkeypatch.setattr(variants, "TILE", 7)
    import numpy as np

    words = sorted({f"{a}{b}{c}" for a in "ab" for b in "abc" for c in ("", "x", "yy", "\U0001f600")})
    keys = np.zeros(len(words), dtype=np.int64)
    for m in range(1, 5):
        mine = [w for w in words if len(w) in (m, m - 1)]
        k, full = keys[: len(mine)], np.full(len(mine), m)
        i, j = variants.near_pairs(mine, k, full, full * 0, full - 1)
        want = {frozenset((a, b)) for a in mine for b in mine if edits(a, b) and max(len(a), len(b)) == m}
        assert {frozenset((mine[a], mine[b])) for a, b in zip(i, j)} == want and len(i) == len(want)


def test_variants_of_few_and_none(spark):
    assert variants.count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    rows = spark.createDataFrame([("", 5), (None, 4), ("a", 9), ("b", 2)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"], r["root"]) for r in variants.group_variants(rows).collect()}
    assert got == {"": (0, None, ""), None: (0, None, None), "a": (1, None, "a"), "b": (1, "a", "a")}


# Merkle manifest


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return hexed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climbed(level):
    """The root and, for each leaf, (place, siblings) of every run on the way."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, a in enumerate(at):
            run = runs[a // 3]
            paths[k].append((a % 3, run[: a % 3] + run[a % 3 + 1 :]))
        level, at = [hexed(*r) for r in runs], [a // 3 for a in at]
    return level[0], paths


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        mine = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees.append((mine, *climbed([leaf_of(*r) for r in mine])))
    root, tops = climbed([t[1] for t in trees])
    for (mine, subroot, paths), top in zip(trees, tops):
        for r, path in zip(mine, paths):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf_of(*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for at, others in path + top:
                now = hexed(*others[:at], now, *others[at:])
            yield (r[0], leaf_of(*r), subroot, root, hexed(*[x for _, others in path + top for x in others]), now, now == root)


def written(spark, rows, path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path string, subroot int").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("rows_together", [40, merkle.ROWS_TOGETHER])
def test_manifest_as_by_the_book(spark, tmp_path, monkeypatch, rows_together):
    monkeypatch.setattr(merkle, "ROWS_TOGETHER", rows_together)
    rng = random.Random(12)
    rows = [(i, rng.choice(["hot"] * 5 + ["é", "z", None]), rng.choice(["en", None]), rng.randrange(9), f"line {i}\nnext\n") for i in range(700)]
    rows += [(1000, "alone", None, None, None), (1001, "", "de", 0, ""), (None, "hot", "en", 3, "no\nid"), (None, "hot", "en", 3, "no\nid"), (5, "hot", "en", 1, "an id again"), *[(6, "hot", "en", 1, "a row again\n")] * 4]
    got = [tuple(r) for r in merkle.op12_merkle(spark, written(spark, rows, tmp_path)).collect()]
    want = list(manifest(rows))
    assert Counter(got) == Counter(want) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 81, 82])
def test_manifests_of_few(spark, tmp_path, n):
    rows = [(i, "only", "en", 1, f"a{i}\nb") for i in range(n)]
    got = [tuple(r) for r in merkle.op12_merkle(spark, written(spark, rows, tmp_path)).collect()]
    assert Counter(got) == Counter(manifest(rows) if rows else [])
    assert n != 1 or got[0][4] == hashlib.sha256(b"").hexdigest()


def test_proofs_keep_columns(spark):
    df = cut(spark.createDataFrame([("g", 2, hexed("b"), "v2", 7), ("g", 1, hexed("a"), "v1", 8)], "group string, key int, leaf string, row string, path int"), "t")
    got = merkle.merkle_proofs(df, "group", "key", "leaf")
    assert got.columns == ["group", "key", "leaf", "row", "subroot", "root", "path"]
    rows = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert {r["row"] for r in rows} == {"v1", "v2"} and {r["folded"] for r in rows} == {hexed(hexed("a"), hexed("b"))}


# web archives


def odd_pages():
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abc <>é数\r\n&") for _ in range(n))
    twin, edge = text(400), "x" * 100
    rows = [(i, f"http://h/{i}", f"<html><body>{text(rng.randrange(2000))}</body></html>") for i in range(120)]
    rows += [(900, "http://h/é b\r\nEvil: yes", twin), (300, None, twin), (300, "http://h/again", twin), (None, "http://h/none", twin), *[(400 + i, "u", edge) for i in range(40)]]
    rows += [(500, "u", "x" * 99), (501, "u", "x" * 99), (502, "u", None), (503, "u", ""), (None, None, text(150)), (504, "u", "WARC/1.1\r\n\r\n" * 50), (505, "u", text(2_000_00))]
    return rows


def described(rows):
    groups = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100:
            groups.setdefault(html, []).append(i)
    firsts = {h: min(ids, key=lambda x: (x is None, x or 0)) for h, ids in groups.items()}
    seen, out = set(), []
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = html in seen
        if html in groups:
            seen.add(html)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", firsts[html] if again else None))
    return out


def pages_at(spark, path, rows):
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_id string").repartition(4).write.parquet(f"{path}/pages.parquet")
    return spark.read.parquet(f"{path}/pages.parquet")


def test_pages_come_back_from_archives(spark, tmp_path):
    rows = odd_pages()
    pages_at(spark, tmp_path, rows)
    got = [tuple(r) for r in registry.queries()["op13_warc"](spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(described(rows))


def test_payloads_and_files(spark, tmp_path):
    rows = odd_pages()
    pages = pages_at(spark, tmp_path, rows)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/out", "page_id", "url", "html", bytes_together=30_000)
    assert manifest.count() > 3 and sum(r["records"] for r in manifest.collect()) == len(rows)
    back = warc.read_archives(manifest, payloads=True).collect()
    ids = {r["record_id"]: r for r in back}
    assert len(ids) == len(rows) and len({(r["archive"], r["offset"]) for r in back}) == len(rows)
    whole = lambda r: r["payload"] if r["record_type"] == "response" else ids[r["refers_to_id"]]["payload"]
    assert Counter((r["key"], whole(r).decode()) for r in back) == Counter((i, h or "") for i, _, h in rows)
    for f in sorted((tmp_path / "out").iterdir()):
        data = f.read_bytes()
        assert not f.name.startswith(".") and data[:4] == (0x184D2A5D).to_bytes(4, "little")
        end = 8 + int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:end]))
        text = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data[end:], read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n") and b"\r\nEvil:" not in text


def test_damage_is_found():
    row = {"record_type": "response", "record_id": "r", "url": "u", "key": 1, "payload_bytes": 3, "payload_digest": hashlib.sha256(b"abc").hexdigest(), "refers_to_id": None, "refers_to_url": None}
    record = warc.page_record(row, b"abc", "1970-01-01T00:00:00Z")
    data = warc.archive_bytes([record])
    (_, raw), = warc.archive_frames(data)
    assert raw == record and warc.indexed(*warc.parsed(raw))[0]["key"] == 1
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(record.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="digest"):
        warc.indexed(*warc.parsed(warc.page_record(row, b"abd", "x")))
    with pytest.raises(ValueError, match="whole"):
        warc.parsed(record[:-1])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.archive_frames(data[:-3]))
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.archive_frames(record))
    flipped = bytearray(data)
    flipped[-2] ^= 1
    with pytest.raises(zstandard.ZstdError):
        list(warc.archive_frames(bytes(flipped)))


def test_no_pages(spark, tmp_path):
    pages_at(spark, tmp_path, [])
    assert registry.queries()["op13_warc"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op11_spelling", "op12_merkle", "op13_warc"])
def test_sql_gives_the_same(spark, name):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracles()[name])
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[k] for c, k in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
