"""Op 13, web archives: WARC files whose records are compressed one by one with a dictionary of the archive.

Pages are dealt to archives by a hash of where they are stored, so that each holds about ARCHIVE_BYTES. One task
writes an archive: the dictionary is trained on all its records and goes in front, in a skippable frame; every
record is a Zstandard frame of its own. Pages whose payload an earlier page has become revisit records, which hold
no payload. Archives are read back where they lie, record by record, and every digest is checked.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collect_garbage, cut, give_back, named, shared_dir, table
from .sharding import stored_address

#: Bytes of payload in an archive, of its dictionary at most, and of the payload from which a copy is a revisit.
ARCHIVE_BYTES, DICTIONARY_BYTES, REVISIT_BYTES = 32 << 20, 110 << 10, 100
#: Parameters of the dictionary's training and the level of compression.
SEGMENT, GRAM, LEVEL = 200, 8, 3
#: Bytes that a reader hands to the decompressor at once; rows of a batch that it returns, and their bytes.
READ_BYTES, BATCH_ROWS, BATCH_BYTES = 16 << 10, 2048, 8 << 20

# Fixed values of the WARC and Zstandard formats
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"

MANIFEST = "archive string, records long, payload_bytes long, archive_bytes long"
INDEX = "archive string, offset long, record_type string, record_id string, url string, key long, payload_bytes long, payload_digest string, refers_to_id string"


def described(pages: DataFrame, key: str, url: str, payload: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(record_id, key, url, payload_bytes, payload_digest, record_type, refers_to_id, refers_to_url) of every page.

    ``pages`` is read from files; rows are told apart by where they are stored. Of equal payloads of revisit_bytes
    or more the page of the smallest key is the response, null keys last, and of rows that share it one.
    """
    key, url, payload = named(key, url, payload)
    text = F.coalesce(payload.cast("string"), F.lit(""))
    rows = cut(pages.select(record_id().alias("record_id"), key.cast("long").alias("key"), url.cast("string").alias("url"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha2(text, 256).alias("payload_digest")), "pages")
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "record_id", "url")).alias("first")
    firsts = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy(F.col("payload_digest").alias("digest")).agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("digest", "first")
    is_copy = F.coalesce(F.col("record_id") != F.col("first.record_id"), F.lit(False))
    met = rows.join(firsts, rows["payload_digest"] == F.col("digest"), "left")
    return met.select(*rows.columns, F.when(is_copy, "revisit").otherwise("response").alias("record_type"), F.when(is_copy, F.col("first.record_id")).alias("refers_to_id"), F.when(is_copy, F.col("first.url")).alias("refers_to_url"))


def record_id():
    """A UUID of where a row is stored: the same in every attempt of a task."""
    h = F.md5(F.concat_ws("#", *[a.cast("string") for a in stored_address()]).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A WARC record; fields that are None are left out, line breaks and other controls in values are escaped."""
    fields = {"WARC-Type": kind} | fields | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    plain = lambda v: v if v.isprintable() else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in v)
    head = "".join(f"{name}: {plain(value)}\r\n" for name, value in fields.items() if value is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def page_record(row: dict, payload: bytes, date: str) -> bytes:
    """The response or revisit record of a page; a revisit keeps the head of the answer and leaves out its payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    again, name = row["record_type"] == "revisit", lambda x: x and f"<urn:uuid:{x}>"
    fields = {
        "WARC-Record-ID": name(row["record_id"]), "WARC-Date": date, "WARC-Target-URI": row["url"], "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}", "Page-ID": None if row["key"] is None else str(row["key"]),
        "WARC-Profile": PROFILE if again else None, "WARC-Refers-To": name(row["refers_to_id"]), "WARC-Refers-To-Target-URI": row["refers_to_url"],
    }
    return record(row["record_type"], fields, head if again else head + payload)


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on all the records; where they are too few for that, their beginnings are the dictionary."""
    size = max(1024, min(DICTIONARY_BYTES, sum(map(len, records)) // 64))
    try:
        return zstandard.train_dictionary(size, records, k=SEGMENT, d=GRAM)
    except zstandard.ZstdError:
        share = max(64, size // len(records))
        return zstandard.ZstdCompressionDict(b"".join(r[:share] for r in records)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive: its dictionary in a leading skippable frame, then each record as a frame."""
    trained = dictionary(records)
    trained.precompute_compress(level=LEVEL)
    embedded = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
    one = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    return b"".join([SKIPPABLE.to_bytes(4, "little"), len(embedded).to_bytes(4, "little"), embedded, *map(one.compress, records)])


def archive_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every frame of an archive, decompressed with the dictionary in its first."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary leads the archive")
    at = 8 + int.from_bytes(data[4:8], "little")
    held = data[8:at]
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held) if held[:4] == FRAME else held)
    context, view = zstandard.ZstdDecompressor(dict_data=known), memoryview(data)
    while at < len(data):
        frame, parts, to = context.decompressobj(), [], at
        while not frame.eof:
            if to >= len(data):
                raise ValueError(f"the frame at {at} is cut short")
            parts.append(frame.decompress(view[to : to + READ_BYTES]))
            to = min(to + READ_BYTES, len(data))
        yield at, b"".join(parts)
        at = to - len(frame.unused_data)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of a record, whose length, end and block digest must be right."""
    end = data.index(b"\r\n\r\n") + 4
    version, *lines = data[: end - 4].decode().split("\r\n")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = data[end : end + int(fields["content-length"])]
    if version != VERSION or data[end + len(block) :] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
        raise ValueError("not a whole WARC record")
    if (told := fields.get("warc-block-digest")) and told != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{fields.get('warc-record-id')}: the block differs from its digest")
    return fields, block


def indexed(fields: dict[str, str], block: bytes) -> tuple[dict, bytes]:
    """What the index holds of a page's record, and its payload; a response's payload must have its digest."""
    end = block.index(b"\r\n\r\n") + 4
    head, payload = block[:end].decode(), block[end:]
    told, bare = fields["warc-payload-digest"].removeprefix("sha256:"), lambda x: x and x.removeprefix("<urn:uuid:").removesuffix(">")
    again = fields["warc-type"] == "revisit"
    if not again and hashlib.sha256(payload).hexdigest() != told:
        raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
    length = next(int(x.partition(":")[2]) for x in head.split("\r\n") if x.lower().startswith("content-length:"))
    key = fields.get("page-id")
    return {
        "record_type": fields["warc-type"], "record_id": bare(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "key": None if key is None else int(key),
        "payload_bytes": length if again else len(payload), "payload_digest": told, "refers_to_id": bare(fields.get("warc-refers-to")),
    }, payload


def write_archives(pages: DataFrame, path: str, key: str, url: str, payload: str, date: str = "1970-01-01T00:00:00Z", bytes_together: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every page to archives in ``path``, a shared folder; returns the manifest of the archives.

    A null payload is empty, a null url or key has no field. ``date`` is the time of capture. An archive of a lost
    task stays a hidden file or is replaced by an equal one; the manifest names those that count. An empty table has none.
    """
    rows = cut(described(pages, key, url, payload), "described")
    total = rows.agg(F.sum(F.col("payload_bytes") + 512)).first()[0] or 0
    bucket = F.pmod(F.xxhash64("record_id"), F.lit(max(1, math.ceil(total / bytes_together)))).alias("bucket")
    bodies = pages.select(record_id().alias("record_id"), F.coalesce(named(payload)[0].cast("string"), F.lit("")).cast("binary").alias("payload"))
    both = rows.select(bucket, "*", F.lit(None).cast("binary").alias("payload")).unionByName(bodies.select(bucket, "*"), allowMissingColumns=True)

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by("record_id").combine_chunks()
        is_body = pc.is_valid(group["payload"])
        bodies, rows = group.filter(is_body)["payload"], group.filter(pc.invert(is_body)).drop_columns(["payload"]).to_pylist()
        name = f"archive-{rows[0]['bucket']:08d}.warc.zst"
        info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
        data = archive_bytes([info, *[page_record(row, body.as_buffer().to_pybytes(), date) for row, body in zip(rows, bodies, strict=True)]])
        system, folder = pafs.FileSystem.from_uri(path)
        system.create_dir(folder)
        with system.open_output_stream(part := f"{folder}/.{name}-{uuid.uuid4().hex}", compression=None) as out:
            out.write(data)
        system.move(part, f"{folder}/{name}")
        told = pa.table({"archive": [f"{path}/{name}"], "records": [len(rows)], "payload_bytes": [sum(r["payload_bytes"] for r in rows)], "archive_bytes": [len(data)]})
        del group, bodies, rows, data
        give_back()
        return told

    return cut(both.groupBy("bucket").applyInArrow(write, MANIFEST), "archives", release=True)


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The index of the archives' pages: a row for each response and revisit; with ``payloads`` what responses hold too.

    An archive that is damaged, or whose record differs from its digests, ends the job.
    """
    kinds = {"archive": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "url": pa.string(), "key": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to_id": pa.string()}
    schema = pa.schema([*kinds.items(), *([("payload", pa.binary())] if payloads else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = pafs.FileSystem.from_uri(archive)
                with system.open_input_stream(path, compression=None) as source:
                    data = source.readall()
                rows, held = [], 0
                for offset, raw in archive_frames(data):
                    fields, block = parsed(raw)
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    row, payload = indexed(fields, block)
                    rows.append({"archive": archive, "offset": offset} | row | ({"payload": payload if row["record_type"] == "response" else None} if payloads else {}))
                    held += len(payload) if payloads else 0
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                del data
        give_back()

    n = max(1, manifest.count())
    spark = manifest.sparkSession
    each = manifest.select("archive").repartition(min(n, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return each.mapInArrow(read, f"{INDEX}, payload binary" if payloads else INDEX)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back from them.

    Null html is an empty payload. Pages that share a page_id are records each; copies of one payload refer to the
    smallest page_id among them, null if none has one.
    """
    manifest = write_archives(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", "page_id", "url", "html")
    index = cut(read_archives(manifest), "index")
    collect_garbage(spark)
    responses, revisits = index.where("record_type = 'response'"), index.where("record_type = 'revisit'")
    there = responses.select(F.col("record_id").alias("there"), F.col("key").alias("refers_to"))
    columns = [F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.join(there, F.col("refers_to_id") == F.col("there"), "left").select(*columns))


OP13_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), r AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest, first_value(page_id) OVER w AS first_id, row_number() OVER w AS place FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST)
) SELECT page_id, payload_bytes, payload_digest, CASE WHEN place > 1 AND payload_bytes >= {REVISIT_BYTES} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN place > 1 AND payload_bytes >= {REVISIT_BYTES} THEN first_id END AS refers_to FROM r"""
