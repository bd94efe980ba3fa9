"""A deterministic sharded WARC writer and its reader.

Records are sorted by id within ranges of ids of about equal bytes (a range is a shard); a shard's file ends when its
compressed size reaches ``roll_bytes``.  Every record's headers and digests are made anew from id, address and payload,
so the archives depend on the rows and parameters alone.  A task writes each file under a name of its own attempt
and moves it to its final name; the manifest, itself a table that Spark commits, lists what was finished, and readers
open nothing else; what failed attempts left goes when the manifest stands.  A task that runs again writes the same bytes under the
same final name.  Each file opens with a warcinfo record; a revisit refers to its response by record id and date.

Of records with equal payloads of at least ``revisit_bytes`` that with the largest id is a response and the others
revisit it; rows tied at the largest id are responses all.  Null payloads are empty; null ids sort first and never win over
others; an empty table gives an empty manifest; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import IdShards, bounded_batches, discard, remove, shared_dir, shuffle_width, stored

#: The time that all records state; a parameter, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of addresses (fixed value)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
MANIFEST = "shard int, part int, path string, records long, bytes long, sha256 string"


def record_id(id_: int | None, digest: str) -> str:
    """From the row's id and payload alone, so a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{id_} {digest}')}>"


def _sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def info(name: str, date: str = DATE) -> bytes:
    """The record that opens a file."""
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(id_: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not compressed.  A revisit holds the reply's headers alone."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    digest = _sha1(payload)
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = reply if refers_to is not None else reply + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(id_, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"X-Row-Id: {'' if id_ is None else id_}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Row-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != _sha1(block):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return fields, block


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(df: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, shard_bytes: int = 256 << 20, roll_bytes: int = 16 << 20, date: str = DATE) -> DataFrame:
    """Writes the archives below ``out`` and returns the committed manifest.

    A shard holds shard_bytes of payloads, a file about roll_bytes after compression, so a shard is several files.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    size = F.octet_length("payload").cast("long")

    # which rows revisit which: narrow, aggregated before it is joined
    digests = stored(rows.select("id", size.alias("n"), F.sha1(F.encode("payload", "UTF-8")).alias("digest")), "digests")
    long_ = digests.where(f"n >= {revisit_bytes}")
    groups = long_.groupBy("digest", "n").agg(F.max("id").alias("last"), F.min("id").alias("least"), F.count("*").alias("k")).where("k > 1 and last is not null")
    revisits = long_.join(groups.select("digest", "n", "last"), ["digest", "n"]).where("id is null or id < last").select("id", "digest", "last").distinct()

    total = digests.agg(F.sum("n")).first()[0] or 0
    shards = IdShards(digests, "id", F.col("n") + 500, max(shuffle_width(spark), -(-total // shard_bytes)))
    none = F.lit(None).cast("string")
    both = revisits.select("id", none.alias("url"), none.alias("payload"), "digest", "last").unionByName(rows.select("id", "url", "payload", none.alias("digest"), F.lit(None).cast("long").alias("last")))
    dealt = shards.assign(both).repartitionById(shards.n, "shard_").sortWithinPartitions("shard_", F.asc_nulls_first("id"), F.asc_nulls_last("digest"), "url", "payload").select("shard_", "id", "url", "payload", "digest", "last")

    def run(batches):
        import pyarrow as pa

        done, at, known, own = [], None, {}, None
        for b in batches:
            col = [c.to_pylist() for c in b.columns]
            for shard, id_, url, payload, digest, last in zip(*col):
                if at != (shard, id_):
                    at, known = (shard, id_), {}
                if digest is not None:
                    known[digest] = last
                    continue
                if own is None or own.shard != shard or own.bytes >= roll_bytes:
                    if own is not None:
                        done.append(own.close())
                    own = _Part(out, shard, own.part + 1 if own is not None and own.shard == shard else 0, date)
                raw = payload.encode()
                own.add(record(id_, url, raw, known.get(hashlib.sha1(raw).hexdigest()) if known else None, date))
        if own is not None:
            done.append(own.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) if k > 1 else pa.array(c, pa.int32()) for k, c in enumerate(zip(*done))], ["shard", "part", "path", "records", "bytes", "sha256"])

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{out}/manifest")
    remove(spark, f"{out}/_tmp")
    discard(digests)
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


class _Part:
    """One archive file in the making, under a name of this attempt."""

    def __init__(self, out: str, shard: int, part: int, date: str):
        self.shard, self.part, self.records, self.bytes, self.sha = shard, part, 0, 0, hashlib.sha256()
        name = f"shard-{shard:05d}-{part:05d}.warc.gz"
        self.path = f"{out}/{name}"
        self.temporary = f"{out}/_tmp/{uuid.uuid4().hex}"
        self.fs, self.place = _file_system(self.temporary)
        self.fs.create_dir(self.place.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.place, compression=None)
        self.write(info(name, date))

    def add(self, raw: bytes) -> None:
        self.write(raw)
        self.records += 1

    def write(self, raw: bytes) -> None:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = c.compress(raw) + c.flush()
        self.file.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def close(self) -> tuple:
        self.file.close()
        self.fs.move(self.place, _file_system(self.path)[1])
        return self.shard, self.part, self.path, self.records, self.bytes, self.sha.hexdigest()


def read(manifest: DataFrame) -> DataFrame:
    """The records of all files of a manifest: id, url, record_type, payload_bytes, payload_digest (hexadecimal), refers_to, payload."""
    files = manifest.select("path", "sha256").repartition(shuffle_width(manifest.sparkSession), "path")

    def run(batches):
        import pyarrow as pa

        names = ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for b in batches:
            for path, sha in zip(*(c.to_pylist() for c in b.columns)):
                fs, place = _file_system(path)
                whole, rows, held = hashlib.sha256(), [], 0
                with fs.open_input_stream(place, compression=None) as f:
                    for raw in _members(f, whole):
                        h, block = _parsed(raw)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        reply, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        revisit = h["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
                        n = int(reply.rpartition(b"Content-Length: ")[2])
                        rows.append((int(h["X-Row-Id"]) if h["X-Row-Id"] else None, h["WARC-Target-URI"], h["WARC-Type"], n, digest, int(h["X-Refers-To-Row-Id"]) if revisit else None, None if revisit else payload.decode()))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays(_arrays(rows, pa), names)
                            rows, held = [], 0
                if whole.hexdigest() != sha:
                    raise ValueError(f"{path} is not the file of the manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays(_arrays(rows, pa), names)

    return files.mapInArrow(run, "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string")


def _arrays(rows, pa):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]


def _members(f, whole):
    """The uncompressed gzip members of a stream, one at a time."""
    rest, d, parts = b"", zlib.decompressobj(31), []
    while True:
        if not rest:
            rest = f.read(1 << 16)
            if not rest:
                break
            whole.update(rest)
        parts.append(d.decompress(rest))
        rest = b""
        if d.eof:
            rest = d.unused_data
            yield b"".join(parts)
            d, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends within a record")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"))
    return read(manifest).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest AS d, payload_bytes AS b, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last > page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON d = payload_digest AND b = payload_bytes
"""
