r"""Legacy archive converter: ARC files of either version in, WARC 1.1 files out, and a reader of both.

An ARC file starts with a version block; its first number says which header line the records have: five fields in version 1 (URL, IP
address, date, content type, length), ten in version 2 (result code, checksum, location, offset and file name before the length). A
record's block is as long as declared; one that ends early is kept and marked truncated. The WARC record gets a name-based UUID of what
identifies it (URL, date, digest, file and offset), a W3C timestamp, a type (warcinfo, resource, response or revisit) and SHA-1 digests
in base32. Of responses with equal payloads the one of the greatest key stays; the others become revisits without payload.

Files are written by Spark's text sink: a row is a record and the separator is what ends a record in the format, so blocks keep their
bytes. They are gzip files, one to a task, read back as whole files; size them by the partitions of the input. Null payloads are empty,
null and blank URLs become ``about:blank``, blanks in URLs are escaped, repeated rows give records of their own. An empty table writes
empty folders.
"""

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from gavelwork.llm.common import stored
from gavelwork.session import shared_folder

ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
KEY_HEADER = "X-Page-Id"
FAST = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def digest_of(data):
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _first_in_file():
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0


def write_arc(records, path):
    """``records``: url, ip, date (14 digits), content_type, status, block (string). Files alternate between the two header versions."""
    version = (F.spark_partition_id() % 2 + 1).cast("string")
    body = F.concat(version, F.lit(" 0 gavelwork\n"), F.when(version == "1", ARC_FIELDS[1]).otherwise(ARC_FIELDS[2]), F.lit("\n"))
    name = F.format_string("part-%05d.arc", F.spark_partition_id())
    extra = F.when(version == "1", "").otherwise(F.concat(F.col("status").cast("string"), F.lit(" - - 0 "), name, F.lit(" ")))
    head = F.when(version == "1", "").otherwise(F.concat(F.lit("200 - - 0 "), name, F.lit(" ")))
    block = F.concat(F.lit("filedesc://"), name, F.lit(" 0.0.0.0 20000101000000 text/plain "), head, F.octet_length(body).cast("string"), F.lit("\n"), body, F.lit("\n"))
    line = F.concat(F.concat_ws(" ", "url", "ip", "date", "content_type"), F.lit(" "), extra, F.octet_length("block").cast("string"), F.lit("\n"), F.col("block"))
    rows = records.select(F.concat(F.when(_first_in_file(), block).otherwise(""), line).alias("value"))
    rows.write.options(lineSep="\n", **FAST).text(path)


def arc_records(f, name=""):
    """Dicts of one ARC stream: file, offset, version, url, ip, date, content_type, status, block, truncated."""
    version, at = 1, 0
    while line := f.readline():
        begin, at = at, at + len(line)
        fields = line.rstrip(b"\r\n").split(b" ")
        if len(fields) < 5:
            if fields == [b""]:
                continue
            raise ValueError(f"{name}: no record header at {begin}")
        size = int(fields[-1])
        block = f.read(size)
        at += len(block)
        if fields[0].startswith(b"filedesc:"):
            version = int(block.split(b" ", 1)[0])
        tail = {1: 4, 2: 9}[version] if len(fields) >= {1: 5, 2: 10}[version] else 4
        url, rest = b" ".join(fields[:-tail]), [x.decode("latin-1") for x in fields[-tail:]]
        yield {"file": name, "offset": begin, "version": version, "url": url.decode("utf-8", "replace"), "ip": rest[0], "date": rest[1], "content_type": rest[2], "status": rest[3] if tail == 9 else None, "block": block, "truncated": len(block) < size}


def http_parts(block):
    """(headers by lower-case name, length of the head) of an HTTP message; (None, 0) for other blocks."""
    if not block.startswith(b"HTTP/"):
        return None, 0
    end = block.find(b"\r\n\r\n")
    end = len(block) if end < 0 else end + 4
    lines = block[:end].decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if _}, end


def converted(record):
    """What the WARC record of an ARC record says, before revisits are told from responses."""
    url, block = record["url"], record["block"]
    headers, head = http_parts(block)
    kind = "warcinfo" if url.startswith("filedesc:") else "response" if headers is not None else "resource"
    mime = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(kind) or ("text/dns" if url.startswith("dns:") else record["content_type"])
    if kind == "warcinfo":
        block = f"software: gavelwork\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {record['version']}\r\n".encode()
    day = record["date"].ljust(14, "0") if len(record["date"]) > 8 else record["date"] + "000000"
    date = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
    digest = digest_of(memoryview(block)[head:])
    name = f"{url} {record['date']} {digest} {record['file']}:{record['offset']}"
    key = (headers or {}).get(KEY_HEADER.lower())
    return {"kind": kind, "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, name)), "url": url, "date": date, "ip": record["ip"], "mime": mime, "payload_digest": digest, "block_digest": digest if not head else digest_of(block), "head": head, "payload_bytes": len(block) - head, "key": int(key) if key else None, "truncated": record["truncated"], "block": block}


CONVERTED = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("head", pa.int64()), ("payload_bytes", pa.int64()), ("key", pa.int64()), ("truncated", pa.bool_()), ("block", pa.binary())])


def _batched(rows, schema, limit=4_000_000):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("block") or r.get("payload") or b"") + 200
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _opened(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            data = io.BytesIO(content.as_buffer())
            yield path.rsplit("/", 1)[-1], gzip.open(data) if path.endswith(".gz") else data


def _files(spark, path):
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark, path, blocks=True):
    """Converted records of a folder of ARC files; without their blocks where only identities and digests are asked for."""

    def run(batches):
        rows = (converted(r) for name, f in _opened(batches) for r in arc_records(f, name))
        yield from _batched(rows if blocks else (r | {"block": None} for r in rows), CONVERTED)

    return _files(spark, path).mapInArrow(run, "kind string, record_id string, url string, date string, ip string, mime string, payload_digest string, block_digest string, head long, payload_bytes long, key long, truncated boolean, block binary")


def with_revisits(spark, arc_path, least_bytes=0):
    """Converted records with ``refers_id`` and ``refers_key``: set for responses whose payload (of ``least_bytes`` at least) another keeps."""
    same = read_arc(spark, arc_path, blocks=False).where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
    first = same.groupBy(F.col("payload_digest").alias("d")).agg(F.count("*").alias("n"), F.max(F.struct(F.col("key"), F.col("record_id"))).alias("kept"))
    first = stored(first.where("n > 1").select("d", F.col("kept.key").alias("kept_key"), F.col("kept.record_id").alias("kept_id")), "payloads")
    rows = read_arc(spark, arc_path)
    rows = rows.join(first, (F.col("payload_digest") == F.col("d")) & (F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes), "left")
    again = F.col("kept_id").isNotNull() & (F.col("kept_id") != F.col("record_id"))
    return rows.withColumns({"kind": F.when(again, "revisit").otherwise(F.col("kind")), "refers_id": F.when(again, F.col("kept_id")), "refers_key": F.when(again, F.col("kept_key"))}).drop("d", "kept_key", "kept_id")


def write_warc(rows, path):
    """Write rows of ``with_revisits`` as WARC files; a revisit keeps the HTTP head of its response as block."""
    again = F.col("kind") == "revisit"
    text = F.col("block").cast("string")
    block = F.when(again, F.expr("CAST(substring(block, 1, CAST(head AS INT)) AS STRING)")).otherwise(text)
    field = lambda name, value, when=F.lit(True): F.when(when, F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("kind")), field("WARC-Record-ID", F.format_string("<urn:uuid:%s>", "record_id")), field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("url"), F.col("kind") != "warcinfo"), field("WARC-IP-Address", F.col("ip"), F.col("kind") != "warcinfo"),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("kind").isin("response", "revisit")), field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_digest")), ~again),
        field("WARC-Truncated", F.lit("length"), F.col("truncated")), field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), again),
        field("WARC-Refers-To", F.format_string("<urn:uuid:%s>", "refers_id"), again), field("X-Refers-To-Page-Id", F.col("refers_key").cast("string"), again & F.col("refers_key").isNotNull()),
        field("Content-Type", F.col("mime")), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    rows.select(F.concat(head, block).alias("value")).write.options(lineSep="\r\n\r\n", **FAST).text(path)


def warc_records(f, name=""):
    """(header fields by lower-case name, block) of one WARC stream."""
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record where one should start: {line[:40]!r}")
        fields = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, f.read(int(fields["content-length"]))


READ = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("url", pa.string()), ("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_id", pa.string()), ("refers_key", pa.int64()), ("payload", pa.binary())])


def read_warc(spark, path, payloads=False):
    """Records of a folder of WARC files. Digests of responses are of the bytes read, and must be those that the record names."""

    def rows(batches):
        for name, f in _opened(batches):
            for fields, block in warc_records(f, name):
                kind, bare = fields["warc-type"], lambda k: (fields.get(k) or "").strip("<>").removeprefix("urn:uuid:") or None  # noqa: B023
                headers, head = http_parts(block)
                named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                size, digest = (int(headers["content-length"]), named) if kind == "revisit" else (len(block) - head, digest_of(memoryview(block)[head:]))
                if kind == "response" and digest != named:
                    raise ValueError(f"{name}: payload digest of {fields['warc-record-id']} differs")
                key, other = (headers or {}).get(KEY_HEADER.lower()), fields.get("x-refers-to-page-id")
                yield {"record_type": kind, "record_id": bare("warc-record-id"), "date": fields["warc-date"], "url": fields.get("warc-target-uri"), "key": int(key) if key else None, "payload_bytes": size, "payload_digest": digest, "refers_id": bare("warc-refers-to"), "refers_key": int(other) if other else None, "payload": block[head:] if payloads else None}

    return _files(spark, path).mapInArrow(lambda batches: _batched(rows(batches), READ), "record_type string, record_id string, date string, url string, key long, payload_bytes long, payload_digest string, refers_id string, refers_key long, payload binary")


def page_records(pages):
    """ARC records of (page_id, url, html): HTTP responses captured a second apart from the year 2000 on."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    page = F.col("page_id").cast("long")
    key = F.when(page.isNotNull(), F.concat(F.lit(KEY_HEADER + ": "), page.cast("string"), F.lit("\r\n"))).otherwise("")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"), key, F.lit("\r\n"), html)
    date = F.date_format(F.timestamp_seconds(946684800 + F.pmod(F.coalesce(page, F.lit(0)), F.lit(10**9))), "yyyyMMddHHmmss")
    return pages.select(F.when(url == "", "about:blank").otherwise(url).alias("url"), F.lit("192.0.2.1").alias("ip"), date.alias("date"), F.lit("text/html").alias("content_type"), F.lit(200).alias("status"), block.alias("block"))


def round_trip(pages):
    """Pages as ARC files, converted to WARC files, read back: one row per page."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(page_records(pages), arc)
    write_warc(with_revisits(spark, arc), warc)
    out = read_warc(spark, warc).where(F.col("record_type").isin("response", "revisit"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").alias("refers_to"), "record_id", "url", F.col("date").alias("warc_date"))
