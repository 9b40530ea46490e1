"""WARC archives: one gzip member for each record, written in parts and read in sequence.

The reader inflates a stream step by step, frames each record by its content length and
holds digests against the bytes. It keeps one record in memory, and no whole archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_path, settle

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed time, so that a task that runs again writes the same bytes.
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format, or whose digest or length doesn't hold."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(kind: str, record_id: str, uri: str | None, block: bytes, payload_digest: str, refers_to: str | None = None, level: int = 6) -> bytes:
    """A record as one gzip member."""
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    head.append(f"WARC-Block-Digest: sha1:{sha1_base32(block)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _members(stream: BinaryIO, step: int) -> Iterator[bytes]:
    """The inflated bytes of each gzip member, in the order of the stream."""
    data, z, out = b"", zlib.decompressobj(31), bytearray()
    started = False
    while True:
        if not data:
            data = stream.read(step)
            if not data:
                if started:
                    raise WarcError("the archive ends within a record")
                return
        started = True
        try:
            out += z.decompress(data)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        data = z.unused_data
        if z.eof:
            yield bytes(out)
            z, out, started = zlib.decompressobj(31), bytearray(), False


def read_records(stream: BinaryIO, *, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, in order.

    The block is framed by Content-Length and must be followed by two line ends and the
    end of the member. The block digest must hold, and for records that aren't revisits
    the payload digest too. What doesn't hold raises WarcError.
    """
    for raw in _members(stream, step):
        end = raw.find(b"\r\n\r\n")
        if end < 0 or not raw.startswith(b"WARC/"):
            raise WarcError("no record header")
        head = {}
        for line in raw[:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        try:
            size = int(head["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no content length") from e
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
            raise WarcError("the record isn't as long as its content length says")
        digest = f"sha1:{sha1_base32(block)}"
        if head.get("warc-block-digest", digest) != digest or (head.get("warc-type") != "revisit" and head.get("warc-payload-digest", digest) != digest):
            raise WarcError(f"digest of {head.get('warc-record-id')}")
        yield head, block


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: object, payload_digest: str, place: int) -> str:
    """The digest tells payloads under one page id apart, and ``place`` rows with one id and payload. The id is percent-encoded, so that any text is
    one; a null id is a tilde, which an encoded id never is."""
    said = "~" if page_id is None else quote(str(page_id), safe="").replace("~", "%7E")
    return f"urn:page:{said}:{payload_digest}:{place}"


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Write a record for each row under ``folder`` and return (path, records) of the archives.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at
    least ``min_revisit`` bytes, that with the largest page id is the response and the others
    revisit it; of rows with that id and payload, the first by url. A null id is less than
    any other; an id may be any text. Equality is that of length, SHA-1 and SHA-256.

    Rows equal in id and payload are numbered when they are written to the shared folder, not within
    their group, so a group of any size, such as that of empty pages without id, is in many tasks.

    Each task writes one archive under a name of its own; only tasks that ended are in
    the manifest, which is a written table, so a task that was lost and ran again leaves
    no record twice. ``folder`` must be a uri that pyarrow opens on all executors.
    """
    spark = pages.sparkSession
    id_, url = F.col(f"`{id_col}`"), F.col(f"`{url_col}`")
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = settle(pages.select(id_.alias("id"), url.alias("url"), html.alias("html")), sha=F.sha1("html"), sha256=F.sha2("html", 256), size=F.octet_length("html").cast("long"))
    same = ["sha", "sha256", "size"]
    groups = rows.select("id", *same).groupBy("id", *same).agg(F.count(F.lit(1)).alias("n"))
    lead = materialise(groups.groupBy(*same).agg(F.max("id").alias("lead")), "warc-lead")
    repeated = materialise(groups.where("n > 1").select("id", *same), "warc-repeated")
    plain = rows.withColumn("place", F.lit(0).cast("long"))
    if not repeated.isEmpty():
        on = [rows["id"].eqNullSafe(repeated["id"]), *[rows[c] == repeated[c] for c in same]]
        once = rows.join(repeated, on, "left_anti").withColumn("place", F.lit(0).cast("long"))
        many = materialise(rows.join(repeated, on, "left_semi").withColumn("number", F.monotonically_increasing_id()), "warc-many")
        first = materialise(many.groupBy("id", *same).agg(F.min(F.struct("url", "number")).alias("first")).select("id", *same, F.col("first.number").alias("first")), "warc-first")
        placed = many.join(first.withColumnsRenamed({c: f"{c}_" for c in ("id", *same)}), [F.col("id").eqNullSafe(F.col("id_")), *[F.col(c) == F.col(f"{c}_") for c in same]])
        place = F.when(F.col("number") == F.col("first"), 0).otherwise(F.col("number") + 1)
        plain = once.unionByName(placed.withColumn("place", place.cast("long")).select(*once.columns))
    told = plain.join(lead, same)
    is_lead = F.col("id").eqNullSafe(F.col("lead")) & (F.col("place") == 0)
    told = told.withColumn("kind", F.when(is_lead | (F.col("size") < min_revisit), F.lit("response")).otherwise(F.lit("revisit")))
    told = told.select("id", "url", "html", "place", "kind", "lead")

    def run(batches):
        path, out, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for i, u, h, p, k, lead in zip(*(batch.column(c) for c in range(6)), strict=True):
                i, u, h, p, k, lead = (x.as_py() for x in (i, u, h, p, k, lead))
                payload = h.encode("utf-8", "surrogatepass")
                if out is None:
                    system, at = _open(path)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(at, compression=None)
                revisit = k == "revisit"
                digest = sha1_base32(payload)
                out.write(member(k, record_id(i, digest, p), u, b"" if revisit else payload, digest, record_id(lead, digest, 0) if revisit else None))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    manifest = new_path(spark, "warc-manifest")
    told.mapInArrow(run, "path string, records long").write.parquet(manifest)
    return spark.read.schema("path string, records long").parquet(manifest)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives of a manifest: record_id, type, uri, refers_to,
    payload_digest, block_bytes and block."""

    def run(batches):
        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 5 else pa.binary() if k == 6 else pa.string()) for k, c in enumerate(cols)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = _open(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for head, block in read_records(stream):
                        strip = lambda x: x and x.strip("<>")
                        rows.append((strip(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"), strip(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha1:"), len(block), block))
                        size += len(block)
                        if size > 1 << 22 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    names = ["record_id", "type", "uri", "refers_to", "payload_digest", "block_bytes", "block"]
    schema = T.StructType.fromDDL("record_id string, type string, uri string, refers_to string, payload_digest string, block_bytes long, block binary")
    n = manifest.count()
    spread = manifest.select("path").repartition(max(1, n)) if n > 1 else manifest.select("path")
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read these back, and return per record: id,
    ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` (the id of the
    response, for revisits).

    A revisit's length is that of the response it refers to. An empty table writes no
    archive and gives no row; nulls, empty and repeated pages are as in write_archives.
    """
    manifest = write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit=min_revisit)
    back = materialise(read_archives(manifest).drop("block", "uri"), "warc-read")
    said = lambda c: F.regexp_extract(c, r"^urn:page:(.*):[A-Z2-7]{32}:\d+$", 1)
    # In a form a plus is a space; here it was encoded, so there is none.
    to_id = lambda c: F.when(said(c) != "~", F.url_decode(said(c))).cast(pages.schema[id_col].dataType)
    first = back.where("type = 'response'").select(F.col("record_id").alias("to"), F.col("block_bytes").alias("full"))
    revisits = back.where("type = 'revisit'").join(first, F.col("refers_to") == F.col("to"), "left")
    both = back.where("type = 'response'").withColumn("full", F.col("block_bytes")).select("record_id", "type", "refers_to", "payload_digest", "full")
    out = both.unionByName(revisits.select("record_id", "type", "refers_to", "payload_digest", "full"))
    return out.select(to_id("record_id").alias(id_col), F.col("full").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), to_id("refers_to").alias("refers_to"))


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
