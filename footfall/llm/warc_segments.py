"""Web archives: segmented records written and put together again.

Writing: pages of equal payload are found by digest; the one with the largest id
becomes a response, the others revisit it.  A response carries its payload in
chunked transfer framing; a block above SEGMENT_BYTES is cut into a first record
and continuation records.  The records go through Spark's text sink, whose line
end is the record's last line break, so any file system of Spark's will do and a
task that runs again replaces its files.

Reading: continuation records are grouped by the id of their origin, ordered by
segment number, checked against the total length, and the chunks are decoded.
Only segmented records are shuffled.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from footfall.llm.common import bucket_split, materialize

# Payloads of at least this many bytes are deduplicated.
DEDUP_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
# With SEGMENT_BYTES this bounds a file to about 64 MB before compression.
RECORDS_PER_FILE = 4096
_FLUSH_BYTES = 4 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD_SCHEMA = (
    "record_id string, record_type string, page_id long, target_uri string, payload_digest string, refers_to long, "
    "origin_id string, segment int, total_length long, block binary"
)


def revisits(pages: DataFrame) -> DataFrame:
    """Rows (page_id, digest, refers_to) of the pages that revisit another one."""
    sized = pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    large = sized.where((F.col("size") >= DEDUP_BYTES) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("lowest"))
    groups = groups.where("lowest < refers_to").drop("lowest")
    return large.join(groups, ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _chunked(payload: bytes) -> Iterator[bytes]:
    for start in range(0, len(payload), CHUNK_BYTES):
        part = payload[start : start + CHUNK_BYTES]
        yield b"%x\r\n%b\r\n" % (len(part), part)
    yield b"0\r\n\r\n"


def _record(kind: str, record_id: str, fields: dict[str, object], block: bytes) -> bytes:
    """A record up to the first of the two line breaks that end it."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{name}: {value}" for name, value in fields.items() if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n"


def _one_line(url: str | None) -> str | None:
    """A url as a header value: control characters are percent-encoded."""
    return None if url is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def _records_of(row) -> Iterator[bytes]:
    fields = {"X-Page-ID": row.page_id, "WARC-Target-URI": _one_line(row.url), "WARC-Payload-Digest": f"sha1:{row.digest}"}
    if row.refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": row.refers_to}
        yield _record("revisit", row.record_id, fields, b"")
        return
    block = _HTTP + b"".join(_chunked(row.payload))
    if len(block) <= SEGMENT_BYTES:
        yield _record("response", row.record_id, fields, block)
        return
    count = -(-len(block) // SEGMENT_BYTES)
    for n in range(count):
        part = block[n * SEGMENT_BYTES : (n + 1) * SEGMENT_BYTES]
        place: dict[str, object] = {"WARC-Segment-Number": n + 1}
        if n:
            place["WARC-Segment-Origin-ID"] = f"<{row.record_id}>"
        if n == count - 1:
            place["WARC-Segment-Total-Length"] = len(block)
        yield _record("continuation" if n else "response", row.record_id + (f":{n + 1}" if n else ""), place if n else fields | place, part)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``.

    A null html is an empty payload.  A null page_id is a response of its own.
    Rows that repeat the largest id of a payload are responses too.
    """
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    known = materialize(revisits(pages), "revisits")
    near, far = bucket_split(pages.withColumn("digest", F.sha1("payload")), "page_id", known)
    refers = known.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to")
    near = near.join(refers, (F.col("page_id") == F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").drop("__page", "__digest")
    named = near.unionByName(far.withColumn("refers_to", F.lit(None).cast("long")))
    named = named.withColumn("record_id", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.monotonically_increasing_id()))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                for record in _records_of(row):
                    held.append(record)
                    size += len(record)
                    if size > _FLUSH_BYTES:
                        yield pd.DataFrame({"record": held})
                        held, size = [], 0
        yield pd.DataFrame({"record": held})

    # Ids travel as text: a null beside a large number would turn it into a float.
    named = named.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    lines = named.mapInPandas(build, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple]:
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields.get("content-length", 0)))
        bare = lambda key: fields[key].strip("<>") if key in fields else None
        whole = lambda key: int(fields[key]) if key in fields else None
        digest = fields.get("warc-payload-digest")
        yield (
            bare("warc-record-id"), fields.get("warc-type"), whole("x-page-id"), fields.get("warc-target-uri"), digest and digest.rpartition(":")[2],
            whole("x-refers-to-page-id"), bare("warc-segment-origin-id"), whole("warc-segment-number"), whole("warc-segment-total-length"), block,
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below a path, segments still apart."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        kinds = dict.fromkeys(("page_id", "refers_to", "total_length"), "Int64") | {"segment": "Int32"}
        columns = zip(*rows) if rows else [[]] * len(names)
        return pd.DataFrame({name: pd.array(list(c), dtype=kinds.get(name, object)) for name, c in zip(names, columns)})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for content in batch["content"]:
                raw = io.BytesIO(content)
                for row in _parsed(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw):
                    held.append(row)
                    size += len(row[-1])
                    if size > _FLUSH_BYTES:
                        yield frame(held)
                        held, size = [], 0
        yield frame(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parse, RECORD_SCHEMA)


def _decoded(block: bytes) -> bytes | None:
    """The payload of an HTTP response; None if its chunks are broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        at = end + 4 + size


@pandas_udf(T.BinaryType())
def _payload(blocks: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else _decoded(b"".join(b)) for b in blocks], dtype=object)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per archived page: record_id, record_type, page_id, target_uri, payload_digest, refers_to, payload, problem.

    problem is null, ``missing_segment``, ``wrong_length`` or ``broken_chunks``; such
    rows have no payload.  A segment that was read twice counts once.  Revisits
    have no payload of their own.
    """
    kept = ("record_id", "record_type", "page_id", "target_uri", "payload_digest", "refers_to")
    whole = records.where("segment is null").select(*kept, F.array("block").alias("blocks"), F.lit(None).cast("string").alias("problem"))
    parts = records.where("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    parts = parts.groupBy("origin", "segment").agg(*[F.first(c, ignorenulls=True).alias(c) for c in (*kept, "total_length", "block")])
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(
        *[first(c) for c in kept],
        F.max("segment").alias("last"), F.max("total_length").alias("total"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("block")).alias("size"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    problem = F.when((F.col("n") != F.col("last")) | F.col("total").isNull() | F.col("record_id").isNull(), "missing_segment").when(F.col("size") != F.col("total"), "wrong_length")
    joined = joined.withColumn("problem", problem).select(*kept, F.when(F.col("problem").isNull(), F.col("parts.block")).alias("blocks"), "problem")
    both = whole.unionByName(joined)
    carries = F.col("record_type") != "revisit"
    both = both.withColumn("payload", F.when(carries, _payload(F.when(carries, F.col("blocks")))))
    broken = carries & F.col("payload").isNull() & F.col("problem").isNull()
    return both.select(*kept, "payload", F.when(broken, "broken_chunks").otherwise(F.col("problem")).alias("problem"))


def page_digests(pages: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, problem) of archived pages.

    A response is measured on its payload; a revisit takes the measure of the
    response that it refers to, matched by id and digest.
    """
    own = pages.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type", "refers_to", "problem",
    )
    own = materialize(own, "archived")
    answers = own.where("record_type = 'response'").groupBy(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    again = own.where("record_type = 'revisit'").join(answers, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    again = again.select("page_id", F.col("__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "problem")
    return own.where("record_type <> 'revisit'").unionByName(again)
