"""WARC archives: written with an index, read back through it.

The writer's index has offset, length, URL and digest of each record. A reader picks records from the index
alone, sorts them by file and offset, and coalesces neighbouring ranges into one read. Each record is a gzip
member of its own, so any range of records is readable by itself.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.files import Appender, Reader
from strandgraph.llm.store import discard, key_of, shared_folder, written
from strandgraph.llm.text import NULL_KEY, arrow_limits

#: Equal payloads below this size are stored each time.
REVISIT_BYTES = 100
#: Compressed bytes of an archive; the record that passes it is its last.
FILE_BYTES = 256 << 20
#: Two selected ranges of a file are one read if no more than GAP bytes lie between them.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20

#: Digests that more than one record has are broadcast up to so many; beyond, payloads are shuffled by digest.
BROADCAST_DIGESTS = 1_000_000
#: Beyond that, digests with more than this share of all records are broadcast still: at most 1 / share of them.
HOT_SHARE = 1 / 4096

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string"
#: The head of the HTTP response that a page came in, as far as a table of pages knows it.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, of)))}>"


def record(own_id: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int | None, str | None, str | None] | None) -> bytes:
    """One record as a gzip member. refers: (page, url, record id) of the response with the same payload, or None. What is
    null has no field."""
    clean = lambda u: "".join(c for c in u if c not in "\r\n")
    fields: list[tuple[str, object]] = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", own_id), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", clean(url)))
    if page is not None:
        fields.append(("X-Page-Id", page))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
    block = HTTP.format(len(payload)).encode()
    if refers is None:
        block += payload
    else:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields += [(k, v) for k, v in (("X-Refers-To-Page-Id", refers[0]), ("WARC-Refers-To-Target-URI", refers[1] and clean(refers[1])), ("WARC-Refers-To", refers[2])) if v is not None]
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(_head([*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n") + press.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """The first record of data: its fields, its payload (after the HTTP head), and the bytes of its gzip member."""
    press = zlib.decompressobj(31)
    raw = press.decompress(data)
    end = raw.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :], len(data) - len(press.unused_data)


def _id(x: str | None) -> int | None:
    return int(x) if x else None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Appender(folder, ".warc.gz", FILE_BYTES)
        null = lambda k: None if k == NULL_KEY else k
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                refers = None
                if r["first"] is not None:
                    # A page that is there more than once has no one record to refer to.
                    refers = null(r["first"]), r["first_url"], record_id(r["first"], r["digest"]) if r["first_rows"] == 1 else None
                out.room()
                own = record_id(r["k"], r["digest"]) if not r["again"] else record_id(r["k"], r["digest"], out.name, out.at)
                place = out.write(record(own, null(r["k"]), r["url"], r["html"].encode(), r["digest"], refers))
                rows.append((*place, null(r["k"]), r["url"], r["digest"], r["size"], "response" if refers is None else "revisit"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)] if rows else [pa.array([], t) for t in _INDEX_TYPES], names=_INDEX_NAMES)
        out.close()

    return run


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.string() if x.split()[1] == "string" else pa.int64() for x in INDEX.split(", ")]


def write_archives(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> tuple[str, DataFrame]:
    """Writes a record for each page into archives of a new shared folder; gives the folder and the index.

    Of records with equal payloads of REVISIT_BYTES or more that of the smallest id is a response, which the others
    revisit; rows that repeat that id are responses as well. Smaller payloads are responses. A null html is empty, a null id counts
    as the smallest, a null url as none. Rows that repeat a page have a record each. An empty table makes no archive. Other columns aren't read.
    """
    spark = pages.sparkSession
    arrow_limits(spark)
    html = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    pages = pages.select(key_of(id_column).alias("k"), F.col(url_column).cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    # The payloads stay out of the grouping: ids and digests alone are shuffled there.
    sums = written(pages.drop("html"), "digests")
    by_page = sums.groupBy("digest", "k").agg(F.count("*").alias("rows"), F.min("url").alias("url"), F.max("size").alias("size"))
    classes = by_page.groupBy("digest").agg(F.min_by(F.struct("k", "url", "rows"), "k").alias("f"), F.sum("rows").alias("n"), F.max("rows").alias("most"), F.max("size").alias("size")).filter("n > 1")
    classes = written(classes.select("digest", F.col("f.k").alias("first"), F.col("f.url").alias("first_url"), F.col("f.rows").alias("first_rows"), "n", (F.col("most") > 1).alias("repeats"), (F.col("size") >= REVISIT_BYTES).alias("large")), "classes")
    facts = classes.drop("n")
    n = classes.limit(BROADCAST_DIGESTS + 1).count()
    if n <= BROADCAST_DIGESTS:
        found = pages.join(F.broadcast(facts), "digest", "left")
    else:
        hot = F.col("n") > HOT_SHARE * sums.count()
        named = [c for c in facts.columns if c != "digest"]
        often = pages.join(F.broadcast(classes.filter(hot).drop("n")), "digest", "left")
        others = often.filter("first is null").drop(*named).join(classes.filter(~hot).drop("n"), "digest", "left")
        found = often.filter("first is not null").unionByName(others)
    # Whether a page is there more than once is looked up by itself, where there are any such pages.
    again = F.lit(False)
    if not classes.filter("repeats").isEmpty():
        found = found.join(F.broadcast(by_page.filter("rows > 1").select("digest", "k", F.lit(True).alias("again"))) if n <= BROADCAST_DIGESTS else by_page.filter("rows > 1").select("digest", "k", F.lit(True).alias("again")), ["digest", "k"], "left")
        again = F.coalesce("again", F.lit(False))
    revisit = F.col("large") & (F.col("k") != F.col("first"))
    copies = found.select("k", "url", "html", "digest", "size", *(F.when(revisit, F.col(c)).alias(c) for c in ("first", "first_url", "first_rows")), again.alias("again"))
    folder = shared_folder(spark, "warc")
    index = written(copies.mapInArrow(_writer(folder), INDEX), "warc-index")
    discard(sums, classes)
    return folder, index


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Reader(folder)

        def many(rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
            """The records at (file, offset, length), which are in order, with as few reads as GAP_BYTES allows."""
            i = 0
            while i < len(rows):
                name, begin, n = rows[i]
                j, end = i + 1, begin + n
                while j < len(rows) and rows[j][0] == name and rows[j][1] <= end + GAP_BYTES and rows[j][1] + rows[j][2] - begin <= READ_BYTES:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                body = source.read(name, begin, end - begin)
                for _, at, size in rows[i:j]:
                    yield body[at - begin : at - begin + size]
                i = j

        for batch in batches:
            out = []
            for data in many(list(zip(*(batch.column(i).to_pylist() for i in range(3))))):
                fields, content, _ = parsed(data)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError(f"the payload of page {fields.get('X-Page-Id')} doesn't match its digest")
                size = len(content) if kind == "response" else int(fields["X-Payload-Length"])
                out.append((_id(fields.get("X-Page-Id")), size, digest, kind, _id(fields.get("X-Refers-To-Page-Id")), fields.get("WARC-Target-URI"), content.decode() if kind == "response" else None))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=[x.split()[0] for x in RECORD.split(", ")])
        source.close()

    return run


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def read_records(folder: str, index: DataFrame) -> DataFrame:
    """The records that index rows (all, or those that a filter selected) point at: RECORD. payload is null in revisits.

    The rows are sorted by file and offset in ranges, so each task reads a stretch of few files from front to back.
    """
    arrow_limits(index.sparkSession)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(_reader(folder), RECORD)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 1: every page written, then every record read back."""
    folder, index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
