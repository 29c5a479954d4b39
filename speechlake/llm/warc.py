"""WARC archives of web pages: written per task, indexed first, read by coalesced byte ranges."""

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.sources.shared import new_path, written

_INDEX = "page_id bigint, url string, digest string, folder string, file string, offset bigint, length bigint"


def duplicates(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(digest, first_id, first_url) of the payloads of min_bytes or more that several pages share; the largest page_id is the first.

    Works on digests alone; groups are pre-aggregated, so one payload may make up any share of the rows.
    """
    slim = pages.where(F.col("payload_bytes") >= min_bytes)
    shared = slim.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id"))
    return shared.where("n > 1").select(F.col("payload_digest").alias("_digest"), "first_id")


def _record(row: dict) -> bytes:
    """One gzip member: a response with its payload, or a revisit with headers only."""
    payload = row["payload"] or b""
    first = row["first_id"]
    revisit = first is not None and first != row["page_id"]
    body = b"" if revisit else payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]", "", row["url"] or ""),
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "text/html",
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{first}>"
    fields["Content-Length"] = str(len(body))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 3, mtime=0)


def write_warc(pages: DataFrame, min_bytes: int = 1000, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Write a record per page; return the index: page_id, url, digest, folder, file, offset, length.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of min_bytes or more the
    one with the largest page_id is a response, the others are revisits of it; rows that repeat that
    page_id are responses too. A null page_id is never a first; where all are null, all are responses. An
    archive is written by one task under the name of its attempt, and only committed attempts have index
    rows, so a lost executor leaves no trace in the index.
    """
    folder = new_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    same = duplicates(rows.select("page_id", "payload_digest", "payload_bytes"), min_bytes)
    met = rows.join(same, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= min_bytes), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            out = {"page_id": [], "url": [], "digest": [], "offset": [], "length": []}
            for row in batch.to_pylist():
                if stream is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    stream = store.open_output_stream(name, compression=None)
                data = _record(row)
                for k, v in (("page_id", row["page_id"]), ("url", row["url"]), ("digest", row["payload_digest"]), ("offset", stream.tell()), ("length", len(data))):
                    out[k].append(v)
                stream.write(data)
            n = len(out["offset"])
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["page_id"], pa.int64()), pa.array(out["url"], pa.string()), pa.array(out["digest"], pa.string()), pa.array([folder] * n), pa.array([name] * n), pa.array(out["offset"], pa.int64()), pa.array(out["length"], pa.int64())],
                    ["page_id", "url", "digest", "folder", "file", "offset", "length"],
                )
        if stream is not None:
            stream.close()

    slim = met.select("page_id", "url", "payload", "payload_digest", "first_id")
    return written(slim.mapInArrow(run, _INDEX), "warc-index")


def ranges(index: DataFrame, gap: int = 65_536, most: int = 8_388_608) -> DataFrame:
    """Coalesce the selected records of an index into byte ranges: folder, file, start, stop, records.

    Within a file sorted by offset a range ends before a gap of more than `gap` bytes, and at each
    multiple of `most` bytes in the file, so that ranges stay small; `records` holds the offset and
    length of each.
    """
    part = F.floor(F.col("offset") / most)
    order = W.partitionBy("folder", "file", "part").orderBy("offset")
    far = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap
    runs = index.withColumn("part", part).withColumn("far", F.coalesce(far.cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("far").over(order))
    return runs.groupBy("folder", "file", "part", "run").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    )


def parse(record: bytes) -> dict:
    """The headers and the body of one record."""
    data = zlib.decompress(record, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields | {"body": rest[: int(fields["Content-Length"])]}


def read_warc(index: DataFrame, with_html: bool = True, gap: int = 65_536, most: int = 8_388_608) -> DataFrame:
    """Read the records of an index: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked, html (null for a revisit).

    A response's digest and length are those of the body that was read; a revisit's stand in its header.
    The ranges are dealt over as many tasks as there are shuffle partitions, more where one would read
    over 8 * most bytes: their rows are slim, so Spark cannot tell by itself how much they make a task read.
    """

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(row["file"]) as stream:
                    stream.seek(row["start"])
                    data = stream.read(row["stop"] - row["start"])
                rows = []
                for r in row["records"]:
                    at = r["offset"] - row["start"]
                    x = parse(data[at : at + r["length"]])
                    revisit = x["WARC-Type"] == "revisit"
                    digest = x["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(x["body"]).hexdigest()
                    size = int(x["WARC-Payload-Length"]) if revisit else len(x["body"])
                    rows.append((number(x["WARC-Record-ID"]), x["WARC-Target-URI"], size, digest, x["WARC-Type"], number(x.get("WARC-Refers-To")), *([None if revisit else x["body"].decode()] * with_html)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"][: len(columns)])

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", html string" * with_html
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * most)))
    return ranges(index, gap, most).repartition(n).mapInArrow(run, schema)
