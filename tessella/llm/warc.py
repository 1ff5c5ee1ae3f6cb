"""Deterministic sharded WARC archives: a writer that ranges, rolls, digests and commits, and a checking reader."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_range_shards, open_fs, session_of, small_batches, staged, tidy
from .files import MANIFEST, Checked, TempFile, commit, manifest, manifest_batch, per_file

#: Payloads below this many bytes are always stored; a revisit record would save nothing.
LEAST_REVISIT = 100
DATE = "2020-01-01T00:00:00Z"


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _safe(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, with block digest and length; the same input gives the same bytes."""
    head = [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, occurrence: int = 0) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    revisit = refers_to is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page_id, digest, occurrence)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _safe(url))] if url is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha256:" + digest),
        ("X-Payload-Length", str(len(payload))),
        *([("X-Page-Id", str(page_id))] if page_id is not None else []),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _id(refers_to, digest, 0)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http if revisit else http + payload)


def _tie() -> Column:
    """Orders rows of one page_id. Equal payloads agree on it, so all of a page that is one record's copies lies in one shard."""
    return F.xxhash64(F.coalesce("html", F.lit("")))


def _first_copies(pages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(page_id, digest, bytes and tie of every row; page_id, tie, digest and first of rows whose payload stands on an earlier page)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"), _tie().alias("_tie"))
    narrow = staged(narrow, "warc-digests")
    large = narrow.where(F.col("_bytes") >= least)
    first = large.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where((F.col("_n") > 1) & F.col("_first").isNotNull())
    marks = large.select("page_id", "_tie", "_digest").join(first.select("_digest", "_first"), "_digest")
    return narrow, marks


def write_warc(pages: DataFrame, out_dir: str, shard_bytes: int = 32 << 20, roll_bytes: int = 64 << 20, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for every row (page_id, url, html) below ``out_dir`` and return the manifest.

    Rows are ranged by page_id, and of one page_id by a hash of the payload, into shards of about ``shard_bytes`` of payload, by exact sums, and sorted in each; a shard's file is closed and
    the next begun once it has ``roll_bytes`` compressed. Of rows with equal payloads of at least ``least_revisit`` bytes, that with
    the smallest page_id is a response, the others are revisits of it. Headers, digests and ids depend on the rows alone, so
    the same rows give the same files, byte for byte.

    Which payloads repeat is found on digests; a group of copies of any size is one row there, and the join that tells its rows is split where
    it is skewed. The payloads are shuffled once. A task holds a batch of rows and a record, never a shard. Null html is an empty
    payload; null urls have no target header; null ids come first and have no id header, and are revisits of others at most. Of repeated
    rows the first is the response. No rows: a manifest without files. Further columns are not stored.
    """
    spark = session_of(pages)
    small_batches(spark)
    narrow, marks = _first_copies(pages, least_revisit)
    weights = narrow.select(F.col("page_id").cast("long").alias("key"), F.col("_tie").alias("tie"), (F.col("_bytes") + 600).alias("weight"))
    none = F.lit(None)
    rows = pages.select("page_id", F.lit(1).alias("_kind"), "url", "html", _tie().alias("_tie"), none.cast("string").alias("_digest"), none.cast("long").alias("_first"))
    marks = marks.select("page_id", F.lit(0).alias("_kind"), none.cast("string").alias("url"), none.cast("string").alias("html"), "_tie", "_digest", F.col("_first").cast("long"))
    rows = in_range_shards(rows.unionByName(marks), weights, "page_id", "_tie", shard_bytes, "_tie", "_kind", "_digest", "url", "html")
    rows = rows.select("page_id", "_kind", "url", "html", "_digest", "_first", "_tie", "_shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        file, state = None, {}

        def close() -> None:
            nonlocal file
            if file is not None:
                done.append(file.row(records=state["n"], units=state["n"], first_id=state["first"], last_id=state["last"]))
                file = None

        shard_now, seq, page, known, seen = None, 0, object(), {}, {}
        for b in batches:
            for page_id, kind, url, html, digest, first, tie, shard_id in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if shard_id != shard_now:
                    close()
                    shard_now, seq = shard_id, 0
                if (page_id, tie) != page:
                    page, known, seen = (page_id, tie), {}, {}
                if kind == 0:
                    known[digest] = first
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                own = hashlib.sha256(payload).hexdigest()
                again = seen.get(own, 0)
                seen[own] = again + 1
                refers = known.get(own)
                if refers is not None and refers == page_id and not again:
                    refers = None
                if file is None:
                    file = TempFile(out_dir, shard_id, seq, ".warc.gz")
                    state = {"n": 0, "first": page_id, "last": page_id}
                    info = b"software: tessella\r\nformat: WARC File Format 1.1\r\n"
                    file.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id("info", file.name)), ("WARC-Date", DATE), ("WARC-Filename", file.name), ("Content-Type", "application/warc-fields")], info))
                file.write(page_record(page_id, url, payload, refers, again))
                state["n"], state["last"] = state["n"] + 1, page_id
                if file.bytes >= roll_bytes:
                    close()
                    seq += 1
        close()
        yield manifest_batch(done)

    return commit(rows.mapInArrow(tidy(run), MANIFEST), out_dir)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream; a wrong length or digest is an error."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record here: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.lower()] = value.strip(" \r\n")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError(f"damaged record {headers.get('warc-record-id')}")
        yield headers, block


def read_warc(spark: SparkSession, out_dir: str, payloads: bool = True) -> DataFrame:
    """The pages of committed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload.

    Only files that the manifest names are read, a record at a time. Lengths and digests of blocks and stored payloads are checked. The length
    and digest of a revisit are those of the full payload, from its headers; its payload is null.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out_dir)
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)])

        with fs.open_input_stream(f"{base}/{row['name']}", compression=None) as file, Checked(file, row) as raw, gzip.GzipFile(fileobj=raw) as z:
            for h, block in parse(io.BufferedReader(z, 1 << 18)):
                if h["warc-type"] == "warcinfo":
                    continue
                digest, payload = h["warc-payload-digest"].removeprefix("sha256:"), None
                if h["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != int(h["x-payload-length"]) or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload {h['warc-record-id']}")
                ident, refers = h.get("x-page-id"), h.get("x-refers-to-page")
                out.append((None if ident is None else int(ident), h.get("warc-target-uri"), int(h["x-payload-length"]), digest, h["warc-type"], None if refers is None else int(refers), payload))
                held += len(payload or b"") * payloads
                if len(out) >= 2000 or held > 8 << 20:
                    yield batch()
                    out, held = [], 0
        yield batch()

    return per_file(manifest(spark, out_dir), run, schema)
