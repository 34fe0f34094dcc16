"""WARC files of web pages: a writer that keeps equal payloads once, and a splittable reader.

Every record is a gzip member of its own.  The reader cuts files into byte ranges.  A
task looks for the gzip magic from its range's start on, takes a place for a member only
if it decodes to a WARC header and another member or the file's end follows, and owns the
records that start inside its range; the last of these it reads to its end, wherever that
lies.

A payload may itself hold whole gzipped records, so a range may begin with what only looks
like one.  Therefore each range first tells where its first record begins and where the
next after its last does: members follow each other without a gap, so the ranges of a file
must agree from its start on, and one that does not is walked again from where its
predecessor ends.  A member that is expected and broken is an error, as are bytes
between members, a file that ends early and another number of records than was written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm import files
from callscope.llm.common import fresh_dir, map_arrow, settle, slices

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are always written in full.
MIN_BYTES = 0
#: Bytes of a file after which a task begins another, and of a range that a task reads.
FILE_BYTES, SPLIT_BYTES = 64 << 20, 16 << 20
CHUNK = 1 << 16
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _line(text: str | None) -> str:
    """A header value without control characters."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None = None, first_url: str | None = None, revisit: bool = False) -> bytes:
    """One gzip member: a response with its payload, or a revisit that refers to page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, digest)}", f"WARC-Refers-To-Target-URI: {_line(first_url)}", f"X-Refers-To-Page-ID: {first}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id integer, url, html); returns the manifest (file, size, records).

    Of the rows with equal payloads (null html: empty) of at least ``min_bytes`` those with
    the smallest page_id are responses (several only if rows repeat), the others revisits
    of it.  A row without page_id is a response only where no row of its payload has one.
    """
    folder = files.make_folder(folder or fresh_dir(pages.sparkSession, "warc"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    keyed = rows.select("digest", F.struct("page_id", "url").alias("p")).where(F.col("p.page_id").isNotNull())
    first = keyed.groupBy("digest").agg(F.min("p").alias("first"))  # sums up in each task before the exchange
    full = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))

    def run(batches):
        out, done, n = files.Rolling(folder, ".warc.gz", file_bytes), [], 0
        for batch in batches:
            for part in slices(batch, "payload"):
                for r in part.to_pylist():
                    if not out.open:
                        out.start()
                    again = r["first"] is not None and r["page_id"] != r["first"] and len(r["payload"]) >= min_bytes
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    out.write(record(r["page_id"], r["url"], r["payload"], digest, r["first"], r["first_url"], again))
                    n += 1
                    if out.full:
                        done.append((*out.close(), n))
                        n = 0
        if out.open:
            done.append((*out.close(), n))
        if done:
            name, size, count = (list(x) for x in zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(size, pa.int64()), pa.array(count, pa.int64())], ["file", "size", "records"])

    return settle(map_arrow(full, run, "file string, size long, records long"))


class _Window:
    """Bytes of a file from a moving place on up to ``size``, read in chunks."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.data, self.size = file, at, bytearray(), min(size, file.size())

    def more(self) -> bool:
        place = self.at + len(self.data)
        got = self.file.read_at(min(CHUNK, self.size - place), place) if place < self.size else b""
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _member(window: _Window) -> tuple[bytes | None, int, str]:
    """Content and length of the gzip member at the window's start; no content, and why, if it isn't a whole one that begins with a WARC header."""
    unpress, out, used, size, checked = zlib.decompressobj(31), [], 0, 0, False
    while not unpress.eof:
        if used == len(window.data) and not window.more():
            return None, used, "it ends early"
        piece = bytes(window.data[used : used + CHUNK])
        try:
            out.append(unpress.decompress(piece))
        except zlib.error as e:
            return None, used, str(e)
        used += len(piece) - len(unpress.unused_data)
        size += len(out[-1])
        if not checked and size >= 7:
            if not b"".join(out).startswith(b"WARC/1."):
                return None, used, "it is no WARC record"
            checked = True
    data = b"".join(out)
    return (data, used, "") if checked and b"\r\n\r\n" in data else (None, used, "it is no WARC record")


def _follows(window: _Window, used: int) -> bool:
    """Whether another member, or nothing, comes after ``used`` bytes of the window."""
    while len(window.data) < used + len(MAGIC) and window.more():
        pass
    rest = bytes(window.data[used : used + len(MAGIC)])
    return not rest or rest == MAGIC


def find(file, start: int, end: int, size: int) -> int | None:
    """The first place from ``start`` to ``end`` of a file of ``size`` bytes that looks like a member; None if there is none."""
    window = _Window(file, start, size)
    while window.at < end:
        k = window.data.find(MAGIC)
        if k < 0:
            keep = min(len(window.data), len(MAGIC) - 1)  # the magic may straddle two chunks
            window.skip(len(window.data) - keep)
            if not window.more():
                return None
            continue
        window.skip(k)
        if window.at >= end:
            return None
        # The window keeps what it reads, so a candidate that fails costs no second read.
        content, used, _ = _member(window)
        if content is not None and _follows(window, used):
            return window.at
        window.skip(1)
    return None


def walk(file, at: int, end: int, size: int):
    """(place, content, place after it) of the members that follow each other from ``at`` on and start before ``end``; anything else there is an error."""
    window = _Window(file, at, size)
    if window.size < size:
        raise ValueError(f"the file ends early: {window.size} of {size} bytes")
    while window.at < end:
        content, used, why = _member(window)
        if content is None:
            raise ValueError(f"broken record at byte {window.at}: {why}")
        place = window.at
        window.skip(used)
        yield place, content, window.at


def members(uri: str, start: int, end: int):
    """(place, content) of the records that start in bytes ``start`` to ``end`` of a file, by that range alone."""
    store, path = files.locate(uri)
    with store.open_input_file(path) as file:
        first = find(file, start, end, file.size()) if start else 0
        if first is not None:
            yield from (x[:2] for x in walk(file, first, end, file.size()))


_RANGE = "file string, size long, start long, end long, first long, next long, records long, error string"


def _ranges(rows: DataFrame) -> DataFrame:
    """Each of rows (file, size, start, end, first) with its first record (looked for where null), the place after its last, their number, and what is wrong."""

    def run(batches):
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                first, after, n, error = s["first"], None, 0, None
                store, path = files.locate(s["file"])
                with store.open_input_file(path) as file:
                    try:
                        first = first if first is not None else 0 if s["start"] == 0 else find(file, s["start"], s["end"], s["size"])
                        if first is not None:
                            for *_, after in walk(file, first, s["end"], s["size"]):
                                n += 1
                    except ValueError as e:
                        error, after = f"{s['file']}: {e}", None
                out.append(s | {"first": first, "next": after, "records": n, "error": error})
            names = [x.split()[0] for x in _RANGE.split(", ")]
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(names, kinds, strict=True)], names)

    return rows.select("file", "size", "start", "end", "first").repartition(max(1, rows.count())).mapInArrow(run, _RANGE)


def ranges(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, size, start, end, first, next, records) of the byte ranges of files (file, size, and perhaps records) in which records start."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    rows = manifest.where(F.col("size") > 0).select("file", "size", starts.alias("start"))
    rows = settle(rows.withColumns({"end": F.least(F.col("size"), F.col("start") + split_bytes), "first": F.lit(None).cast("long")}))
    known = settle(_ranges(rows))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    while True:
        # Where a range must begin: its predecessors' end; beyond its own end, it holds no start of a record.
        due = F.coalesce(F.last("next", True).over(before), F.lit(0))
        seen = known.withColumn("due", due).withColumn("good", F.when(F.col("due") >= F.col("end"), F.col("first").isNull()).otherwise((F.col("first") == F.col("due")) & F.col("error").isNull()))
        seen = seen.withColumn("bad", F.sum((~F.coalesce("good", F.lit(False))).cast("int")).over(upto))
        seen = settle(seen)
        wrong = seen.where((F.col("bad") == 1) & ~F.coalesce("good", F.lit(False)))  # in each file the first: all before it are right
        if wrong.isEmpty():
            break
        failed = wrong.where(F.col("error").isNotNull() & (F.col("first") == F.col("due"))).select("error").first()
        if failed:
            raise ValueError(failed["error"])
        none = [F.lit(None).cast(k).alias(c) for c, k in (("first", "long"), ("next", "long"))]
        past = wrong.where(F.col("due") >= F.col("end")).select("file", "size", "start", "end", *none, F.lit(0).cast("long").alias("records"), F.lit(None).cast("string").alias("error"))
        again = _ranges(settle(wrong.where(F.col("due") < F.col("end")).select("file", "size", "start", "end", F.col("due").alias("first"))))
        rest = known.join(wrong.select("file", "start"), ["file", "start"], "left_anti")
        known = settle(rest.unionByName(past).unionByName(again))
    if "records" in manifest.columns:
        found = known.groupBy("file").agg(F.sum("records").alias("found"))
        other = manifest.join(found, "file", "left").where(F.col("records") != F.coalesce("found", F.lit(0))).first()
        if other:
            raise ValueError(f"{other['file']} has {other['found'] or 0} records, {other['records']} were written")
    return known.where(F.col("first").isNotNull()).drop("error")


def parse(content: bytes) -> dict:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return {"headers": headers, "block": rest[: int(headers["content-length"])]}


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of each record in the files, and its payload (null in revisits) if wanted.

    A response whose payload does not have the digest that its header gives is an error,
    as is a broken or missing record.  Page ids are integers.
    """

    def contents(s: dict):
        store, path = files.locate(s["file"])
        with store.open_input_file(path) as file:
            for _, content, _ in walk(file, s["first"], s["end"], s["size"]):
                yield content

    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                rows, size = [], 0
                for content in contents(s):
                    got = parse(content)
                    h, kind = got["headers"], got["headers"]["warc-type"]
                    head, _, payload = got["block"].partition(b"\r\n\r\n")
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        n = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} has another digest")
                    else:
                        n = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    page, refers = (int(h[k]) if h.get(k, "None") != "None" else None for k in ("x-page-id", "x-refers-to-page-id"))
                    rows.append((page, h.get("warc-target-uri"), kind, n, digest, refers, payload if with_payload and kind == "response" else None))
                    size += 256 + len(payload) * with_payload
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k, _ in zip(zip(*rows, strict=True), kinds, names, strict=False)], names)

    splits = settle(ranges(manifest, split_bytes))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return splits.repartition(max(1, splits.count())).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of ``pages``, written and read back."""
    return read_warc(write_warc(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
r AS (SELECT p.*, first, first IS NOT NULL AND page_id IS DISTINCT FROM first AND strlen(html) >= {MIN_BYTES} AS again FROM p JOIN f USING (h))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
         lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, g * 5 + 1, 5))::BIGINT >> b) & 31)::INTEGER, 1)), '')), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""
