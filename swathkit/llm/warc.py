"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

The writer builds each record as text in DataFrame functions and lets Spark's text sink commit the
files. Of payloads that are equal and at least `least_bytes` long, the smallest page id is stored and
the others become revisit records without body.

The reader checks version line, header, length, trailing line ends and the block digest of every
record. Where a check fails it searches on for the next version line (in a plain archive) or the next
member (in a gzip one) that begins a record which passes, goes on from there, and returns the bytes
between as a gap with its reason. What a damaged member inflates to before the damage is searched like
a plain archive. Nothing is lost silently: the records and gaps of a file tile it, those of one member
at the same place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm.bloom_dedup import filter_bits, split_repeats
from swathkit.llm.shared import materialize, scratch_path

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
#: The end of an HTTP header, whose lines may end in LF alone.
_BLANK = re.compile(rb"\r?\n\r?\n")
_FOLD = re.compile(rb"\r\n[ \t]+")
FILE_BYTES = 16 << 20


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""  # of a gap
    verified: bool = False  # by its block digest

    def payload(self) -> bytes:
        """The block, without the HTTP header of a response; all of it if no blank line ends one."""
        blank = _BLANK.search(self.block) if self.headers.get("content-type", "").startswith("application/http") else None
        return self.block[blank.end() :] if blank else self.block


def _agrees(block: bytes, digest: str) -> bool | None:
    """Whether a block has the digest of its header, in hexadecimal or base32; None without a digest or of an unknown kind."""
    kind, _, value = digest.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5"):
        return None
    raw = hashlib.new(kind, block).digest()
    return value.strip().lower() == raw.hex() or value.strip().upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parse_record(data: bytes, at: int) -> Record | str:
    """The record that begins at a place, or what is wrong with it."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    top = data.find(_END, at)
    if top < 0:
        return "header without end"
    if _VERSION.search(data, version.end(), top + 2):
        return "version line within a header"
    headers = {}
    # A line that begins with white space goes on from the one before.
    for line in _FOLD.sub(b" ", data[version.end() : top]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdecimal():
        return "no length"
    low = top + len(_END)
    high = low + int(headers["content-length"])
    if high + len(_END) > len(data):
        return "truncated"
    if data[high : high + len(_END)] != _END:
        return "length does not meet the record's end"
    block = data[low:high]
    checked = _agrees(block, headers.get("warc-block-digest", ""))
    if checked is False:
        return "block digest differs"
    return Record(at, high + len(_END), headers, block, verified=bool(checked))


def _plain(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        found = parse_record(data, at)
        if isinstance(found, Record):
            yield found
            at = found.end
            continue
        for version in _VERSION.finditer(data, at + 1):
            if isinstance(parse_record(data, version.start()), Record):
                yield Record(at, version.start(), reason=found)
                at = version.start()
                break
        else:
            yield Record(at, len(data), reason=found)
            return


def _member(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What a member inflates to, its end, and what is wrong with it. A damaged one has no end; what came out before the damage counts."""
    inflate, out, step = zlib.decompressobj(31), [], 1 << 16
    while at < len(data) and not inflate.eof:
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[at : at + step]))
        except zlib.error as error:
            if step == 1:
                return b"".join(out), None, f"member: {error}"
            # Again from before this piece, byte by byte up to the damage.
            inflate, step = before, 1
            continue
        at += step
    if not inflate.eof:
        return b"".join(out), None, "member without end"
    return b"".join(out), min(at, len(data)) - len(inflate.unused_data), ""


def _gzipped(data: bytes) -> Iterator[Record]:
    """Records and gaps by the place of their member. A damaged member ends where the next begins that is sound or holds a good record."""

    def look(at: int) -> tuple[list[Record], int | None]:
        body, end, wrong = _member(data, at)
        inner = list(_plain(body))
        # A member that is one record must be sound as a whole: its checksum is a check of the record.
        if wrong and all(r.reason or r.end - r.start == len(body) for r in inner):
            inner = []
        if wrong or not inner:
            inner.append(Record(at, at, reason=wrong or "empty member"))
        return inner, end

    at, here = 0, look(0) if data else None
    while at < len(data):
        inner, end = here
        later, nxt = None, at + 1
        while end is None:
            nxt = data.find(_MEMBER, nxt)
            if nxt < 0:
                end = len(data)
                break
            later = look(nxt)
            if later[1] is not None or not all(r.reason for r in later[0]):
                end = nxt
            nxt += 1
        for record in inner:
            yield Record(at, end, record.headers, record.block, record.reason, record.verified)
        at = end
        here = later if later is not None and nxt - 1 == at else look(at) if at < len(data) else None


def salvage(data: bytes) -> Iterator[Record]:
    """All records of an archive that pass their checks, and the gaps (records with a reason) between them."""
    return _gzipped(data) if data.startswith(_MEMBER) or (not data.startswith(b"WARC/") and _MEMBER in data and not _VERSION.search(data)) else _plain(data)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", torn: Column | None = None) -> None:
    """Write one record per row of pages to a folder of plain WARC files of about 16 MB.

    A null payload is empty. Rows that repeat id and payload are each stored. A null id never is what
    others refer to. Line ends in URLs are left out; a null URL has no target header. Before the rows
    for which torn (a condition on the id) holds, the first half of their record is left as well, as by
    a writer that broke off there and began anew: what a reader must skip.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n", F.octet_length("payload"))
    digests = materialize(rows.select("id", "digest", "n"), "digests")
    groups = digests.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("many")).filter("many > 1").drop("many")
    # By id and digest, not by digest alone: a payload with very many copies is spread evenly.
    revisits = digests.join(groups, "digest").filter("id > refers_to").select(F.col("id").alias("other"), F.col("digest").alias("same"), "refers_to").distinct()
    # Only payloads that may repeat are shuffled; the others pass straight to the writer.
    once, maybe = split_repeats(rows, [F.col("digest")], filter_bits(digests.count()))
    maybe = maybe.join(revisits, (F.col("id") == F.col("other")) & (F.col("digest") == F.col("same")), "left").drop("other", "same")
    rows = once.withColumn("refers_to", F.lit(None).cast("long")).unionByName(maybe)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    rows = rows.withColumn("block", block)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(F.col("block").cast("binary"), 256))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    count, size = digests.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_file = max(1, int(FILE_BYTES * count / max(1, size + 600 * count)))
    if torn is not None:
        rows = rows.withColumn("record", record)
        half = F.substring(F.col("record"), F.lit(1), (F.length("record") / 2).cast("int"))
        record = F.when(F.coalesce(torn, F.lit(False)), F.concat(half, F.col("record"))).otherwise(F.col("record"))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def _id_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


_READ = "file string, start long, end long, reason string, record_type string, record_id long, refers_to long, target_uri string, payload_bytes long, payload_digest string, verified boolean, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, files: str = "*") -> DataFrame:
    """Records and gaps of all archives below a path whose file names match `files`: file, start, end, reason (null for records), record_type, record_id, refers_to, target_uri, payload_bytes, payload_digest, verified (by a block digest of a known kind), payload.

    Names that begin with a dot or underscore are left out by Spark. Places are bytes of the file, of a
    record's member if it is compressed. The digest of a stored
    payload is computed; a revisit has what its header says. An archive is read by one task and
    held in memory, so archives should be cut to some hundred MB, as the writer does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                for r in salvage(data.as_py() or b""):
                    if r.reason:
                        rows.append((name, r.start, r.end, r.reason, *[None] * 8))
                    else:
                        h, body = r.headers, r.payload()
                        revisit = h.get("warc-type") == "revisit"
                        size = int(h["x-payload-length"]) if revisit and h.get("x-payload-length", "").isdecimal() else len(body)
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
                        rows.append((name, r.start, r.end, None, h.get("warc-type"), _id_of(h.get("warc-record-id")), _id_of(h.get("warc-refers-to")), h.get("warc-target-uri"), size, digest, r.verified, body if with_payload else None))
                    if len(rows) >= 500:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files).load(path)
    return archives.select("path", "content").mapInArrow(run, _READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _READ.split(", ")])


def round_trip(pages: DataFrame, torn_every: int = 97) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives written to the shared folder.

    The archives are damaged: before each page whose id is divisible by torn_every there is a torn copy
    of its record. So the reader has to salvage what follows; every record comes back once, or the
    reader has failed, which is an error where it shows (an unverified record).
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, torn=F.pmod(F.col("id"), F.lit(torn_every)) == 0)
    found = read_warc(pages.sparkSession, path, with_payload=False).filter("reason is null")
    checked = F.when(F.col("verified"), F.col("record_id")).otherwise(F.raise_error(F.lit("a record without digest")).cast("long"))
    return found.select(checked.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
