"""A deterministic sharded WARC writer and its reader.

Records are put in page order: page ids are cut into ranges of about `shard_bytes` of payload (the splitters come from exact sums over at
most BINS cells of ids, refined where they are larger than a shard), every range is one shard, sorted, and written by one task.  A shard's file is closed when its
compressed size reaches `roll_bytes`.  Headers, record ids and digests are made anew from the rows, the date is a parameter, and
every record is a gzip member of its own, so the same rows give the same bytes, however tasks are retried.

Commit: a task writes under `_tmp` and moves each closed file to its final name; a retried or speculative task only puts the same
bytes there again.  What counts is the manifest, a Parquet table whose own commit comes last; the reader opens only files that it
lists, with the size and SHA-256 it lists.

Of records with equal payloads of at least `revisit_from` bytes the one with the largest page id is the response, the others are
revisits of it and carry no payload.  Only (page id, digest) rows are joined; the revisit marks travel in the same sort as the pages.

Defined results: a null html is an empty payload; a null url leaves the target out; rows with a null page id come first and revisit
the largest id among equal payloads; repeated rows are written each, as responses where their id is the largest; extra columns are ignored;
an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import shared

#: Cells of page ids whose sums the driver sees at once; there are at most an eighth as many shards, which get larger beyond that.
BINS = 1 << 18
STRIDE = 128
SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
REVISIT_FROM = 1000
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard long, roll long, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest.hex()}'.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    digest = hashlib.sha1(payload).digest()
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    named = lambda d: "sha1:" + base64.b32encode(d).decode()
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~|^{}`<>\\\"")),
        ("WARC-Payload-Digest", named(digest)),
        ("WARC-Block-Digest", named(hashlib.sha1(block).digest())),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to if revisit else None),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def packed(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one in memory at a time."""
    z, out = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            out.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("a WARC file ends within a record")


def parse(raw: bytes) -> dict:
    """A record's fields; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).digest() != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("X-Page-Id"), "url": url, "record_type": fields["WARC-Type"], "payload_bytes": number("X-Payload-Length"), "payload_digest": digest.hex(), "refers_to": number("X-Refers-To-Page-Id"), "payload": None if revisit else payload}


class _Files:
    """The rolling files of one shard."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.shard, self.roll_bytes, self.roll, self.out = shard, roll_bytes, 0, None

    def add(self, data: bytes) -> dict | None:
        if self.out is None:
            self.temp = posixpath.join(self.root, "_tmp", uuid.uuid4().hex)
            self.fs.create_dir(posixpath.dirname(self.temp), recursive=True)
            self.out, self.n, self.bytes, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.n, self.bytes = self.n + 1, self.bytes + len(data)
        return self.close() if self.bytes >= self.roll_bytes else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        name = f"shard-{self.shard:08d}-{self.roll:05d}.warc.gz"
        self.fs.create_dir(posixpath.join(self.root, "data"), recursive=True)
        self.fs.move(self.temp, posixpath.join(self.root, "data", name))
        done = {"file": name, "shard": self.shard, "roll": self.roll, "records": self.n, "bytes": self.bytes, "sha256": self.sha.hexdigest()}
        self.out, self.roll = None, self.roll + 1
        return done


def _writer(root: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark, done = None, None, []
        names = ["file", "shard", "roll", "records", "bytes", "sha256"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if r["tag"] == 0:
                        mark = (r["page_id"], r["key"], r["refers_to"])
                        continue
                    if files is None or files.shard != r["shard"]:
                        done += [files.close()] if files else []
                        files = _Files(root, r["shard"], roll_bytes)
                    revisit = mark is not None and mark[:2] == (r["page_id"], r["key"])
                    done.append(files.add(packed(record(r["page_id"], r["url"], r["html"].encode("utf-8"), mark[2] if revisit else None, revisit, date))))
        done += [files.close()] if files else []
        done = [d for d in done if d]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string() if k in ("file", "sha256") else pa.int64()) for k in names], names=names)

    return run


def splitters(narrow: DataFrame, shard_bytes: int, bins: int = BINS) -> list[int]:
    """First page ids of all shards but the first.  narrow: page_id (no nulls), n (bytes); total bytes of a shard are about shard_bytes.

    Sums over at most `bins` cells of ids (ids shifted right, so nothing overflows) are exact; a cell that is larger than a shard is cut into
    cells of its own in another pass, until a shard's size or a single id is reached.  So ids far from all others cost a pass, not balance.
    """
    low, high, total = narrow.agg(F.min("page_id"), F.max("page_id"), F.sum("n")).first()
    if low is None:
        return []
    limit = max(shard_bytes, -(-total * 8 // bins))
    shift = max(0, ((high >> 1) - (low >> 1)).bit_length() + 1 - (bins.bit_length() - 2))
    cell = lambda s: F.shiftright("page_id", s)
    count = lambda rows, s: [(r["cell"] << s, r["n"]) for r in rows.groupBy(cell(s).alias("cell")).agg(F.sum("n").alias("n")).collect()]
    cells = count(narrow, shift)
    while shift and (heavy := {a for a, n in cells if n > limit}):
        finer = max(0, shift - max(1, (bins // len(heavy)).bit_length() - 1))
        large = narrow.sparkSession.createDataFrame([(a >> shift,) for a in heavy], "cell long")
        inside = narrow.join(F.broadcast(large), cell(shift) == F.col("cell"), "left_semi")
        cells = [c for c in cells if c[0] not in heavy] + count(inside, finer)
        shift = finer
    cuts, size = [], 0
    for first, n in sorted(cells):
        if size and size + n > limit:
            cuts.append(max(first, low))
            size = 0
        size += n
    return cuts


def write(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_from: int = REVISIT_FROM, date: str = DATE) -> DataFrame:
    """Write page_id, url, html as WARC files under root/data and return the manifest that was written to root/manifest."""
    spark = pages.sparkSession
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.select("*", F.sha2("html", 256).alias("key"))
    narrow = shared.table(keyed.select("page_id", "key", F.octet_length("html").cast("long").alias("n")), "warc-sizes")
    long = narrow.where(F.col("n") >= revisit_from).select("page_id", "key")
    largest = long.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("key", "refers_to")
    marks = long.join(largest, "key").where("page_id is null or page_id < refers_to").select("page_id", "key", "refers_to")
    none = lambda kind: F.lit(None).cast(kind)
    rows = marks.select("page_id", "key", F.lit(0).alias("tag"), "refers_to", none("string").alias("url"), none("string").alias("html"))
    rows = rows.unionByName(keyed.select("page_id", "key", F.lit(1).alias("tag"), none("long").alias("refers_to"), "url", "html"))
    cuts = splitters(narrow.where("page_id is not null"), shard_bytes)
    # rows without an id come first, in as many shards as their bytes need, by their payload
    unnamed = -(-(narrow.where("page_id is null").agg(F.sum("n")).first()[0] or 0) // shard_bytes) or 1
    unnamed = min(unnamed, BINS)
    of_null = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(unnamed))
    shard = F.when(F.col("page_id").isNull(), of_null).otherwise(_upper_bound(cuts) + (unnamed - 1)).cast("long")
    rows = rows.withColumn("shard", shard).repartitionByRange(len(cuts) + unnamed, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "key", "tag", "url")
    rows.mapInArrow(_writer(root, roll_bytes, date), MANIFEST).write.parquet(f"{root}/manifest")
    shared.drop(narrow)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _upper_bound(cuts: list[int]) -> F.Column:
    """How many cuts are at most page_id: first among every STRIDE-th one, then among those that follow it."""
    if not cuts:
        return F.lit(0)
    upto = lambda held: F.size(F.filter(held, lambda c: c <= F.col("page_id")))
    array = lambda values: F.from_json(F.lit(json.dumps(values)), "array<long>")  # noqa: E731  one literal, once folded
    if len(cuts) <= STRIDE:
        return upto(array(cuts))
    whole = upto(array(cuts[STRIDE - 1 :: STRIDE])) * STRIDE
    return whole + upto(F.slice(array(cuts), whole + 1, F.lit(STRIDE)))


def read(spark: SparkSession, root: str) -> DataFrame:
    """All records of the files that the manifest lists; a file that doesn't have the listed size and SHA-256 is an error."""
    listed = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(root)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

        for b in batches:
            for entry in b.to_pylist():
                sha, size, rows, held = hashlib.sha256(), 0, [], 0
                with fs.open_input_stream(posixpath.join(top, "data", entry["file"]), compression=None) as f:

                    def chunks(f=f):
                        nonlocal size
                        while c := f.read(1 << 16):
                            sha.update(c)
                            size += len(c)
                            yield c

                    for raw in members(chunks()):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if (size, sha.hexdigest()) != (entry["bytes"], entry["sha256"]):
                    raise ValueError(f"{entry['file']} isn't the file that the manifest lists")
                if rows:
                    yield batch(rows)

    return listed.repartition(n, "file").mapInArrow(run, RECORD)


def archive(pages: DataFrame) -> DataFrame:
    """Write to a new folder under the shared one and read all records back."""
    root = shared.fresh(pages.sparkSession, "warc")
    write(pages, root)
    return read(pages.sparkSession, root)
