"""Operator 10: a deterministic sharded WARC writer and its reader, as a data source named "warc".

Records are sorted by (page_id, payload digest, url) into shards of near equal bytes.  The bounds are exact: running totals
of bytes over the whole order, made range by range, tell where each shard begins, so reruns write the same files and there are as
many shards as the bytes ask for, wherever the page_ids lie.  A task writes each shard as gzip members, one a record, and
starts a new file when the compressed one reaches `roll_bytes`.  Headers and digests are made anew from the payload.  A task
writes under a temporary name of its own; the driver renames the files of the tasks that succeeded and then puts the manifest
in place, so a lost executor or a second attempt leaves no trace and a reader sees all files or none.  A reader compares
every file with the manifest's SHA-256.

Cases: null html is an empty payload; a null url is named after the page; a null page_id sorts first and is named by
digest; of equal payloads the smallest page_id is the response, also if several rows have it, and all others revisit it;
rows equal in page_id, payload and url stay in one shard; an empty table gives a manifest without files; a folder that has a
manifest is only written again in overwrite mode; control characters in urls are percent-encoded; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from peakfold.llm.common import Scratch, maybe_broadcast, partitions

#: Bytes that headers take, about.
HEADERS = 512
SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, block_digest_ok boolean, file string"
#: Fixed values of the WARC 1.1 format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark understands it, so that no executor takes it for one of its own disk."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def manifest(fs: pafs.FileSystem, root: str) -> list[dict]:
    if fs.get_file_info(f"{root}/_manifest.json").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/_manifest.json", compression=None) as f:
        return json.loads(f.read())["files"]


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member without a time stamp."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha1:" + sha1(block)), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """`first`: page_id of the response that this page revisits."""
    digest = sha1(payload)
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id if page_id is not None else digest}"
    headers = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-ID", str(first))], http)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int, int, str]]  # temporary name, final name, records, bytes, SHA-256


class WarcWriter(DataSourceArrowWriter):
    """Rows: shard, page_id, url, payload, first; sorted by shard within a task."""

    def __init__(self, path: str, roll_bytes: int, date: str, overwrite: bool):
        self.path, self.roll, self.date = path.rstrip("/"), roll_bytes, date
        fs, root = place(self.path)
        self.old = manifest(fs, root)
        if self.old and not overwrite:
            raise FileExistsError(f"{path} holds an archive already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = place(self.path)
        mine = f"{root}/_temporary/{uuid.uuid4().hex}"
        done: list[tuple[str, str, int, int, str]] = []
        out = None

        def finish():
            nonlocal out
            if out is not None:
                out["stream"].close()
                done.append((out["temp"], out["final"], out["records"], out["bytes"], out["sha"].hexdigest()))
                out = None

        shard, number = None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard", "page_id", "url", "payload", "first")}
                if row["shard"] != shard:
                    finish()
                    shard, number = row["shard"], 0
                elif out is not None and out["bytes"] >= self.roll:
                    finish()
                    number += 1
                parts = []
                if out is None:
                    name = f"part-{shard:06d}-{number:04d}.warc.gz"
                    fs.create_dir(mine, recursive=True)
                    out = {"temp": f"{mine}/{name}", "final": f"{root}/{name}", "stream": fs.open_output_stream(f"{mine}/{name}", compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                    info = f"software: peakfold\r\nformat: {VERSION}\r\n".encode()
                    parts.append(record("warcinfo", [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
                parts.append(page_record(row["page_id"], row["url"], row["payload"], row["first"], self.date))
                for p in parts:
                    out["stream"].write(p)
                    out["sha"].update(p)
                    out["bytes"] += len(p)
                out["records"] += 1
        finish()
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = place(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        fs.create_dir(root, recursive=True)
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda f: fs.move(f[0], f[1]), files))
        lines = [{"file": final.rsplit("/", 1)[1], "records": n, "bytes": size, "sha256": digest} for _, final, n, size, digest in files]
        lines.sort(key=lambda x: x["file"])
        with fs.open_output_stream(f"{root}/_manifest.json.tmp", compression=None) as f:
            f.write(json.dumps({"files": lines}, indent=0).encode())
        fs.move(f"{root}/_manifest.json.tmp", f"{root}/_manifest.json")
        for name in {x["file"] for x in self.old} - {x["file"] for x in lines}:
            fs.delete_file(f"{root}/{name}")
        self._clean(fs, root)

    def abort(self, messages) -> None:
        self._clean(*place(self.path))

    @staticmethod
    def _clean(fs, root) -> None:
        if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")


class OneFile(InputPartition):
    def __init__(self, name: str, sha256: str):
        super().__init__(name)
        self.name, self.sha256 = name, sha256


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzip stream."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := f.readline():
        if line.strip() == b"":
            continue
        if line.strip().decode() != VERSION:
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := f.readline().decode().rstrip("\r\n")) != "":
            k, _, v = line.partition(": ")
            headers[k] = v
        n = int(headers["Content-Length"])
        block = f.read(n)
        if len(block) != n or f.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield headers, block


class Hashed(io.RawIOBase):
    """A stream that hashes what is read of it."""

    def __init__(self, raw):
        self.raw, self.sha = raw, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.raw.read(len(into))
        self.sha.update(data)
        into[: len(data)] = data
        return len(data)


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self):
        fs, root = place(self.path)
        if fs.get_file_info(f"{root}/_manifest.json").type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"{self.path} has no manifest")
        return [OneFile(x["file"], x["sha256"]) for x in manifest(fs, root)] or [OneFile("", "")]

    def read(self, partition: OneFile):
        if not partition.name:
            return
        fs, root = place(self.path)
        with fs.open_input_stream(f"{root}/{partition.name}", compression=None) as raw:
            hashed = Hashed(raw)
            for h, block in records(io.BufferedReader(hashed, 1 << 20)):
                if h["WARC-Type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                n = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                if h["WARC-Type"] == "response" and (len(payload) != n or sha1(payload) != digest):
                    raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match its digest")
                page, to = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                yield (int(page) if page else None, h["WARC-Target-URI"], h["WARC-Type"], digest, n, int(to) if to else None, h["WARC-Block-Digest"] == "sha1:" + sha1(block), partition.name)
            if hashed.sha.hexdigest() != partition.sha256:
                raise ValueError(f"{partition.name} doesn't match the manifest")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", 1 << 30)), self.options.get("date", "1970-01-01T00:00:00Z"), overwrite)


def shard_starts(slim: DataFrame, shard_bytes: int, scratch: Scratch) -> list[tuple[bool, int, bytes, int]]:
    """(page_id is there, page_id, digest, url's hash) of the first record of every shard but the first, in order.

    Ranges of the order are summed up on their own and then among each other; a shard gives one row to the driver.
    """
    key = ["there", "page_id", "digest", "u"]
    sums = slim.groupBy(F.col("page_id").isNotNull().alias("there"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "digest", "u").agg(F.sum(F.col("n") + HEADERS).alias("m"))
    ranges = scratch.save(sums.repartitionByRange(partitions(slim.sparkSession), *key).withColumn("r", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("r").agg(F.sum("m").alias("t")).select("r", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("o"))  # a row a range
    inside = Window.partitionBy("r").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    spots = ranges.withColumn("i", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(F.broadcast(totals), "r").withColumn("shard", F.floor((F.col("i") + F.col("o")) / shard_bytes))
    first = spots.groupBy("shard").agg(F.min(F.struct(*key)).alias("k")).select("k.*").collect()
    return sorted((r["there"], r["page_id"], bytes(r["digest"]), r["u"]) for r in first)[1:]


def shard_of(starts: list[tuple[bool, int, bytes, int]]):
    """Column function: the number of shards that start at or before a row's key."""
    nulls = [x for x in starts if not x[0]]
    rest = [x for x in starts if x[0]]
    pages = np.array([x[1] for x in rest], np.int64)

    @F.pandas_udf("int")
    def find(page_id: pd.Series, there: pd.Series, digest: pd.Series, u: pd.Series) -> pd.Series:
        p = page_id.to_numpy(np.int64)
        low = np.where(there, len(nulls) + np.searchsorted(pages, p, "left"), 0)
        high = np.where(there, len(nulls) + np.searchsorted(pages, p, "right"), len(nulls))
        for i in np.flatnonzero(low < high):  # shards that start with this page_id
            low[i] = bisect.bisect_right(starts, (bool(there.iloc[i]), int(p[i]), bytes(digest.iloc[i]), int(u.iloc[i])))
        return pd.Series(low.astype(np.int32))

    return find


def write_pages(pages: DataFrame, path: str, shard_bytes: int = 1 << 30, roll_bytes: int = 1 << 30, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", mode: str = "append") -> None:
    """Write one record per row of pages (page_id, url, html).  Payloads of under `least_bytes` never become revisits."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("u", F.xxhash64("url"))
    slim = scratch.save(rows.select("page_id", "digest", "u", F.length("payload").cast("long").alias("n")), "slim")
    firsts = slim.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null").drop("c")
    firsts = scratch.save(firsts, "firsts")
    starts = shard_starts(slim, shard_bytes, scratch)

    full = rows.join(maybe_broadcast(firsts, firsts.count()), "digest", "left").withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")) | (F.length("payload") < least_bytes), F.lit(None)).otherwise(F.col("first")))
    if starts:
        full = full.withColumn("shard", shard_of(starts)(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNotNull(), "digest", "u"))
    else:
        full = full.withColumn("shard", F.lit(0))
    full = full.select("shard", "page_id", "url", "payload", "first", "digest", "u")
    full = full.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "u", "url").drop("digest", "u")
    spark.dataSource.register(WarcSource)
    full.write.format("warc").mode(mode).option("path", qualified(spark, path)).option("roll_bytes", str(roll_bytes)).option("date", date).save()
    scratch.drop(slim, firsts)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records; a payload, block or file that doesn't match its digest is an error or a false block_digest_ok."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", qualified(spark, path)).load()
