"""WARC archives (operator 5): a deterministic sharded writer and a reader.

Records of pages with equal payloads of at least `LEAST` bytes are one response, that of the smallest page_id, and revisits that
refer to it; smaller ones are all responses. Writing:
1. Digests: SHA-256 and length of every payload (UTF-8 of html; null: empty) and, per repeated digest, the smallest page_id.
2. Ranges: page ids are cut into at most `BINS` equal bins; a bin of more than 1 / `CELLS` of a shard is cut into 8, and so on down
   to single ids. In the order of ids, a bin goes to the shard in which its first byte falls. A shard is `SHARD_BYTES`, or 1 /
   `SHARDS` of all bytes if that is more, so that there are at most 8 CELLS SHARDS + BINS bins (a million). So shards are ranges of ids,
   follow from the rows alone, not from a sample or the number of tasks, and none holds much more than the target; only the rows
   of one id (or of none) that are more than that are dealt out by digest. Sums per top bin are all that comes to the driver.
3. Writing: payloads move once, to their shard, where rows with their digest's first page come right before them. A task sorts
   the shard's records by page_id, digest and url, compresses each as a gzip member without a time stamp,
   starts a new file when `FILE_BYTES` compressed bytes are reached, and regenerates all headers, lengths, digests and record ids.
   Files get a temporary name that is unique to the attempt, in a folder of their own.
4. Commit: the rows the tasks return (shard, number, temporary name, sizes, SHA-256) are committed by Spark as a manifest table,
   which takes one attempt per task; tasks then rename its files to their final names, the folder with what failed attempts left
   goes, and `MANIFEST.json`, which has the totals, is put in place last, itself by renaming. Readers take only files the manifest
   lists. A committed archive is never written again; what a run that broke off has left is removed by the next.

Rows with a null page_id sort first and are written without an id; they refer to the response by digest. A payload that only
occurs under null ids has as response one record per row (no smallest id exists). Repeated page_ids: every row gets a record;
of rows with the same payload and the smallest id, the first in the archive's order is the response. Null urls are written
empty. Empty tables give an archive with a manifest and no file. Further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Workspace, remove, scratch, table, tidy

LEAST = 100
BINS = 4096
SHARD_BYTES = 48 << 20
SHARDS, CELLS = 1 << 14, 8
#: Tasks that read.
READERS = 100_000
FILE_BYTES = 16 << 20
LEVEL = 4
#: Bytes that are handed to a decompressor at once.
STEP = 16 << 10
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("5b1f7d0e-8f5b-4c7e-9b53-6d1f0f7f2b11")
EMPTY_BLOCK_DIGEST = "sha1:" + base64.b32encode(hashlib.sha1(b"").digest()).decode()


def _record_id(page_id, digest: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{turn}')}>"


def _one_line(x: str | None) -> str:
    return "".join(c if c >= " " else "%" + format(ord(c), "02X") for c in x or "")


def record(kind: str, url: str | None, page_id, digest: str, payload: bytes, refers_to, turn: int = 0) -> bytes:
    """The bytes of one WARC record, headers regenerated from the values."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest, turn)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" if block else f"WARC-Block-Digest: {EMPTY_BLOCK_DIGEST}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A gzip member with neither time nor name."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + z.compress(data) + z.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzip or plain WARC file; lengths and digests are checked."""
    whole, at = memoryview(archive), 0
    while at < len(whole):
        if bytes(whole[at : at + 2]) == b"\x1f\x8b":
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                piece = whole[at : at + STEP]
                if not len(piece):
                    raise ValueError("a member is cut short")
                parts.append(z.decompress(piece))
                at += len(piece)
            at -= len(z.unused_data)  # within the last piece, so nothing is copied again and again
            data = b"".join(parts)
        else:
            data, at = bytes(whole[at:]), len(whole)
        while data:
            head, _, tail = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(headers["content-length"])
            block, data = tail[:n], tail[n + 4 :]
            if len(block) != n or tail[n : n + 4] != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            want = headers.get("warc-block-digest", "")
            if want.startswith("sha1:") and want[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
                raise ValueError("a block doesn't match its digest")
            yield headers, block


def _digests(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("bigint").alias("n"))


def _cell(level: int, low: int) -> Column:
    return F.expr(f"(page_id - {low}L) div {8**level}L")


def _shards(rows: DataFrame, space: Workspace) -> tuple[DataFrame, int]:
    """rows (page_id, digest, n and others) with their shard, and the number of shards."""
    slim = space.stored(rows.select("page_id", (F.col("n") + 400).alias("bytes")), "sizes")
    low, high, total = slim.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    low, high, total = low or 0, high or 0, total or 0
    size = max(SHARD_BYTES, -(-total // SHARDS))
    top = 0
    while (high - low) >> (3 * top) >= BINS:
        top += 1
    levels, level, inside = [], top, slim.filter("page_id is not null")
    while True:
        sums = space.stored(inside.groupBy(_cell(level, low).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
        large = sums.filter(F.col("bytes") > size // CELLS) if level else sums.limit(0)
        levels.append((level, sums.join(large.select("cell"), "cell", "left_anti")))
        if not large.limit(1).count():
            break
        inside = inside.join(large.select("cell"), _cell(level, low) == F.col("cell"), "left_semi")
        level -= 1
    cells = [x.select(F.lit(k).alias("level"), "cell", "bytes", F.expr(f"cell div {8 ** (top - k)}L").alias("bin"), (F.col("cell") * 8**k).alias("at")) for k, x in levels]
    cells = space.stored(functools.reduce(DataFrame.union, cells), "cells")
    bare = slim.filter("page_id is null").agg(F.sum("bytes")).first()[0] or 0  # they come first
    before, starts = bare, {}
    for bin_, n in cells.groupBy("bin").agg(F.sum("bytes").alias("n")).orderBy("bin").collect():  # BINS rows at most
        starts[bin_], before = before, before + n
    base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else F.expr("cast(map() as map<bigint,bigint>)")
    within = F.sum("bytes").over(Window.partitionBy("bin").orderBy("at")) - F.col("bytes")
    placed = cells.withColumn("first", F.floor((F.try_element_at(base, "bin") + within) / size).cast("int"))
    # a million rows at most, 16 MB; ids with more than a shard's bytes (whole ones, so cells of level 0) are dealt out over as many shards
    placed = space.stored(placed.select("level", "cell", "first", F.ceil(F.col("bytes") / size).cast("int").alias("pieces")), "placed")
    first, pieces = F.lit(0), F.lit(max(1, -(-bare // size)))
    for k, _ in levels:
        at = placed.filter(F.col("level") == k).select(F.col("cell").alias(f"_cell{k}"), F.struct("first", "pieces").alias(f"_at{k}"))
        rows = rows.join(F.broadcast(at), _cell(k, low) == F.col(f"_cell{k}"), "left")
        first, pieces = F.coalesce(F.col(f"_at{k}.first"), first), F.coalesce(F.col(f"_at{k}.pieces"), pieces)
    dealt = F.pmod(F.xxhash64("digest"), pieces).cast("int")
    rows = rows.withColumn("shard", F.least(first + F.when(pieces > 1, dealt).otherwise(F.lit(0)), F.lit(total // size))).drop(*[f"_{c}{k}" for k, _ in levels for c in ("cell", "at")])
    return rows, total // size + 1


def repeated(rows: DataFrame, space: Workspace) -> DataFrame:
    """page_id, digest, shard, first: for rows of payloads that occur more than once, the smallest page_id with the payload.

    Without the payloads, so only digests move; a hot payload is summed within each task before it does, and the table of firsts is
    written before it is joined, so that Spark can deal out the rows of a hot digest."""
    rows = rows.filter(F.col("n") >= LEAST).select("page_id", "digest", "shard")
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    firsts = space.stored(firsts.filter("copies > 1 and first is not null").select("digest", "first"), "firsts")
    return rows.join(firsts, "digest").select("page_id", "digest", "shard", "first")


FILES = "shard int, number int, temporary string, name string, records bigint, raw_bytes bigint, bytes bigint, sha256 string"


def write_warc(pages: DataFrame, directory: str) -> DataFrame:
    """Writes the archive into directory (a URI whose file system executors reach) and returns the manifest's rows."""
    spark = pages.sparkSession
    store, root = fs.FileSystem.from_uri(directory)
    if store.get_file_info(f"{root}/MANIFEST.json").type != fs.FileType.NotFound:
        raise FileExistsError(f"{directory} holds an archive")
    remove(spark, directory)
    space = Workspace(spark, "warc")
    rows, n_shards = _shards(_digests(pages.select("page_id", "url", "html")), space)
    # the rows of repeated payloads come once more, without payload, right before the pages they speak of: so pages move once
    told = repeated(rows, space).select("shard", "page_id", "digest", F.lit(0).alias("what"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
    told = told.distinct().union(rows.select("shard", "page_id", "digest", F.lit(1), "url", "html", F.lit(None).cast("bigint")))
    rows = told.repartitionById(n_shards, "shard")
    rows = rows.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "what", "url")
    rows.mapInArrow(tidy(_writer(directory)), FILES).write.parquet(f"{directory}/_manifest")
    done = spark.read.schema(FILES).parquet(f"{directory}/_manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(directory)
        for batch in batches:
            for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at.get_file_info(f"{base}/{new}").type == fs.FileType.NotFound:  # else an earlier attempt has done it
                    at.move(f"{base}/{old}", f"{base}/{new}")
            yield batch

    moved = done.select("temporary", "name", "records", "bytes").mapInArrow(rename, "temporary string, name string, records bigint, bytes bigint")
    files, records, size = moved.agg(F.count("*"), F.sum("records"), F.sum("bytes")).first()
    remove(spark, f"{directory}/_temporary")
    with store.open_output_stream(f"{root}/_MANIFEST.json.part") as f:
        f.write(json.dumps({"table": "_manifest", "files": files, "records": records or 0, "bytes": size or 0}, indent=1).encode())
    store.move(f"{root}/_MANIFEST.json.part", f"{root}/MANIFEST.json")
    space.clear()
    return done.drop("temporary")


def _writer(directory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(f"{root}/_temporary", recursive=True)
        attempt, done = uuid.uuid4().hex, []
        out = name = None
        shard = number = -1
        before = first_of = None
        first, turn = None, 0

        def close():
            nonlocal out
            if out is not None:
                out[0].close()
                done.append((shard, number, name, f"part-{shard:05d}-{number:05d}.warc.gz", out[1], out[2], out[3], out[4].hexdigest()))
                out = None

        for batch in batches:
            for to, page_id, digest, what, url, html, told in zip(*(c.to_pylist() for c in batch.columns)):
                if not what:
                    first_of, first = (page_id, digest), told
                    continue
                if first_of != (page_id, digest):
                    first = None
                payload = (html or "").encode("utf-8")
                turn = turn + 1 if before == (page_id, digest) else 0
                before = page_id, digest
                revisit = first is not None and (page_id != first or turn > 0)
                data = record("revisit" if revisit else "response", url, page_id, digest, payload, first, turn)
                member = packed(data)
                if to != shard or out is None or out[3] + len(member) > FILE_BYTES:
                    close()
                    number = number + 1 if to == shard else 0
                    shard, name = to, f"_temporary/{to:05d}-{number:05d}-{attempt}"
                    out = [store.open_output_stream(f"{root}/{name}"), 0, 0, 0, hashlib.sha256()]
                out[0].write(member)
                out[4].update(member)
                out[1], out[2], out[3] = out[1] + 1, out[2] + len(data), out[3] + len(member)
        close()
        names = ["shard", "number", "temporary", "name", "records", "raw_bytes", "bytes", "sha256"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)

    return run


def read_warc(spark: SparkSession, directory: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, recomputed from the stored bytes of
    responses; revisits have their response's length and digest. payloads: with the block as column payload.

    The manifest table is dealt out by file, and a task reads its files one at a time, whole ones of FILE_BYTES at most."""
    store, root = fs.FileSystem.from_uri(directory)
    with store.open_input_stream(f"{root}/MANIFEST.json") as f:
        listed = json.loads(f.read())
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(directory)
        for batch in batches:
            for name, digest_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with at.open_input_stream(f"{base}/{name}", compression=None) as f:
                    content = f.read()
                if hashlib.sha256(content).hexdigest() != digest_:
                    raise ValueError(f"{name} doesn't match the manifest")
                rows = []
                for headers, block in records_of(content):
                    whole = headers["warc-type"] == "response"
                    digest = hashlib.sha256(block).hexdigest() if whole else headers["warc-payload-digest"].removeprefix("sha256:")
                    if whole and headers["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError("a payload doesn't match its digest")
                    page, to = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append((page and int(page), len(block) if whole else int(headers["x-payload-length"]), digest, headers["warc-type"], to and int(to), block)[: 5 + payloads])
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + payloads]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + payloads]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.schema(FILES).parquet(f"{directory}/{listed['table']}").select("name", "sha256")
    return files.repartition(min(max(1, listed["files"]), READERS), "name").mapInArrow(tidy(run), schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), directory)
    return read_warc(spark, directory)


ORACLE = f"""WITH p AS (SELECT page_id, strlen(COALESCE(html, ''))::BIGINT AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, MIN(page_id) AS first FROM p WHERE payload_bytes >= {LEAST} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""
