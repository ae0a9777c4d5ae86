"""Sink: one stored, deterministic ZIP archive per cleared document, inspected after it is built."""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.operators.report import ENTRIES

README = "# About this archive\n\nIt holds one rewritten text, a manifest and a report on what was found. Send it only where its route allows. The scan behind it knows a fixed set of patterns: other secrets may be left.\n"


def check_name(name: str) -> None:
    if not name or name.startswith("/") or "\\" in name or ".." in name.split("/"):
        raise ValueError(f"unsafe entry name: {name!r}")


def render_json(text: str) -> bytes:
    return (json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n").encode("utf-8")


def build_zip(entries: list[tuple[str, bytes]]) -> bytes:
    """Stored entries with a constant time stamp: equal entries, equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in entries:
            check_name(name)
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def read_zip(data: bytes) -> list[tuple[str, bytes]]:
    """The entries of an archive whose checksums hold; raises if it holds anything else than it may."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.testzip() or any(i.compress_type != zipfile.ZIP_STORED for i in z.infolist()):
            raise ValueError("damaged or compressed archive")
        entries = [(name, z.read(name)) for name in z.namelist()]
    if [name for name, _ in entries] != list(ENTRIES):
        raise ValueError(f"unexpected entries: {[name for name, _ in entries]}")
    return entries


def inspect_zip(data: bytes) -> list[str]:
    """The entry names of an archive that may leave."""
    return [name for name, _ in read_zip(data)]


def package_hash(entries: list[tuple[str, bytes]]) -> str:
    return hashlib.sha256(b"".join(name.encode("utf-8") + data for name, data in entries)).hexdigest()


#: So many bytes of archives, and so many of their rows, are put together before they are handed on.
OUT_BYTES, OUT_ROWS = 4 << 20, 1024


def _by_size(schema, rows):
    """Batches of (row, its size), none of them much larger than OUT_BYTES or OUT_ROWS, whatever comes in at once."""
    import pyarrow as pa

    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for row, n in rows:
        held.append(row)
        size += n
        if size >= OUT_BYTES or len(held) >= OUT_ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(it):
    """The rows of batches, made into Python's objects one at a time."""
    for batch in it:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def packages(cleared: DataFrame) -> DataFrame:
    """(source_id, package_sha256, zip_sha256, zip) of rows (source_id, sanitized_text, manifest, report); the last two JSON."""
    import pyarrow as pa

    schema = pa.schema([("source_id", pa.string()), ("package_sha256", pa.string()), ("zip_sha256", pa.string()), ("zip", pa.binary())])

    def built(it):
        for source, text, manifest, report in _rows(it):
            entries = list(zip(ENTRIES, [text.encode("utf-8"), render_json(manifest), render_json(report), README.encode("utf-8")]))
            data = build_zip(entries)
            inspect_zip(data)
            yield (source, package_hash(entries), hashlib.sha256(data).hexdigest(), data), len(data)

    slim = cleared.select(F.col("source_id").cast("string"), "sanitized_text", "manifest", "report")
    return slim.mapInArrow(lambda it: _by_size(schema, built(it)), "source_id string, package_sha256 string, zip_sha256 string, zip binary")


def opened(built: DataFrame) -> DataFrame:
    """(source_id, pos, name, n_bytes, crc32, sha256) of every entry, read back from the archives."""
    import pyarrow as pa

    schema = pa.schema([("source_id", pa.string()), ("pos", pa.int64()), ("name", pa.string()), ("n_bytes", pa.int64()), ("crc32", pa.int64()), ("sha256", pa.string())])

    def entries(it):
        for source, data in _rows(it):
            for k, (name, x) in enumerate(read_zip(data)):
                yield (source, k, name, len(x), zlib.crc32(x), hashlib.sha256(x).hexdigest()), 0

    return built.select("source_id", "zip").mapInArrow(lambda it: _by_size(schema, entries(it)), "source_id string, pos long, name string, n_bytes long, crc32 long, sha256 string")


def _save_local(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "xb") as f:
        f.write(data)
    try:
        os.link(part, path)
    except FileExistsError:
        with open(path, "rb") as f:
            if f.read() != data:
                raise
    finally:
        os.unlink(part)


def _save_remote(store, path: str, data: bytes) -> None:
    """Objects appear whole when their stream is closed; on file systems a finished part is moved."""
    from pyarrow.fs import FileType

    if store.get_file_info(path).type != FileType.NotFound:
        with store.open_input_stream(path) as f:
            if f.read() != data:
                raise FileExistsError(path)
        return
    store.create_dir(os.path.dirname(path))
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def save_packages(built: DataFrame, folder: str) -> None:
    """Writes each archive to a folder that driver and executors share: a path, or the URI of a store.

    A file appears whole or not at all. An existing file with other bytes is an error; one with the
    same bytes is what an earlier attempt of a lost or repeated task has left.
    """

    def write(rows):
        store, base = None, folder
        if "://" in folder:
            from pyarrow.fs import FileSystem

            store, base = FileSystem.from_uri(folder)
        for r in rows:
            path = f"{base.rstrip('/')}/" + hashlib.sha256(r["source_id"].encode("utf-8")).hexdigest()[:32] + ".zip"
            _save_local(path, r["zip"]) if store is None else _save_remote(store, path, r["zip"])

    built.select("source_id", "zip").foreachPartition(write)


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, zip) of the archives in a folder; the source is the one that the manifest names."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            data = batch.column(0).to_pylist()
            sources = [json.loads(dict(read_zip(z))[ENTRIES[1]])["source"]["source_id"] for z in data]
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(data, pa.binary())], ["source_id", "zip"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("content").mapInArrow(run, "source_id string, zip binary")
