"""ZIP archives as tables: one row an entry, read once for its digest, checksum and size."""

from __future__ import annotations

import hashlib
import stat
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

ENTRY = "path string, position int, name string, regular boolean, size_bytes long, sha256 string, crc_ok boolean, text string, error string"
PIECE = 1 << 20
#: Entries of at most so many bytes whose name ends so come with their text.
MANIFEST_SUFFIX, MANIFEST_BYTES = "manifest.json", 256 << 20


def entries_of(path: str) -> Iterator[tuple]:
    """Rows of one archive; a single row with ``error`` if it cannot be read."""
    try:
        with zipfile.ZipFile(path) as archive:
            for i, info in enumerate(archive.infolist()):
                digest, crc, size, kept, error = hashlib.sha256(), 0, 0, [], None
                wanted = info.filename.endswith(MANIFEST_SUFFIX) and info.file_size <= MANIFEST_BYTES
                try:
                    with archive.open(info) as entry:
                        while piece := entry.read(PIECE):
                            digest.update(piece)
                            crc, size = zlib.crc32(piece, crc), size + len(piece)
                            if wanted:
                                kept.append(piece)
                except zipfile.BadZipFile:
                    error = "crc"
                kind = stat.S_IFMT(info.external_attr >> 16)
                text = b"".join(kept).decode("utf-8", "replace") if wanted and not error else None
                yield path, i, info.filename, not info.is_dir() and kind in (0, stat.S_IFREG), size, digest.hexdigest(), not error and crc == info.CRC, text, error
    except Exception:
        yield path, None, None, None, None, None, None, None, "unreadable"


def entries(paths: DataFrame, workers: int = 8) -> DataFrame:
    """Entries of the archives whose paths, in a folder that executors share, the first column has; one archive a task turn."""
    ship(paths.sparkSession)
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.iloc[:, 0]:
                rows = list(entries_of(path))
                yield pd.DataFrame(rows, columns=names).astype({"position": "Int32", "size_bytes": "Int64", "regular": "boolean", "crc_ok": "boolean"})

    return paths.select(F.col(paths.columns[0]).alias("path")).repartition(workers).mapInPandas(run, ENTRY)
