"""Source files: contained paths, evidence read in pieces, PDF checks, free space."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.constraints import path_violation
from ..shipping import ship

PIECE = 1 << 20


def contained(root: str, relative: str) -> str | None:
    """The real path of a regular file inside ``root``; None if the path leads elsewhere or to nothing."""
    try:
        base = Path(root).resolve(strict=True)
        found = (base / relative).resolve(strict=True)
    except (OSError, RuntimeError, ValueError):
        return None
    return str(found) if base.is_dir() and found.is_relative_to(base) and found.is_file() else None


def evidence_of(path: str) -> tuple[int, str]:
    """Size and SHA-256, in pieces of constant size."""
    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            digest.update(piece)
            size += len(piece)
    return size, digest.hexdigest()


def pdf_pages(path: str) -> int:
    """Pages of a sound PDF that is not encrypted; ValueError for any other file."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise RuntimeError("PDF checks need the pypdf library, which is not available") from None
    try:
        reader = PdfReader(path, strict=True)
        if reader.is_encrypted:
            raise ValueError
        for page in reader.pages:
            page.mediabox  # noqa: B018
        if not len(reader.pages):
            raise ValueError
        return len(reader.pages)
    except Exception:
        raise ValueError("the file is no sound PDF") from None


def inspect(members: DataFrame, root: str, workers: int = 4, check_pdf: bool = True) -> DataFrame:
    """``members`` (source_path, size_bytes, sha256, member_path) with ``issue``: null, or path, content, pdf or pdf_unchecked.

    ``root`` is a folder that all executors share. A file is read in pieces by one task; files are dealt over ``workers``.
    """
    ship(members.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            issues = []
            for path, refused, size, sha, member in zip(batch.source_path, batch.refused, batch.size_bytes, batch.sha256, batch.member_path, strict=True):
                found = None if refused else contained(root, path)
                issue = "path" if found is None else "content" if evidence_of(found) != (size, sha.lower()) else None
                if issue is None and check_pdf and member.lower().endswith(".pdf"):
                    try:
                        pdf_pages(found)
                    except RuntimeError:
                        issue = "pdf_unchecked"
                    except ValueError:
                        issue = "pdf"
                issues.append(issue)
            yield batch.assign(issue=issues)[["source_path", "member_path", "issue"]]

    ready = members.select("source_path", "size_bytes", "sha256", "member_path", path_violation(F.col("source_path")).isNotNull().alias("refused"))
    return ready.repartition(workers).mapInPandas(run, "source_path string, member_path string, issue string")


def free_bytes(path: str) -> int:
    """Free space of the nearest folder that exists."""
    at = Path(path).absolute()
    while not at.exists():
        at = at.parent
    return shutil.disk_usage(at).free


def is_plain_output(path: str, folder: str) -> bool:
    """A regular file inside the folder, and no link."""
    return not os.path.islink(path) and os.path.isfile(path) and Path(path).resolve().is_relative_to(Path(folder).resolve())
