"""Scanning file trees and extracting text.

The listing holds paths, sizes and times only; the executors walk the tree
below its upper levels. Contents are read by the executors, one file at a time,
and only for files whose size or time changed.
"""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.config import MAX_FILE_BYTES, Config
from tarnfold.errors import ExtractionFailed
from tarnfold.functions.exif import exif_text
from tarnfold.functions.paths import base_name, file_type, glob_regex, suffix, supported

SCANNED = "path string, file_size long, mtime double"


#: Directories that the driver opens at most before executors walk the rest.
OPENED = 64


def _entries(folder: str) -> tuple[list[tuple[str, int, float]], list[str]]:
    """Files and directories of one directory; what can't be read is left out, links to directories are not followed."""
    files, folders = [], []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        folders.append(entry.path)
                    elif entry.is_file():
                        s = entry.stat()
                        files.append((os.path.realpath(entry.path), s.st_size, s.st_mtime))
                except OSError:
                    continue
    except OSError:
        pass
    return files, folders


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All regular files below ``root`` (or the one file), resolved, with size and time; other paths give none.

    The driver opens directories from the top until there are enough; the
    executors walk what lies below these, each directory a task of its own.
    """
    root = os.path.realpath(root)
    if os.path.isfile(root):
        return spark.createDataFrame([(root, os.stat(root).st_size, os.stat(root).st_mtime)], SCANNED)
    rows, folders = [], [root]
    while folders and len(folders) < OPENED:
        level, folders = folders, []
        for folder in level:
            files, below = _entries(folder)
            rows += files
            folders += below
    top = spark.createDataFrame(rows, SCANNED)
    if not folders:
        return top

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            todo = list(batch["folder"])
            while todo:
                files, below = _entries(todo.pop())
                todo += below
                if files:
                    yield pd.DataFrame(files, columns=["path", "file_size", "mtime"])

    below = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders), "folder").mapInPandas(run, SCANNED)
    return top.unionByName(below)


def stated(paths: DataFrame) -> DataFrame:
    """The paths that are files now, with size and time, as a listing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    if os.path.exists(path):
                        s = os.stat(path)
                        rows.append((path, s.st_size, s.st_mtime))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "file_size", "mtime"])

    return paths.select("path").mapInPandas(run, SCANNED)


def scan(files: DataFrame, config: Config, root: str = "", strict_hidden: bool = False, limit: int | None = None) -> DataFrame:
    """The files of a listing that are indexed, in the order of their path components.

    Hidden names are left out below ``root`` (with ``strict_hidden`` anywhere in
    the path), as are files above 50 MiB, excluded names and unknown suffixes.
    """
    below = F.col("path") if strict_hidden or not root else F.expr(f"substring(path, {len(os.path.realpath(root)) + 1})")
    kept = files.where(~below.rlike(r"(?:^|/)\.[^/]") & (F.col("file_size") <= MAX_FILE_BYTES) & suffix(F.col("path")).isin(supported(config.vision_backend != "none")))
    if config.excluded:
        kept = kept.where(~base_name(F.col("path")).rlike(glob_regex(config.excluded)))
    kept = kept.orderBy(F.split("path", "/"))
    return kept.limit(limit) if limit is not None else kept


def docx_text(path: str) -> str:
    """Non-blank body paragraphs of a DOCX file, parted by blank lines."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(path) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{space}body")
    except Exception as e:
        raise ExtractionFailed(path, str(e)) from e
    out = []
    for p in [] if body is None else body.findall(f"{space}p"):
        text = "".join(n.text or "" if n.tag == f"{space}t" else "\t" if n.tag == f"{space}tab" else "\n" if n.tag in (f"{space}br", f"{space}cr") else "" for n in p.iter())
        if text.strip():
            out.append(text)
    return "\n\n".join(out)


def pdf_text(path: str) -> str:
    try:
        import pymupdf4llm
    except ImportError as e:
        raise ExtractionFailed(path, "no PDF library") from e
    try:
        return pymupdf4llm.to_markdown(path)
    except Exception as e:
        raise ExtractionFailed(path, str(e)) from e


def exif_of(path: str) -> str:
    """The EXIF line of a picture; never raises."""
    try:
        from PIL import Image
        from PIL.ExifTags import GPSTAGS

        with Image.open(path) as image:
            tags = image.getexif()
            return exif_text(dict(tags), {GPSTAGS.get(k, k): v for k, v in tags.get_ifd(0x8825).items()}, image.size)
    except Exception:
        return ""


def captioned(path: str, kind: str, captioner) -> str:
    if captioner is None:
        raise ExtractionFailed(path, "no caption backend configured")
    try:
        with open(path, "rb") as file:
            data = file.read()
    except OSError as e:
        raise ExtractionFailed(path, str(e)) from e
    lines = [f"[File] {os.path.basename(path)}", exif_of(path) if kind == "image" else "", f"[Caption] {captioner.caption(path, data, kind)}"]
    return "\n".join(x for x in lines if x)


def plain_text(path: str) -> str:
    """UTF-8 text with invalid bytes as U+FFFD and all line ends as line feeds."""
    try:
        with open(path, encoding="utf-8", errors="replace") as file:
            return file.read()
    except OSError as e:
        raise ExtractionFailed(path, str(e)) from e


def checksum(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 16):
            digest.update(block)
    return digest.hexdigest()


def checksums(paths: DataFrame) -> DataFrame:
    """path, checksum (null where a file can't be read) of files that all executors reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["path"]:
                try:
                    out.append(checksum(p))
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "checksum": out})

    return paths.select("path").mapInPandas(run, "path string, checksum string")


def extract(paths: DataFrame, config: Config) -> DataFrame:
    """path, text, error of each file; a failing file has an error row and stops nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tarnfold.sources.vision import backend

        captioner = backend(config)
        for batch in batches:
            rows = []
            for path, kind in zip(batch["path"], batch["file_type"]):
                try:
                    if kind == "pdf":
                        text = pdf_text(path)
                    elif kind == "docx":
                        text = docx_text(path)
                    elif kind in ("image", "video"):
                        text = captioned(path, kind, captioner)
                    else:
                        text = plain_text(path)
                    rows.append((path, text, None))
                except ExtractionFailed as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return paths.select("path", file_type(F.col("path")).alias("file_type")).mapInPandas(run, "path string, text string, error string")
