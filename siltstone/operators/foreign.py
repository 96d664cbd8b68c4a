"""Common archive formats written and read for comparison: deterministic, bounded, and safe to extract."""

from __future__ import annotations

import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib

import zstandard
from pyspark.sql import DataFrame

from ..functions.columns import RESERVED

#: Bytes that one archive may hold when it is opened.
MOST_BYTES = 1 << 30
_bad = re.compile(r'[<>:"\\|?*\x00-\x1f]|[ .]$')


class Unsafe(ValueError):
    """An archive that isn't to be extracted."""


def check_path(path: str, seen: set[str]) -> None:
    """An error for a path that isn't portable or collides with one that was seen."""
    for part in path.split("/"):
        if part in ("", ".", "..") or _bad.search(part) or part.split(".", 1)[0].upper() in RESERVED:
            raise Unsafe(f"{path!r} isn't portable")
    if path.casefold() in seen:
        raise Unsafe(f"{path!r} comes twice")
    seen.add(path.casefold())


def _tar(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for path, content in entries:
            info = tarfile.TarInfo(path)
            info.size, info.mode, info.mtime = len(content), 0o644, 0
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def _untar(data: bytes) -> list[tuple[str, bytes]]:
    out, seen, size = [], set(), 0
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for info in tar:
            if not info.isfile():
                raise Unsafe(f"{info.name!r} isn't a file")
            check_path(info.name, seen)
            size += info.size
            if size > MOST_BYTES:
                raise Unsafe("more bytes than one archive may hold")
            out.append((info.name, tar.extractfile(info).read()))
    return out


def _zip(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as archive:
        for path, content in entries:
            archive.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED, 6)
    return out.getvalue()


def _unzip(data: bytes) -> list[tuple[str, bytes]]:
    out, seen, size = [], set(), 0
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if info.is_dir() or (info.external_attr >> 16) & 0o170000 not in (0, 0o100000):
                raise Unsafe(f"{info.filename!r} isn't a file")
            check_path(info.filename, seen)
            with archive.open(info) as f:
                content = f.read(MOST_BYTES - size + 1)
            size += len(content)
            if size > MOST_BYTES:
                raise Unsafe("more bytes than one archive may hold")
            out.append((info.filename, content))
    return out


def _bounded(reader) -> bytes:
    data = reader.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise Unsafe("more bytes than one archive may hold")
    return data


#: name: (write entries of (path, content), read them again).
FORMATS = {
    "zip": (_zip, _unzip),
    "tar.gz": (lambda e: gzip.compress(_tar(e), 6, mtime=0), lambda b: _untar(_bounded(gzip.GzipFile(fileobj=io.BytesIO(b))))),
    "tar.zst": (lambda e: zstandard.ZstdCompressor(level=3).compress(_tar(e)), lambda b: _untar(_bounded(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(b))))),
    "tar.xz": (lambda e: lzma.compress(_tar(e), preset=1), lambda b: _untar(_bounded(lzma.LZMAFile(io.BytesIO(b))))),
}


def pack(entries: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, files, original_size, archive_size, archive): one archive per group of entries (group, path, content), by path.

    A group is one task and one array, as the format demands; give groups of bounded size. Null content is an empty file;
    paths that aren't portable or collide are an error.
    """
    write = FORMATS[kind][0]
    of = entries.schema[group].dataType.simpleString()

    def make(pdf):
        import pandas as pd

        pdf, seen = pdf.sort_values("path"), set()
        files = [(p, bytes(c) if c is not None else b"") for p, c in zip(pdf["path"], pdf["content"])]
        for path, _ in files:
            check_path(path, seen)
        data = write(files)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "files": [len(files)], "original_size": [sum(len(c) for _, c in files)], "archive_size": [len(data)], "archive": [data]})

    return entries.select(group, "path", "content").groupBy(group).applyInPandas(make, f"{group} {of}, files bigint, original_size bigint, archive_size bigint, archive binary")


def unpack(archives: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, path, content) of the files of archives (group, archive). Paths that aren't portable, come twice or are no plain
    files, damage, and more than MOST_BYTES are errors."""
    read = FORMATS[kind][1]
    of = archives.schema[group].dataType.simpleString()

    def opened(frames):
        import pandas as pd

        for pdf in frames:
            for who, data in zip(pdf[group], pdf["archive"]):
                try:
                    files = read(bytes(data))
                except (zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zstandard.ZstdError, zlib.error, OSError, EOFError) as e:
                    raise Unsafe(f"a damaged archive: {e}") from e
                yield pd.DataFrame({group: [who] * len(files), "path": [p for p, _ in files], "content": [c for _, c in files]})

    return archives.select(group, "archive").mapInPandas(opened, f"{group} {of}, path string, content binary")
