"""Files as tasks see them: listed and opened by URI on the workers, local ones directly, others through pyarrow.

Stores beyond the local one (s3, gs, abfs, hdfs) need credentials of their own on the workers.
"""

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO, NamedTuple

_URI = re.compile(r"(?s)([\w+.-]+):(?://([^/]*))?(/.*)")


class Entry(NamedTuple):
    path: str
    is_folder: bool
    length: int
    modified: int | None  # microseconds since 1970


@lru_cache(maxsize=64)
def _system(scheme: str, authority: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0]


def _located(uri: str):
    """The file system (None for local files) and the name there."""
    scheme, authority, name = _URI.fullmatch(uri).groups()
    if scheme == "file":
        return None, name
    scheme = re.sub("^s3[an]$", "s3", scheme)
    return _system(scheme, authority or ""), name if scheme in ("hdfs", "viewfs") else f"{authority}{name}"


def open_file(uri: str) -> BinaryIO:
    """The file, open for reads at any place. FileNotFoundError if it is gone."""
    system, name = _located(uri)
    return open(name, "rb") if system is None else system.open_input_file(name)


def read_range(source: BinaryIO, start: int, size: int) -> bytes:
    """At most `size` bytes from `start` on."""
    source.seek(start)
    parts = []
    while size > 0 and (part := source.read(size)):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def root(uri: str) -> Entry:
    """A folder or file that is named itself; links are followed here."""
    system, name = _located(uri)
    if system is None:
        status = os.stat(name)
        return Entry(uri, os.path.isdir(name), status.st_size, status.st_mtime_ns // 1000)
    info = system.get_file_info(name)
    if info.type.name == "NotFound":
        raise FileNotFoundError(uri)
    return _entry(uri, info)


def _entry(uri: str, info) -> Entry:
    is_folder = info.type.name == "Directory"
    return Entry(uri, is_folder, 0 if is_folder else info.size, info.mtime_ns // 1000 if info.mtime_ns is not None else None)


def entries(uri: str) -> Iterator[Entry]:
    """Folders and files right in a folder, whatever they are called. Links to folders and what is neither are left out."""
    system, name = _located(uri)
    base = uri.rstrip("/")
    if system is not None:
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(name)):
            if info.type.name in ("File", "Directory"):
                yield _entry(f"{base}/{info.base_name}", info)
        return
    with os.scandir(name) as found:
        for entry in found:
            path = f"{base}/{entry.name}"
            if entry.is_dir(follow_symlinks=False):
                yield Entry(path, True, 0, None)
            elif entry.is_file():
                try:
                    status = entry.stat()
                except FileNotFoundError:  # gone by now
                    continue
                yield Entry(path, False, status.st_size, status.st_mtime_ns // 1000)
