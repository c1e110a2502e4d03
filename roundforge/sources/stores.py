"""File systems that driver and executors share, by the URI of a path."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs

#: Hadoop's names of stores that Arrow opens by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it. A path without a scheme is local; schemes that Arrow lacks go through Hadoop's own library."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")  # taken as it is: names may have characters that a URI must escape
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme in SCHEMES:
        uri = f"{SCHEMES[scheme]}:{rest}"
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        host, _, path = rest.removeprefix("//").partition("/")
        return fs.HadoopFileSystem(f"{scheme}://{host}"), "/" + path


def replace(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Written beside and renamed, so that no reader sees half a file and a repeated write does no harm."""
    replace_by(store, path, [data])


def replace_by(store: fs.FileSystem, path: str, pieces: Iterable[bytes]) -> None:
    """replace() with the file's pieces, one after the other."""
    store.move(_draft(store, path, pieces), path)


def _draft(store: fs.FileSystem, path: str, pieces: Iterable[bytes]) -> str:
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for piece in pieces:
            out.write(piece)
    return draft


def create(store: fs.FileSystem, path: str, data: bytes) -> bool:
    """Makes a file whole or not at all; False if there is one of that name, whoever made it. A hard link locally, else Hadoop's rename, neither of
    which replaces a file; a store without such an operation is an error."""
    kind = store.type_name
    if kind not in ("local", "hdfs"):
        raise ValueError(f"a store of type {kind} can't create a file exclusively")
    draft = _draft(store, path, [data])
    try:
        if kind == "local":
            os.link(draft, path)
        else:
            store.move(draft, path)
        return True
    except OSError:
        if size(store, path) is None:
            raise
        return False
    finally:
        if size(store, draft) is not None:
            store.delete_file(draft)


def size(store: fs.FileSystem, path: str) -> int | None:
    """A file's length; None where there is none."""
    found = store.get_file_info(path)
    return found.size if found.type == fs.FileType.File else None


def kind(uri: str) -> fs.FileType:
    store, path = opened(uri)
    return store.get_file_info(path).type


def text(uri: str) -> str:
    """A small file's text."""
    store, path = opened(uri)
    with store.open_input_stream(path) as f:
        return f.read().decode("utf-8")


def names(uri: str) -> list[str]:
    """The names of what a folder holds: for folders of a known size."""
    store, path = opened(uri)
    return sorted(e.base_name for e in store.get_file_info(fs.FileSelector(path)))
