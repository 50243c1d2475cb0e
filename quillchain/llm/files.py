"""Binary files in the shared folder, by URI, on the driver and on executors alike."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of ``file:``, ``hdfs:``, ``s3:`` and the other schemes that Arrow knows."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def create(uri: str):
    """A stream that writes ``uri``; folders are made as needed."""
    where, path = at(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def reader(uri: str):
    """A seekable file that reads ``uri``."""
    where, path = at(uri)
    return where.open_input_file(path)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(URI, size) of the files right below folder ``uri``, in order of name."""
    where, path = at(uri)
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f"{uri.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file and f.base_name.endswith(suffix))


def move(source: str, target: str) -> None:
    where, path = at(source)
    where.move(path, at(target)[1])


def delete(uri: str) -> None:
    where, path = at(uri)
    if where.get_file_info(path).type == fs.FileType.File:
        where.delete_file(path)


def delete_folder(uri: str) -> None:
    where, path = at(uri)
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)


def unique(folder: str, suffix: str) -> str:
    """A name that no other task, nor another attempt of this one, uses."""
    return f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}{suffix}"
