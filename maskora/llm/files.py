"""Files in the shared folder, by URI, for tasks and driver alike."""

from __future__ import annotations

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def create(path: str):
    """An output stream; missing folders are made."""
    where, name = _place(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    return where.open_output_stream(name, compression=None)


def open_file(path: str):
    """A seekable input file."""
    where, name = _place(path)
    return where.open_input_file(name)


def local_path(path: str) -> str | None:
    """The path for the operating system, where the file lies in a mounted folder."""
    where, name = _place(path)
    return name if isinstance(where, fs.LocalFileSystem) else None


def range_read(source, at: int, n: int) -> bytes:
    source.seek(at)
    return source.read(n)
