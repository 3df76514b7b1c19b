"""Files in the shared folder that executors write and read: any file system that Arrow knows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = place(uri)
    fs.create_dir(path, recursive=True)


def files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of committed files below a folder, in order."""
    fs, path = place(uri)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix) and not f.base_name.startswith("."))


@contextmanager
def committed(fs: pafs.FileSystem, path: str):
    """A stream to a file that appears under its name only when whole; a second attempt replaces it."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(part) as stream:
            yield stream
        fs.move(part, path)
    except BaseException:
        try:
            fs.delete_file(part)
        except OSError:
            pass
        raise


class Ranges:
    """Random access to a file by blocks."""

    def __init__(self, fs: pafs.FileSystem, path: str, block: int = 1 << 20):
        self.fs, self.path, self.block = fs, path, block
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.start, self.held = 0, b""

    def read(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        if not n:
            return b""
        if not (self.start <= offset and offset + n <= self.start + len(self.held)):
            self.file.seek(offset)
            self.start, self.held = offset, self.file.read(max(n, self.block))
        at = offset - self.start
        return self.held[at : at + n]

    def reopen(self) -> None:
        self.close()
        self.file = self.fs.open_input_file(self.path)
        self.start, self.held = 0, b""

    def close(self) -> None:
        self.file.close()
