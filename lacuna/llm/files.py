"""Files on storage that driver and executors share, by URI, written under a temporary name and moved when whole."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else "file://" + uri)


class Whole:
    """A file that appears under its name only when :meth:`commit` is called; a repeated attempt puts the same bytes there."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = opened(folder)
        self.name = name
        self.fs.create_dir(self.folder, recursive=True)
        self.hidden = f"{self.folder}/_{name}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.hidden, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.hidden, f"{self.folder}/{self.name}")

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.hidden)
