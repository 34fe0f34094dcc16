"""Files that tasks write into the shared folder and others read again."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    store, path = locate(uri)
    store.create_dir(path, recursive=True)
    return uri


def write_bytes(uri: str, data: bytes) -> None:
    store, path = locate(uri)
    with store.open_output_stream(path, compression=None) as f:
        f.write(data)


def read_bytes(uri: str) -> bytes:
    store, path = locate(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


class Rolling:
    """Writes blocks to files of a folder, a new file after ``most`` bytes.

    Each task attempt names its files anew, so attempts that fail or run twice leave
    files that no manifest row mentions, and never touch those of another.
    """

    def __init__(self, folder: str, suffix: str, most: int):
        self.store, self.path = locate(folder)
        self.folder, self.suffix, self.most = folder.rstrip("/"), suffix, most
        self.stream, self.uri, self.at = None, "", 0

    @property
    def open(self) -> bool:
        return self.stream is not None

    @property
    def full(self) -> bool:
        return self.open and self.at >= self.most

    def start(self) -> None:
        name = uuid.uuid4().hex + self.suffix
        self.uri, self.at = f"{self.folder}/{name}", 0
        self.stream = self.store.open_output_stream(f"{self.path}/{name}", compression=None)

    def write(self, data: bytes) -> int:
        """Returns where ``data`` starts."""
        where = self.at
        self.stream.write(data)
        self.at += len(data)
        return where

    def close(self) -> tuple[str, int]:
        self.stream.close()
        self.stream = None
        return self.uri, self.at
