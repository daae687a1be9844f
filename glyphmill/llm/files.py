"""Files in the shared folder: written under temporary names, then renamed; opened by URI from any task."""

from __future__ import annotations

import uuid


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Sink:
    """A file that gets its name only when it is complete; an attempt that dies leaves a temporary name."""

    def __init__(self, folder: str, name: str):
        self.fs, base = open_fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = f"{base}/{name}"
        self.temp = f"{base}/_tmp-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)


def read(folder: str, name: str) -> bytes:
    fs, base = open_fs(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        return f.read()


def put(folder: str, name: str, data: bytes) -> None:
    sink = Sink(folder, name)
    sink.write(data)
    sink.commit()
