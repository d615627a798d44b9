"""Files that tasks write to and read from the shared folder, through Arrow's file systems.

A task gives every file a name of its own and reports it in its rows once it is closed;
a file left by a lost attempt is in no table and so is never read.
"""

from __future__ import annotations

from uuid import uuid4

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def new_file(folder: str, ending: str):
    """A stream to a new file in the folder, and the file's name."""
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid4().hex}{ending}"
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def beside(path: str, ending: str):
    """A stream to a new file next to another one, and its name, which no other attempt gives."""
    system, local = located(path)
    part = f".{uuid4().hex}{ending}"
    return system.open_output_stream(local + part, compression=None), path + part


def index_of(path: str):
    """A stream to the index that belongs to a file of a name of its own."""
    system, local = located(path)
    return system.open_output_stream(local + ".index", compression=None)


def reader(path: str):
    """The file for reads at any place."""
    system, local = located(path)
    return system.open_input_file(local)


def stream(path: str):
    system, local = located(path)
    return system.open_input_stream(local, compression=None)
