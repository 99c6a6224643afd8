"""Files anywhere pyarrow reaches: local paths and URIs."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow.fs as pafs

from lexarium.errors import NotFound


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else pafs.FileSystem.from_uri("/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else (pafs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    fs, at = locate(path)
    return fs.get_file_info(at).is_file


def size(path: str) -> int:
    fs, at = locate(path)
    return fs.get_file_info(at).size or 0


def read(path: str, start: int = 0, length: int | None = None) -> bytes:
    """The whole file, or a range of it."""
    fs, at = locate(path)
    if not fs.get_file_info(at).is_file:
        raise NotFound(path)
    with fs.open_input_file(at) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def beside(path: str) -> list[str]:
    """The files of the folder that share the stem of ``path``, with it."""
    stem = path.rsplit(".", 1)[0]
    return [f for f in listing(path.rsplit("/", 1)[0]) if f.startswith(stem + ".")]


def listing(path: str) -> list[str]:
    """The files of a folder, not of those below it, by name; a file itself."""
    fs, at = locate(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise NotFound(path)
    if info.is_file:
        return [path]
    base = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(base + i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.is_file)


def write(path: str, data: bytes) -> None:
    write_parts(path, [data])


def write_parts(path: str, parts: Iterable[bytes]) -> None:
    """Written beside its place and then moved, so that no reader sees a part of it."""
    fs, at = locate(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at + ".tmp", compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(at + ".tmp", at)


def copy(source: str, target: str) -> None:
    write(target, read(source))


def remove(path: str) -> None:
    fs, at = locate(path)
    if not fs.get_file_info(at).is_file:
        raise NotFound(path)
    fs.delete_file(at)
