"""What a DataFrame can't do to a store: list a small folder, read a small file, claim a name."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def names(folder: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    store, base = store_of(folder)
    return [e.base_name for e in store.get_file_info(fs.FileSelector(base, allow_not_found=True))]


def read(path: str) -> bytes:
    store, base = store_of(path)
    with store.open_input_stream(base) as f:
        return f.read()


def _put(store: fs.FileSystem, base: str, data: bytes) -> None:
    store.create_dir(os.path.dirname(base), recursive=True)
    with store.open_output_stream(base) as f:
        f.write(data)


def write(path: str, data: bytes) -> None:
    """Put a whole file there; its folder is made."""
    _put(*store_of(path), data)


def create_new(path: str, data: bytes) -> bool:
    """Put a file in place whole if none has its name; of several writers one gets True.

    Needs a store in which one such operation is atomic: a link on a mounted file system, a rename
    that does not replace on HDFS. Others are refused.
    """
    store, base = store_of(path)
    if store.type_name not in ("local", "hdfs"):
        raise NotImplementedError(f"{store.type_name} can't create a file only if it is absent")
    if store.get_file_info(base).type != fs.FileType.NotFound:
        return False
    draft = f"{base}.{uuid.uuid4().hex}"
    _put(store, draft, data)
    try:
        if store.type_name == "local":
            os.link(draft, base)
        else:
            store.move(draft, base)
    except OSError:
        if store.get_file_info(base).type != fs.FileType.NotFound:
            return False
        raise
    finally:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
    return True
