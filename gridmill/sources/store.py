"""Files in a store: paths and URIs that driver and tasks open alike, through pyarrow's file systems."""

from __future__ import annotations

from urllib.parse import quote, urlsplit

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file:, hdfs:, s3:, gs:, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def found(uri: str, end: str) -> list[str]:
    """The file at a path or URI, or all files under it whose names end so, in order and as opened()
    takes them; hidden ones are left out."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type == fs.FileType.NotFound:
        return []
    files = store.get_file_info(fs.FileSelector(path, recursive=True))
    paths = sorted(f.path for f in files if f.type == fs.FileType.File and f.base_name.endswith(end) and not f.base_name.startswith(("_", ".")))
    if ":/" not in uri:
        return paths
    url = urlsplit(uri)
    # of some stores the first part of the path is the host of the URI
    head = f"{url.scheme}://{url.netloc}" if path.startswith("/") else f"{url.scheme}://"
    return [head + quote(p) + (f"?{url.query}" if url.query else "") for p in paths]


def read(uri: str) -> bytes | None:
    """A small file's bytes; None if there is no such file."""
    store, path = opened(uri)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_file(path) as f:
        return f.read()


def replace(uri: str, data: bytes) -> None:
    """Writes a small file whole: a reader finds the old one or the new one."""
    store, path = opened(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path + ".new") as f:
        f.write(data)
    store.move(path + ".new", path)


def remove(uri: str) -> None:
    """Removes a folder, if it is there."""
    store, path = opened(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)
