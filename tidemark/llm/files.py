"""Binary files in the shared folder, from executors' Python: by pyarrow's file systems, local or remote."""

from __future__ import annotations

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, parts) -> int:
    """Writes the bytes objects of ``parts`` to a new file; it has its name only once it is whole. Returns its size."""
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    n = 0
    with system.open_output_stream(f"{path}.tmp") as out:
        for part in parts:
            out.write(part)
            n += len(part)
    system.move(f"{path}.tmp", path)
    return n


def read_range(uri: str, start: int, length: int) -> bytes:
    system, path = located(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, start)
