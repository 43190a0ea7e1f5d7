"""Files in the shared store, read and written inside tasks by URI
(``file:``, ``hdfs:``, ``s3:``, ``gs:`` or a plain path)."""

from __future__ import annotations

import json
import re

from pyarrow import fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    path = re.sub(r"^file:/(?!//)/*", "file:///", path)
    path = re.sub(r"^s3[an]://", "s3://", path)
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path.rstrip("/"))
    return pafs.LocalFileSystem(), path.rstrip("/")


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write a file; its folder is made where the store has folders."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)


def put_whole(fs: pafs.FileSystem, path: str, data: dict) -> None:
    """Write a JSON file that readers see whole or not at all: under a hidden
    name first, then renamed."""
    folder, name = path.rsplit("/", 1)
    put(fs, f"{folder}/.{name}", json.dumps(data).encode())
    fs.move(f"{folder}/.{name}", path)


def get_json(fs: pafs.FileSystem, path: str):
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def names(fs: pafs.FileSystem, folder: str) -> list[str]:
    """Visible names in a folder, sorted; none if it does not exist."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(i.base_name for i in found if not i.base_name.startswith("."))


# functions used in tasks travel with them (see shipping.py)
from ..shipping import ship_by_value  # noqa: E402

ship_by_value(__name__)
