"""Task-side file access, local or by URI."""

from __future__ import annotations

import re
from typing import BinaryIO

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
    return fs.LocalFileSystem(), path


def exists(path: str) -> bool:
    system, p = locate(path)
    return system.get_file_info(p).type != fs.FileType.NotFound


def size(path: str) -> int:
    system, p = locate(path)
    return system.get_file_info(p).size


def open_input(path: str) -> BinaryIO:
    system, p = locate(path)
    return system.open_input_file(p)


def open_output(path: str) -> BinaryIO:
    system, p = locate(path)
    parent = p.rpartition("/")[0]
    if parent:
        system.create_dir(parent, recursive=True)
    return system.open_output_stream(p, compression=None)  # else .gz would be packed twice


def archives_in(path: str) -> list[str]:
    """Archive files below a folder; a file stands for itself.

    Where a folder was written with commits, its files are those of its
    manifests, in the order of commits.  Others are sorted by name.
    """
    return [f for f, _ in sized_archives_in(path)]


def sized_archives_in(path: str) -> list[tuple[str, int]]:
    """The same with the size of each file, as the listing of the folder has it."""
    from arcloom.sources import commits

    system, p = locate(path)
    info = system.get_file_info(p)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = {f.path: f.size for f in system.get_file_info(fs.FileSelector(p, recursive=True)) if f.type == fs.FileType.File}
    prefix = path[: len(path) - len(p)] if path.endswith(p) else ""
    marker = f"/{commits.FOLDER}/"
    roots = sorted({f.partition(marker)[0] for f in found if marker in f and f.endswith(".json")})
    loose = [f for f in found if f.endswith((".warc", ".warc.gz")) and "/" + commits.UNCOMMITTED not in f
             and not any(f.startswith(root + "/") for root in roots)]
    listed = [(root, f"{root}/{name}") for root in roots for name in commits.committed(prefix + root) or []]
    # outputs among loose files take the place of their folder's name
    return [(prefix + f, found[f] if f in found else system.get_file_info(f).size) for _, _, f in sorted(
        [(f, 0, f) for f in loose] + [(root, n, f) for n, (root, f) in enumerate(listed)])]
