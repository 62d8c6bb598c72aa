"""How a job's files become part of an output folder: one manifest per commit.

Tasks write files under names nobody else uses.  A commit puts one JSON file
with their names into ``_commits`` of the output, written aside and then moved,
so readers see all files of a job or none.  Manifests have names of their own:
two jobs that commit at once both stay, in the order of their commit times.

A commit may replace what was there: it hides all earlier manifests from the
moment it is in place, and only then are the old files deleted.  A commit with
a key (a stream's batch) is done once: a second one of the same key is dropped.
"""

from __future__ import annotations

import json
import time
import uuid

from pyarrow import fs

from arcloom.sources import files

FOLDER = "_commits"
UNCOMMITTED = "_job-"  # folders of jobs: only what a manifest names in them counts


def new_job() -> str:
    return uuid.uuid4().hex[:16]


def job_folder(job: str) -> str:
    return f"{UNCOMMITTED}{job}"


def _manifests(system: fs.FileSystem, root: str) -> list[str]:
    """Paths of manifests in the order of their commits."""
    folder = f"{root}/{FOLDER}"
    if system.get_file_info(folder).type != fs.FileType.Directory:
        return []
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".json"))


def _read(system: fs.FileSystem, path: str) -> dict:
    with system.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


def committed(path: str) -> list[str] | None:
    """Names of the files that count, in the order of commits, relative to the folder; None without any manifest."""
    system, root = files.locate(path)
    found = _manifests(system, root)
    if not found:
        return None
    names: list[str] = []
    for manifest in (_read(system, m) for m in found):
        names = (manifest["files"] if manifest["replaces"] else names + manifest["files"])
    return names


def commit(path: str, job: str, names: list[str], replaces: bool = False, key: str | None = None) -> bool:
    """Make the files of a job part of the folder; False if ``key`` was committed before."""
    system, root = files.locate(path)
    system.create_dir(f"{root}/{FOLDER}", recursive=True)
    before = _manifests(system, root)
    if key is not None and any(m.endswith(f"-key-{key}.json") for m in before):
        discard(path, names)
        return False
    mine = f"{time.time_ns():020d}-{job}" + (f"-key-{key}" if key is not None else "")
    aside = f"{root}/{FOLDER}/{mine}.tmp"
    with system.open_output_stream(aside, compression=None) as f:
        f.write(json.dumps({"files": sorted(names), "replaces": replaces}).encode())
    system.move(aside, f"{root}/{FOLDER}/{mine}.json")
    if replaces:  # what is hidden now can go
        for manifest in before:
            discard(path, _read(system, manifest)["files"])
            system.delete_file(manifest)
    return True


def discard(path: str, names: list[str]) -> None:
    """Delete files of a job that does not count; those that are not there are no error."""
    system, root = files.locate(path)
    for name in names:
        if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            system.delete_file(f"{root}/{name}")
