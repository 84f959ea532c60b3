"""Files that tasks open themselves, because they need parts of them that Spark's readers don't give: by pyarrow's file systems."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyarrow import fs

#: A file of this name lists the files that a finished write left in its folder, one name a line.
MANIFEST = "_manifest"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within it."""
    path = re.sub(r"^s3[an]:", "s3:", path)
    if re.match(r"^(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def files_of(path: str, ending: str) -> list[str]:
    """The file itself, or the files of a folder that end so, by name; where a write left its manifest, that decides."""
    where, inner = located(path)
    if where.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = _listed(where, inner.rstrip("/"))
    names = _names(where, inner) if names is None else names
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(ending)]


def folders_of(path: str, start: str, mark: str) -> list[str]:
    """Folders of a folder whose names start so and that hold a file, by name."""
    where, inner = located(path)
    if where.get_file_info(inner).type != fs.FileType.Directory:
        return []
    names = [x.base_name for x in where.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.Directory and x.base_name.startswith(start)]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if where.get_file_info(f"{inner.rstrip('/')}/{n}/{mark}").type == fs.FileType.File]


def attempt(name: str, job: str) -> str:
    """A name of this job's and this attempt's own, so that a repeated task never writes into another's file."""
    stem, dot, ending = name.rpartition(".")
    return f"{stem or ending}-{job}-{uuid.uuid4().hex}{dot}{ending if stem else ''}"


def _names(where: fs.FileSystem, folder: str) -> list[str]:
    return [x.base_name for x in where.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File and not x.base_name.startswith("_")]


def _listed(where: fs.FileSystem, folder: str) -> set[str] | None:
    if where.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.File:
        return None
    with where.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return set(f.read().decode().splitlines())


def commit_named(path: str, names: Iterable[tuple[str, str]], job: str) -> None:
    """Gives the files that count, (name, name of the attempt's file), their names, adds them to the folder's list and removes those of the job's other attempts. A name that two tasks have is an error."""
    where, inner = located(path)
    inner, pairs = inner.rstrip("/"), list(names)
    if len({n for n, _ in pairs}) < len(pairs):
        raise ValueError("two tasks wrote a file of one name")
    where.create_dir(inner, recursive=True)
    present = _names(where, inner)
    earlier = _listed(where, inner)
    earlier = {n for n in present if job not in n} if earlier is None else earlier
    for name, own in pairs:
        if name != own:
            where.move(f"{inner}/{own}", f"{inner}/{name}")
    kept = {n for n, _ in pairs}
    with where.open_output_stream(f"{inner}/{MANIFEST}.tmp") as f:
        f.write("".join(f"{n}\n" for n in sorted(earlier | kept)).encode())
    where.move(f"{inner}/{MANIFEST}.tmp", f"{inner}/{MANIFEST}")
    for n in _names(where, inner):
        if job in n and n not in kept:
            where.delete_file(f"{inner}/{n}")


def commit(path: str, names: Iterable[str], job: str) -> None:
    """Adds the files that count to the folder's list and removes those of the job's attempts that don't."""
    commit_named(path, [(n, n) for n in names], job)


def discard_job(path: str, job: str) -> None:
    """Removes all files of a job that failed."""
    where, inner = located(path)
    inner = inner.rstrip("/")
    if where.get_file_info(inner).type == fs.FileType.Directory:
        for n in _names(where, inner):
            if job in n:
                where.delete_file(f"{inner}/{n}")
