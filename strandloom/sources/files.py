"""Byte access to local and remote files, and splitting at record borders."""

from __future__ import annotations

import fnmatch
import glob
import gzip
import io
import os
import shutil


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def local_path(path: str) -> str:
    return path[len("file://"):] if path.startswith("file://") else path


def open_binary(path: str):
    """A seekable binary file; gzip is undone, and then it isn't split."""
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        raw = io.BufferedReader(system.open_input_file(inner))
    else:
        raw = open(local_path(path), "rb")
    return gzip.open(raw, "rb") if path.endswith(".gz") else raw


def create_binary(path: str):
    """A new binary file; its folder is made if need be."""
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    local = local_path(path)
    os.makedirs(os.path.dirname(os.path.abspath(local)), exist_ok=True)
    return open(local, "wb")


def exists(path: str) -> bool:
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.get_file_info(inner).type != fs.FileType.NotFound
    return os.path.exists(local_path(path))


def is_folder(path: str) -> bool:
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.get_file_info(inner).type == fs.FileType.Directory
    return os.path.isdir(local_path(path))


def remove(path: str) -> None:
    """Removes a file, or a folder with what is in it, if it is there."""
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        kind = system.get_file_info(inner).type
        if kind == fs.FileType.Directory:
            system.delete_dir(inner)
        elif kind != fs.FileType.NotFound:
            system.delete_file(inner)
    elif is_folder(path):
        shutil.rmtree(local_path(path))
    elif exists(path):
        os.remove(local_path(path))


def size(path: str) -> int:
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.get_file_info(inner).size
    return os.path.getsize(local_path(path))


def _matching(pattern: str) -> list[str]:
    if not _remote(pattern):
        return sorted(glob.glob(local_path(pattern)))
    from pyarrow import fs

    where, _, last = pattern.rpartition("/")
    system, inner = fs.FileSystem.from_uri(where)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f"{where}/{f.base_name}" for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, last))


def expand(paths: str) -> list[str]:
    """Paths of a comma-separated list, globs expanded; of remote paths the last part may be one."""
    out: list[str] = []
    for p in paths.split(","):
        out += _matching(p) if any(c in (p.rpartition("/")[2] if _remote(p) else p) for c in "*?[") else [p]
    return out


def splits(path: str, target: int) -> list[tuple[int, int]]:
    """Byte ranges of about ``target`` bytes; one for a gzipped file."""
    if path.endswith(".gz"):
        return [(0, 1 << 62)]
    n = size(path)
    return [(a, min(a + target, n)) for a in range(0, max(n, 1), target)]


def sniff(path: str) -> str:
    """``fastq`` or ``fasta`` by the first byte."""
    with open_binary(path) as f:
        first = f.read(1)
    kind = {b"@": "fastq", b">": "fasta"}.get(first)
    if kind is None:
        raise ValueError(f"{path} is neither FASTQ nor FASTA")
    return kind
