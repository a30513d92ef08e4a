"""Data source `mzml`: scans of mzML files of any size, read in ranges of bytes.

A partition is a range of a file.  It holds the spectra whose elements start in it, and reads on beyond its end for the last
of them, so ranges need no index and cut nothing.  Files are opened by Arrow's file systems, from executors too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch
from xml.etree import ElementTree

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from peakfold.sources.schemas import SCANS

START = re.compile(rb"<spectrum[\s>]")
END = b"</spectrum>"
CHUNK = 1 << 20
#: Bytes at a file's end that must hold the end of its root element or of its index.
TAIL = 1 << 12


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (arrow_fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's mzML files, or of those that a pattern in the last part names."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == arrow_fs.FileType.File:
        return [(path, info.size)]
    folder, _, pattern = (inner.rstrip("/"), "", "*.mz[mM][lL]") if info.type == arrow_fs.FileType.Directory else inner.rpartition("/")
    found = system.get_file_info(arrow_fs.FileSelector(folder))
    out = sorted((prefix + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and fnmatch(f.base_name, pattern))
    if not out:
        raise FileNotFoundError(path)
    return out


def elements(f, begin: int, end: int) -> Iterator[bytes]:
    """The spectrum elements that start from begin to end of an open file."""
    f.seek(begin)
    held, at = b"", begin  # at: where held begins in the file
    while True:
        m = START.search(held)
        if m is None:
            keep = max(0, len(held) - 10)  # a tag may be cut in two
            held, at = held[keep:], at + keep
            if at >= end:
                return
            more = f.read(CHUNK)
            if not more:
                return
            held += more
            continue
        if at + m.start() >= end:
            return
        held, at = held[m.start() :], at + m.start()
        seen = 0
        while (stop := held.find(END, seen)) < 0:
            seen = max(0, len(held) - len(END))
            more = f.read(CHUNK)
            if not more:
                raise ValueError("unclosed spectrum: the file is truncated")
            held += more
        stop += len(END)
        yield held[:stop]
        held, at = held[stop:], at + stop


class MzmlReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return [Range(p, a, min(a + self.split, size)) for p, size in listed(self.path) for a in range(0, max(size, 1), self.split)]

    def read(self, part: Range) -> Iterator[tuple]:
        from peakfold.sources.binary import spectrum_row

        names = [c.split(" ")[0] for c in SCANS.split(", ")]
        system, inner = opened(part.path)
        with system.open_input_file(inner) as f:
            size = f.size()
            head = f.read(256)
            encoding = re.search(rb"encoding=[\"']([\w.-]+)", head)
            if part.end >= size:
                f.seek(max(0, size - TAIL))
                if not re.search(rb"</(mzML|indexedmzML)>\s*$", f.read()):
                    raise ValueError("unclosed root element: the file is truncated")
            for e in elements(f, part.begin, part.end):
                node = ElementTree.fromstring(e, ElementTree.XMLParser(encoding=encoding[1].decode() if encoding else None))
                row = spectrum_row(node, part.path.rsplit("/", 1)[-1])
                row["peaks"] = [(p["mz"], p["intensity"]) for p in row["peaks"]]
                yield tuple(row[n] for n in names)


class MzmlSource(DataSource):
    """Options: path (file, folder or pattern), split (bytes of a range, 64 MB unless told otherwise)."""

    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SCANS

    def reader(self, schema) -> MzmlReader:
        return MzmlReader(self.options["path"], int(self.options.get("split", 64 << 20)))
