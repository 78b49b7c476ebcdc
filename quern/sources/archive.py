"""Reading of zip containers within limits that hold whatever the archive claims."""

from __future__ import annotations

import io
import stat
import zipfile
from dataclasses import dataclass


class UnsafeArchive(ValueError):
    """An archive that breaks a limit or has unsafe names."""


@dataclass(frozen=True)
class Limits:
    entries: int = 5000
    entry_bytes: int = 50 << 20
    total_bytes: int = 200 << 20
    ratio: int = 100


def _unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or "\0" in name


class Container:
    """A checked zip file; every read counts the bytes that really come out."""

    def __init__(self, data: bytes, limits: Limits = Limits()) -> None:
        self.zip, self.limits, self.spent = zipfile.ZipFile(io.BytesIO(data)), limits, 0
        infos = self.zip.infolist()
        self.names = [i.filename for i in infos]
        declared = sum(i.file_size for i in infos)
        problems = [
            (len(infos) > limits.entries, "too many entries"),
            (len(set(self.names)) < len(infos), "repeated names"),
            (any(_unsafe(n) for n in self.names), "names that leave the archive"),
            (any(stat.S_ISLNK(i.external_attr >> 16) for i in infos), "links"),
            (any(i.file_size > limits.entry_bytes for i in infos), "an entry that is too large"),
            (declared > limits.total_bytes, "too much data"),
            (any(i.file_size > limits.ratio * max(i.compress_size, 1) and i.file_size > 1 << 16 for i in infos), "an entry that is compressed too much"),
        ]
        for bad, what in problems:
            if bad:
                raise UnsafeArchive(f"the archive has {what}")

    def read(self, name: str) -> bytes | None:
        if name not in self.names:
            return None
        with self.zip.open(name) as f:
            data = f.read(self.limits.entry_bytes + 1)
        self.spent += len(data)
        if len(data) > self.limits.entry_bytes or self.spent > self.limits.total_bytes:
            raise UnsafeArchive("the archive has more data than it declares")
        return data
