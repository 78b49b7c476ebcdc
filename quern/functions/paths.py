"""Names of files and addresses that are safe to use."""

from __future__ import annotations

import ipaddress
import posixpath
import re
import unicodedata

# Names that some file systems keep for devices.
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}


def safe_filename(name: str | None, most: int = 120) -> str:
    """The last part of a name in compatibility form, without characters that file systems refuse."""
    n = unicodedata.normalize("NFKC", name or "").replace("\\", "/").rsplit("/", 1)[-1]
    n = re.sub(r'[\x00-\x1f<>:"|?*]', "_", n).strip(" .")
    stem, dot, ext = n.rpartition(".")
    if not dot:
        stem, ext = n, ""
    if stem.lower() in RESERVED:
        stem = f"_{stem}"
    room = most - len(dot + ext)
    return (stem[: max(1, room)] + dot + ext) or "untitled"


def leaves_folder(path: str) -> bool:
    """Whether a relative path names something outside its folder."""
    p = path.replace("\\", "/")
    return p.startswith("/") or bool(re.match("[A-Za-z]:", p)) or posixpath.normpath(p).startswith("..") or "\0" in p


def safe_join(folder: str, path: str) -> str:
    if leaves_folder(path):
        raise ValueError(f"{path} leaves its folder")
    return posixpath.join(folder, posixpath.normpath(path.replace("\\", "/")))


def address_kind(host: str) -> str:
    """public, private or name; private covers loopback, link-local, reserved and benchmark ranges."""
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return "private" if host.lower() in ("localhost", "") or host.lower().endswith((".local", ".internal")) else "name"
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return "public" if ip.is_global and not ip.is_multicast else "private"


def url_problem(url: str) -> str | None:
    """Why an address can't be fetched, or None."""
    m = re.match(r"(?i)^(https?)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?", url.strip())
    if not m:
        return "scheme"
    if m[2]:
        return "credentials"
    if m[4] and not 0 < int(m[4]) < 65536:
        return "port"
    return "address" if address_kind(m[3]) == "private" else None
