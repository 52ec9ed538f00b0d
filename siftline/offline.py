"""Guards that keep a deployment without a network from reading remote places, and passive signs of a network."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse


class OfflineError(ValueError):
    """A remote place where only local ones are allowed."""


def reject_remote(path: str, strict: bool = False) -> str:
    """``path``, unless it is on the web; where ``strict`` also unless it is a file of this machine or the cluster's own file system."""
    scheme = urlparse(path).scheme.lower()
    if scheme in ("http", "https", "ftp", "ftps", "sftp") or (strict and scheme not in ("", "file", "hdfs")):
        raise OfflineError(f"remote input isn't allowed: {scheme}")
    return path


def model_path(path: str) -> Path:
    """An absolute local path of a model that is there."""
    if urlparse(path).scheme:
        raise OfflineError("a model must be a local path")
    if not Path(path).is_absolute() or not Path(path).exists():
        raise OfflineError("a model's path must be absolute and exist")
    return Path(path)


def self_test(strict: bool, resolv: Path = Path("/etc/resolv.conf"), routes: Path = Path("/proc/net/route"), links: Path = Path("/sys/class/net")) -> dict[str, bool | None]:
    """Signs of a network, read from files; nothing is contacted. ``outbound_blocked`` is null unless strict."""
    dns = resolv.exists()
    route = routes.exists() and "00000000" in routes.read_text(errors="ignore")
    up = not links.exists() or any((link / "operstate").exists() and (link / "operstate").read_text().strip() == "up" for link in links.iterdir() if link.name != "lo")
    return {"strict": strict, "dns_configured": dns, "default_route": route, "interface_up": up, "outbound_blocked": not (dns or route or up) if strict else None}
