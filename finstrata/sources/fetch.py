"""Polite HTTPS fetching on the driver: spaced, bounded, retried, and landed by content.

Fetching stays outside Spark; what is landed is then read as any other files.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


class FetchError(RuntimeError):
    """The answer is missing, refused, too large or not what was asked for."""


def allowed(url: str, hosts: frozenset[str]) -> str:
    """The address, if it is https, of one of the hosts, without user and with no odd port; else FetchError."""
    u = urllib.parse.urlsplit(url)
    if u.scheme != "https" or u.username or u.password or u.port not in (None, 443) or (u.hostname or "").lower() not in hosts:
        raise FetchError(f"address not allowed: {url}")
    return url


def _open(url: str, timeout: float):
    return urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "*/*"}), timeout=timeout)


@dataclass
class Fetcher:
    """Requests at least `spacing` seconds apart; answers of at most `most` bytes; `tries` tries, each after a longer pause."""

    hosts: frozenset[str]
    spacing: float = 1.0
    most: int = 25 * 1024 * 1024
    tries: int = 3
    timeout: float = 30.0
    opener: Callable = _open
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _last: float = field(default=float("-inf"))

    def chunks(self, url: str) -> Iterator[bytes]:
        allowed(url, self.hosts)
        for k in range(self.tries):
            self.sleep(max(0.0, self._last + self.spacing - self.clock()))
            self._last = self.clock()
            try:
                answer = self.opener(url, self.timeout)
                break
            except urllib.error.HTTPError as e:
                if e.code in (401, 403, 404) or k == self.tries - 1:
                    raise FetchError(f"{e.code} for {url}") from e
            except OSError as e:
                if k == self.tries - 1:
                    raise FetchError(f"{e} for {url}") from e
            self.sleep(2.0**k)
        size = 0
        with answer:
            while part := answer.read(1 << 16):
                size += len(part)
                if size > self.most:
                    raise FetchError(f"more than {self.most} bytes from {url}")
                yield part

    def read(self, url: str) -> bytes:
        return b"".join(self.chunks(url))

    def json(self, url: str) -> object:
        data = self.read(url)
        if data.lstrip()[:1] == b"<":
            raise FetchError(f"a page instead of JSON from {url}")
        return json.loads(data.decode("utf-8-sig"))

    def pages(self, url: Callable[[int], str], rows: Callable[[object], list], size: int, most: int = 10_000) -> Iterator[object]:
        """Answers for offsets 0, size, 2*size, ... up to the first that isn't full; FetchError after `most` of them."""
        for k in range(most):
            answer = self.json(url(k * size))
            yield answer
            if len(rows(answer)) < size:
                return
        raise FetchError(f"more than {most} pages")


def land(folder: str, data: bytes, suffix: str = ".json") -> tuple[str, str]:
    """(path, sha256): the bytes under the name of their hash; written beside and renamed, once."""
    digest = hashlib.sha256(data).hexdigest()
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, digest + suffix)
    if not os.path.exists(path):
        tmp = f"{path}.{os.getpid()}.part"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, path)
    return path, digest


def write_manifest(path: str, value: object) -> None:
    """JSON with sorted keys, seen whole or not at all."""
    tmp = f"{path}.{os.getpid()}.part"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=2)
    os.replace(tmp, path)


#: Folders of a warehouse, by what they hold.
LAYOUT = ("raw", "staging", "parquet", "manifests")


def ensure_layout(root: str, sources: tuple[str, ...] = ()) -> dict[str, str]:
    out = {name: os.path.join(root, name) for name in LAYOUT}
    for p in [*out.values(), *(os.path.join(out["raw"], s) for s in sources)]:
        os.makedirs(p, exist_ok=True)
    return out
