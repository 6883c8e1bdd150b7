"""Reading web services politely: cache, rate, retries, and sources tried in order."""

from __future__ import annotations

import hashlib
import json
import random
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path
from typing import Any

Opener = Callable[[str, bytes | None, dict[str, str]], bytes]


class TokenBucket:
    """At most rate acquisitions a second, evenly spaced, over all threads."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.space, self.clock, self.sleep = 1.0 / rate, clock, sleep
        self.free, self.lock = clock(), threading.Lock()

    def acquire(self) -> None:
        with self.lock:
            now = self.clock()
            wait = max(0.0, self.free - now)
            self.free = max(now, self.free) + self.space
        if wait:
            self.sleep(wait)


class JsonCache:
    """Answers by key, in files dealt over 256 folders; older ones than days are forgotten."""

    def __init__(self, folder: str | Path, days: float = 30, clock: Callable[[], float] = time.time):
        self.folder, self.days, self.clock = Path(folder), days, clock

    def path(self, key: str) -> Path:
        name = hashlib.sha1(key.encode()).hexdigest()
        return self.folder / name[:2] / f"{name}.json"

    def get(self, key: str) -> Any | None:
        path = self.path(key)
        if not path.exists() or self.clock() - path.stat().st_mtime > self.days * 86_400:
            return None
        return json.loads(path.read_text())

    def put(self, key: str, value: Any) -> None:
        path = self.path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(f".{threading.get_ident()}")
        part.write_text(json.dumps(value))
        part.replace(path)


def urlopen(url: str, body: bytes | None, headers: dict[str, str]) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=60) as answer:
        return answer.read()


class Client:
    """JSON from a service: cached, rate-limited, tried again on 429 and 5xx; 404 gives None."""

    def __init__(self, base: str, cache: JsonCache | None = None, rate: float = 1.0, tries: int = 5, opener: Opener = urlopen, sleep: Callable[[float], None] = time.sleep, headers: dict[str, str] | None = None):
        self.base, self.cache, self.tries, self.opener, self.sleep = base.rstrip("/"), cache, tries, opener, sleep
        self.bucket, self.headers = TokenBucket(rate, sleep=sleep), headers or {}

    def get(self, path: str, body: Any = None, **params: Any) -> Any | None:
        url = f"{self.base}/{path.lstrip('/')}" + (f"?{urllib.parse.urlencode(params)}" if params else "")
        sent = None if body is None else json.dumps(body, sort_keys=True).encode()
        key = f"{url} {sent.decode() if sent else ''}"
        if self.cache and (known := self.cache.get(key)) is not None:
            return known
        for turn in range(self.tries):
            self.bucket.acquire()
            try:
                value = json.loads(self.opener(url, sent, self.headers | ({"Content-Type": "application/json"} if sent else {})))
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code != 429 and e.code < 500 or turn == self.tries - 1:
                    raise
                self.sleep(min(60, 2**turn) * (0.5 + random.random() / 2))
                continue
            if self.cache:
                self.cache.put(key, value)
            return value
        return None

    def batch(self, path: str, ids: Sequence[str], size: int = 500, **params: Any) -> Iterator[Any]:
        """Records of ids, in slices."""
        for i in range(0, len(ids), size):
            yield from self.get(path, {"ids": list(ids[i : i + size])}, **params) or []

    def pages(self, path: str, limit: int = 1000, **params: Any) -> Iterator[Any]:
        offset: int | None = 0
        while offset is not None:
            page = self.get(path, offset=offset, limit=limit, **params) or {}
            yield from page.get("data", [])
            offset = page.get("next")


class Registry:
    """Named sources in order; one that can't be made is left out, with the reason."""

    def __init__(self):
        self.makers: dict[str, Callable[[Any], Callable[[dict], bytes | None]]] = {}

    def register(self, name: str):
        def wrap(make):
            self.makers[name] = make
            return make

        return wrap

    def enabled(self, names: Iterable[str], config: Any) -> tuple[list[tuple[str, Callable]], list[str]]:
        found, skipped = [], []
        for name in names:
            try:
                found.append((name, self.makers[name](config)))
            except Exception as e:  # a broken source must not stop the others; the reason is returned
                skipped.append(f"{name}: {type(e).__name__}: {e}")
        return found, skipped


def acquire(sources: Sequence[tuple[str, Callable[[dict], bytes | None]]], record: dict) -> tuple[str, bytes] | None:
    """The first source that has a record's document, and the document."""
    for name, fetch in sources:
        got = fetch(record)
        if got:
            return name, got
    return None


def kind_of(content: bytes) -> str:
    """pdf, gzip (a source archive) or other, by the first bytes."""
    return "pdf" if content[:4] == b"%PDF" else "gzip" if content[:2] == b"\x1f\x8b" else "other"


def open_access_link(record: dict, email: str | None = None) -> list[str]:
    """Links to a record's PDF, best first: its own, then those that a publisher lists (text mining before PDF)."""
    own = (record.get("openAccessPdf") or {}).get("url")
    best = record.get("best_oa_location") or {}
    listed = sorted(record.get("link") or [], key=lambda x: (x.get("intended-application") != "text-mining", x.get("content-type") != "application/pdf"))
    links = (own, best.get("url_for_pdf"), best.get("pdf_url"), *(x.get("URL") for x in listed))
    return list(dict.fromkeys(x for x in links if x))
