"""Image bytes and liveness, fetched by threads inside partitions; every distinct address once."""

from __future__ import annotations

import mimetypes
import posixpath
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from roundforge.sources import stores

MAX_BYTES, TIMEOUT, WORKERS = 20_000_000, 20, 12
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; roundforge/1)", "Accept": "image/*,*/*;q=0.8"}
FETCHED = "url string, content binary, content_type string, error string"


def fetch_one(url: str, root: str | None, max_bytes: int = MAX_BYTES, timeout: float = TIMEOUT) -> tuple[bytes | None, str | None, str | None]:
    """content, type, error: over http(s), or a file below ``root``, a local path or a URI."""
    try:
        if url.startswith(("http://", "https://")):
            with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as r:
                data, kind = r.read(max_bytes + 1), r.headers.get("Content-Type")
        elif root and "://" in root:
            inside = posixpath.normpath(url)
            if inside.startswith(("/", "..")):
                return None, None, "outside of the root"
            store, base = stores.opened(root)
            with store.open_input_stream(f"{base.rstrip('/')}/{inside}") as f:
                data, kind = bytes(f.read(max_bytes + 1)), mimetypes.guess_type(inside)[0]
        else:
            base = Path(root or ".").resolve()
            path = (base / url).resolve()
            if not path.is_relative_to(base):
                return None, None, "outside of the root"
            with path.open("rb") as f:
                data, kind = f.read(max_bytes + 1), mimetypes.guess_type(path.name)[0]
    except (OSError, ValueError) as e:
        return None, None, f"{type(e).__name__}: {e}"
    if len(data) > max_bytes:
        return None, None, "too large"
    return (data, kind, None) if data else (None, None, "empty")


def fetch(rounds: DataFrame, root: str | None = None, workers: int = WORKERS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """FETCHED for the distinct review images of ``rounds``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                for i in range(0, len(b), workers):  # so many images are held at a time
                    urls = b["url"].iloc[i : i + workers].tolist()
                    got = list(pool.map(lambda u: fetch_one(u, root, max_bytes), urls))
                    yield pd.DataFrame([(u, *g) for u, g in zip(urls, got, strict=True)], columns=["url", "content", "content_type", "error"])

    urls = rounds.selectExpr("review_image as url").filter("url is not null").distinct()
    return urls.mapInPandas(run, FETCHED)


def is_live(url: str, timeout: float = 10) -> bool:
    """Whether the first bytes of an address are an image; any failure says no."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS | {"Range": "bytes=0-2047"}), timeout=timeout) as r:
            return r.status < 400 and (r.headers.get("Content-Type") or "").lower().startswith("image/") and bool(r.read(32))
    except (OSError, ValueError):
        return False


def live(rounds: DataFrame, workers: int = 16, probe: Callable[[str], bool] = is_live) -> DataFrame:
    """``rounds`` whose image is live."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                yield b[list(pool.map(probe, b["review_image"]))]

    dead = rounds.select("review_image").filter("review_image is not null").distinct().mapInPandas(run, "review_image string")
    return rounds.join(dead, "review_image", "left_semi")
