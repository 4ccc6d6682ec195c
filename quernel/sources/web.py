"""Fetching pages, with the fetcher as an argument so that plans run offline too."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.errors import BadInput, CallFailed
from quernel.functions.text import media_type, scheme_allowed
from quernel.operators.scoring import TRANSIENT_STATUS, call_with_retry, is_retryable
from quernel.sources.store import BatchStore, in_batches

Fetcher = Callable[[str], tuple[int, str, bytes]]


def http_fetcher(proxy: str | None = None, timeout: float = 30.0) -> Fetcher:
    """GET with redirects, through ``proxy`` where one is given."""

    def fetch(url: str) -> tuple[int, str, bytes]:
        handlers = [urllib.request.ProxyHandler({"http": proxy, "https": proxy} if proxy else {})]
        try:
            with urllib.request.build_opener(*handlers).open(url, timeout=timeout) as answer:
                return answer.status, answer.headers.get("Content-Type", ""), answer.read()
        except urllib.error.HTTPError as error:
            return error.code, error.headers.get("Content-Type", ""), b""
        except OSError as error:
            raise BadInput(f"{url}: {error}") from error

    return fetch


class HostTurns:
    """Keeps requests to one host at least so many seconds apart, for the threads of a task."""

    def __init__(self, apart: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.apart, self.clock, self.sleep, self.lock = apart, clock, sleep, Lock()
        self.free: dict[str, float] = {}

    def wait(self, url: str) -> None:
        if not self.apart:
            return
        host = urlsplit(url).netloc.lower()
        with self.lock:
            now = self.clock()
            turn = max(now, self.free.get(host, now))
            self.free[host] = turn + self.apart
        if turn > now:
            self.sleep(turn - now)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def fetch(urls: DataFrame, fetcher: Fetcher, *, url: str = "url", clients: int = 8, retries: int = 2, apart: float = 0.0, at_once: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(origin, status, content, content_type, error) of every url.

    At most ``clients`` partitions fetch at once, each with up to ``at_once`` requests under way.  With ``apart``
    a host's urls go to one partition, which leaves so many seconds between two requests to it.  Schemes other
    than http and https are refused without a request; a failed fetch is a row with an ``error``, after
    ``retries`` more attempts where the failure or the status says that it may pass.
    """
    rows = urls.select(F.col(url).alias("origin"), scheme_allowed(F.col(url)).alias("allowed"))
    rows = rows.repartition(clients, host_of(F.col("origin"))) if apart else rows.repartition(clients)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = HostTurns(apart)

        def get(origin: str) -> tuple[int, str, bytes]:
            turns.wait(origin)
            status, kind, content = fetcher(origin)
            if status in TRANSIENT_STATUS or status >= 500:
                raise CallFailed(f"status {status}", status=status)
            return status, kind, content

        def one(origin: str, allowed: bool) -> tuple:
            if not allowed:
                return origin, None, None, None, "unsupported scheme (http and https only)"
            try:
                status, kind, content = call_with_retry(lambda: get(origin), retries, sleep)
            except (BadInput, CallFailed, OSError) as error:
                return origin, getattr(error, "status", None), None, None, str(error)
            good = 200 <= status < 300
            return origin, status, content if good else None, kind, None if good else f"status {status}"

        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                for start in range(0, len(frame), 4 * at_once):  # contents of so many are held together
                    part = frame.iloc[start : start + 4 * at_once]
                    out = pd.DataFrame(list(pool.map(one, part["origin"], part["allowed"])), columns=["origin", "status", "content", "content_type", "error"])
                    yield out.astype({"status": "Int32"})

    got = rows.mapInPandas(run, "origin string, status int, content binary, content_type string, error string")
    return got.withColumn("content_type", media_type(F.col("content_type")))


class PageStore(BatchStore):
    """Fetched pages by the MD5 of their url."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "page", "origin string, status int, content binary, content_type string, error string")


def fetch_stored(urls: DataFrame, fetcher: Fetcher, store: PageStore, *, url: str = "url", batches: int = 4, **options) -> DataFrame:
    """:func:`fetch` of each distinct url, asking only for what ``store`` doesn't hold.

    Batches are committed one by one, so a run that was lost goes on where it was.  What got no answer, or one that may
    pass, isn't stored and so is asked for again by the next run; this run returns the stored pages of ``urls``.
    """
    asked = urls.where(F.col(url).isNotNull()).select(F.md5(url).alias("page"), F.col(url).alias("origin")).dropDuplicates(["page"])
    lasting = F.coalesce(~is_retryable(F.col("status")), F.lit(False)) & F.col("status").isNotNull() | F.col("error").startswith("unsupported")

    def answer(new: DataFrame) -> DataFrame:
        return fetch(new, fetcher, url="origin", **options).where(lasting).withColumn("page", F.md5("origin"))

    in_batches(asked, store, answer, batches)
    return asked.select("page").join(store.read().drop("bucket"), "page").drop("page")


def stored(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A table of pages in the form of fetched ones."""
    return pages.select(F.col(url).alias("origin"), F.lit(200).alias("status"), F.encode(html, "UTF-8").alias("content"), F.lit("text/html").alias("content_type"))


def model_ids(answer: Column) -> Column:
    """The ids that a model listing holds."""
    parsed = F.from_json(answer, "data array<struct<id:string>>")
    return F.transform(parsed["data"], lambda m: F.coalesce(m["id"], F.lit("")))


def probe(base: str, fetcher: Fetcher) -> dict:
    """Whether a model server answers at its health address, and the models that it lists."""
    from quernel.sources.settings import health_address

    def get(address: str) -> tuple[int | None, bytes]:
        try:
            status, _, body = fetcher(address)
            return status, body
        except (BadInput, OSError):
            return None, b""

    health, _ = get(health_address(base))
    status, body = get(base.rstrip("/") + "/models")
    try:
        models = [str(m.get("id", "")) for m in json.loads(body or b"{}").get("data", [])] if status == 200 else []
    except (ValueError, AttributeError):
        models = []
    return {"healthy": health is not None and 200 <= health < 300, "models": models}
