"""Statuses of external addresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

#: Statuses of hosts that refuse HEAD although GET is fine (fixed values).
AGAIN = (403, 405, 429)


def fetch(method: str, url: str, timeout: float) -> int | None:
    """The status that a host answers with after redirects; none if it can't be reached in time."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, method=method, headers={"User-Agent": "pagewarden"}), timeout=timeout) as answer:
            return answer.status
    except HTTPError as error:
        return error.code
    except (OSError, ValueError):
        return None


def statuses(urls: DataFrame, settings: dict, probe: Callable[[str, str, float], int | None] = fetch) -> DataFrame:
    """Rows url, status of the distinct addresses of a column ``url``; a null status means that the host wasn't reached.

    Each is asked once, with HEAD, and with GET where a host refuses that; ``max_concurrent`` at a time in a task.
    """
    k = settings["external_links"]
    seconds, at_once = k["timeout_ms"] / 1000, k["max_concurrent"]

    def ask(url: str) -> int | None:
        status = probe("HEAD", url, seconds)
        return probe("GET", url, seconds) if status in AGAIN else status

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                found = batch.column("url").to_pylist()
                yield pa.RecordBatch.from_pydict({"url": pa.array(found, pa.string()), "status": pa.array(list(pool.map(ask, found)), pa.int32())})

    return urls.select("url").where("url IS NOT NULL").distinct().mapInArrow(run, "url string, status int")
