"""Pages and files fetched from the web inside the tasks that need them."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from folio.providers import with_retries

AGENT = "folio/1.0"
TIMEOUT = 120


def get(url: str) -> bytes:
    """The body of a response; a bad status is an error."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:  # noqa: S310
        return answer.read()


def fetched(urls: DataFrame, column: str = "url", fetch: Callable[[str], bytes] = get, tries: int = 3) -> DataFrame:
    """(url, content, error) of every distinct address; a failure is an error of its row, not of the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append((url, with_retries(lambda url=url: fetch(url), tries), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    return urls.selectExpr(f"`{column}` as url").where("url is not null").distinct().mapInPandas(run, "url string, content binary, error string")
