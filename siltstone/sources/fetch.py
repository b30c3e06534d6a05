"""Pages from where they are served: tries, pauses and what went wrong, by tasks that each have whole hosts.

A transport does one request; the one over recorded responses makes runs repeatable, the other asks by HTTP.  What renders
pages is a transport of the caller's own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.contact import domain


class Transport(Protocol):
    def get(self, request: dict, attempt: int) -> str:
        """The html of a request, a row of the urls as they were given; an exception's text is the reason of a failure."""


class Recorded:
    """Answers from the request's own ``responses``, an array of (error, html), one for each try; past its end, the last one again."""

    def get(self, request: dict, attempt: int) -> str:
        responses = request.get("responses") or []
        if not responses:
            raise LookupError("nothing was recorded")
        said = responses[min(attempt, len(responses)) - 1]
        if said["error"]:
            raise OSError(said["error"])
        return said["html"] or ""


class Http:
    """Asks by HTTP; a page longer than ``most_bytes`` is a failure, since half a page is none."""

    def __init__(self, timeout: float = 30.0, most_bytes: int = 64 << 20, agent: str = "siltstone"):
        self.timeout, self.most_bytes, self.agent = timeout, most_bytes, agent

    def get(self, request: dict, attempt: int) -> str:
        from urllib.request import Request, urlopen

        with urlopen(Request(request["url"], headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:
            body = answer.read(self.most_bytes + 1)
            if len(body) > self.most_bytes:
                raise OSError(f"the page is longer than {self.most_bytes} bytes")
            return body.decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetched(
    urls: DataFrame,
    transport: Callable[[], Transport] = Http,
    *,
    retries: int = 1,
    retry_seconds: float = 2.0,
    host_seconds: float = 0.0,
    lanes: int = 1,
) -> DataFrame:
    """``urls`` (with ``url``) and ``html``, ``load_error`` and ``attempts``; what a request needs besides its url are columns of its row.

    A failure is tried ``retries`` times more, after a pause; the last one's reason is ``load_error``, and the page's html null.  It stops nothing.
    A host's urls are in one task, or dealt to ``lanes`` of them by url, so a host that has a third of all urls does not hold up one task
    for all of them; between two requests to a host a lane lets ``host_seconds * lanes`` pass, so the host sees one in ``host_seconds``.
    Each task makes one transport.  A null or empty url is a failure without a try.
    """
    kept = [f for f in urls.schema.fields if f.name not in ("html", "load_error", "attempts")]
    out = StructType([*kept, StructField("html", StringType()), StructField("load_error", StringType()), StructField("attempts", LongType())])
    kind = to_arrow_type(out)
    lane = F.pmod(F.xxhash64("url"), F.lit(lanes))
    dealt = urls.select(*[f.name for f in kept]).withColumn("_host", F.coalesce(domain(F.col("url")), F.lit(""))).repartition("_host", lane)

    def tries(client: Transport, request: dict) -> tuple[str | None, str | None, int]:
        if not (request["url"] or "").strip():
            return None, "the url is empty", 0
        for attempt in range(1, retries + 2):
            try:
                return client.get(request, attempt), None, attempt
            except Exception as e:  # noqa: BLE001  one page never fails the job
                reason = f"{type(e).__name__}: {e}"
                if attempt <= retries:
                    time.sleep(retry_seconds)
        return None, reason[:500], retries + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, due = transport(), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64).to_pylist()
                for r in rows:
                    host = r.pop("_host")
                    if host_seconds:
                        time.sleep(max(0.0, due.get(host, 0.0) - time.monotonic()))
                    r["html"], r["load_error"], r["attempts"] = tries(client, r)
                    if host_seconds:
                        due[host] = time.monotonic() + host_seconds * lanes
                yield pa.RecordBatch.from_struct_array(pa.array(rows, type=kind))

    return dealt.mapInArrow(run, out)
