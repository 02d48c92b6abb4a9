"""Addresses followed to where they end, and the full texts found there.

An address is followed in rounds, one hop each: the addresses not asked before are
dealt out by host, their answers written to the shared folder, and what was
redirected goes into the next round under its new host. So no address is asked
twice, a host is asked at its own rate wherever the redirects came from, and a lost
executor repeats one part of one round. Where answers come from is a parameter
(``hops``): the network, or a table of stored answers.
"""

from __future__ import annotations

import email.utils
import heapq
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom import folders
from jobloom.sources import boards

#: One row an address: where it leads (absolute), or its text, or why there is none.
ANSWER = "address string, status int, location string, body string, error string"
Hops = Callable[[DataFrame], DataFrame]
#: Redirects that are followed; bytes of answers in a batch.
MOST_HOPS, BATCH = 10, 3_000_000
# Answers that lead elsewhere, answers that ask for patience, seconds for an answer.
MOVED, LATER, TIMEOUT = (301, 302, 303, 307, 308), (429, 503), 10


def host(address: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^\w+://(?:[^/?#@]*@)?([^/?#]+)", 1))


class _Stay(urllib.request.HTTPRedirectHandler):
    """Redirects are answers, not instructions."""

    def redirect_request(self, *_):
        return None


def http_answer(address: str) -> tuple[int, dict, str]:
    """Status, headers and text of a GET that follows nothing."""
    if not address.lower().startswith(("http://", "https://")):
        raise ValueError("not a web address")
    ask = urllib.request.Request(address, headers={"User-Agent": boards.USER_AGENT})
    try:
        with urllib.request.build_opener(_Stay).open(ask, timeout=TIMEOUT) as r:
            return r.status, dict(r.headers), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        with e:
            return e.code, dict(e.headers), ""


def seconds_asked(headers: dict, now: float) -> float:
    """What Retry-After asks for, as a number or a date; one second where it says neither."""
    said = next((v for k, v in headers.items() if k.lower() == "retry-after"), "").strip()
    if said.isdigit():
        return float(said)
    try:
        return max(0.0, email.utils.parsedate_to_datetime(said).timestamp() - now)
    except (TypeError, ValueError):
        return 1.0


def as_answer(address: str, status: int, headers: dict, body: str) -> tuple:
    where = next((v for k, v in headers.items() if k.lower() == "location"), None)
    if status in MOVED and where:
        return address, status, urllib.parse.urljoin(address, where), None, None
    return (address, status, None, body, None) if 200 <= status < 300 else (address, status, None, None, f"status {status}")


def asked_in_turn(addresses: list[tuple], ready: dict, gap: float, tries: int, patience: float, ask: Callable) -> Iterator[tuple]:
    """Answers to (address, queue) rows: each queue is asked every ``gap`` seconds, and one that waits holds up no other.

    ``ready`` keeps, from batch to batch, when a queue may be asked next. An answer that
    asks for patience is waited for up to ``patience`` seconds and ``tries`` times.
    """
    queues: dict[object, deque] = {}
    for address, queue in addresses:
        queues.setdefault(queue, deque()).append((address, 1))
    turns = [(ready.get(q, 0.0), str(q), q) for q in queues]
    heapq.heapify(turns)
    while turns:
        at, _, q = heapq.heappop(turns)
        time.sleep(max(0.0, at - time.time()))
        address, attempt = queues[q].popleft()
        ready[q] = time.time() + gap
        try:
            status, headers, body = ask(address)
            wait = seconds_asked(headers, time.time()) if status in LATER else None
            if wait is not None and attempt < tries and wait <= patience:
                ready[q] = time.time() + max(wait, gap)
                queues[q].appendleft((address, attempt + 1))
            else:
                yield as_answer(address, status, headers, body)
        except (OSError, ValueError, urllib.error.URLError) as e:
            yield address, None, None, None, type(e).__name__
        if queues[q]:
            heapq.heappush(turns, (ready[q], str(q), q))


def http_hops(rate: float = 2.0, lanes: int = 4, tries: int = 3, patience: float = 60.0, ask: Callable = http_answer) -> Hops:
    """Answers of the network, at most ``rate`` a second from each host.

    A host's addresses are spread over ``lanes`` queues in different tasks, each with
    its share of the rate, so a host with a third of all addresses is no task's work.
    A queue that is told to wait (Retry-After) waits; the host's others learn it from
    their own next answer.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict = {}
        schema = pa.schema([("address", pa.string()), ("status", pa.int32()), ("location", pa.string()), ("body", pa.string()), ("error", pa.string())])
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            rows, size = [], 0
            todo = list(zip(batch.column("address").to_pylist(), zip(batch.column("host").to_pylist(), batch.column("lane").to_pylist())))
            for answer in asked_in_turn(todo, ready, lanes / rate, tries, patience, ask):
                rows.append(answer)
                size += len(answer[3] or "")
                if size > BATCH:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    def hops(addresses: DataFrame) -> DataFrame:
        parts = int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = addresses.select("address", host(F.col("address")).alias("host"), F.pmod(F.xxhash64("address"), F.lit(lanes)).alias("lane"))
        return dealt.repartition(parts, "host", "lane").mapInArrow(work, ANSWER)

    return hops


def stored_hops(answers: DataFrame) -> Hops:
    """Answers of a table (ANSWER, one row an address); an address that it has not is an error."""

    def hops(addresses: DataFrame) -> DataFrame:
        met = addresses.select("address").join(answers.withColumn("__known", F.lit(True)), "address", "left")
        return met.select("address", "status", "location", "body", F.when(F.col("__known").isNull(), "no stored answer").otherwise(F.col("error")).alias("error"))

    return hops


def landed(requests: DataFrame, hops: Hops, most: int = MOST_HOPS) -> DataFrame:
    """url, final_url, page, error: where each request (url, address) ends, after at most ``most`` redirects.

    Repeated addresses are followed once and given to each of their rows. A null
    address, a loop or an answer without text is a row with an error and without
    page. Takes two written tables a round, and stops with the last redirect.
    """
    spark = requests.sparkSession
    at = folders.folder(spark, "redirects")
    asked = requests.select("url", "address")
    now = asked.filter("address is not null").select(F.col("address").alias("start"), "address").distinct()
    answers = ended = None
    for k in range(most + 1):
        todo = now.select("address").distinct()
        fresh = folders.written(hops(todo if answers is None else todo.join(answers.select("address"), "address", "left_anti")), f"{at}/answers-{k}")
        answers = fresh if answers is None else answers.unionByName(fresh)
        stepped = folders.written(now.join(answers.select("address", "location"), "address").select("start", "address", "location"), f"{at}/steps-{k}")
        here = stepped.filter("location is null").select("start", F.col("address").alias("final_url"), F.lit(False).alias("lost"))
        ended = here if ended is None else ended.unionByName(here)
        now = stepped.filter("location is not null").select("start", F.col("location").alias("address"))
        if now.isEmpty():
            break
    ended = ended.unionByName(now.select("start", F.col("address").alias("final_url"), F.lit(True).alias("lost")))
    texts = answers.filter("location is null").select(F.col("address").alias("final_url"), "body", "error")
    found = ended.join(texts, "final_url", "left")
    why = F.when(F.col("lost"), f"more than {most} redirects").otherwise(F.col("error"))
    found = found.select(F.col("start").alias("address"), "final_url", F.when(~F.col("lost"), F.col("body")).alias("page"), why.alias("error"))
    met = asked.join(found, "address", "left")
    return met.select("url", "final_url", "page", F.when(F.col("address").isNull(), "no address").otherwise(F.col("error")).alias("error"))


def full_texts(requests: DataFrame, hops: Hops, most: int = MOST_HOPS) -> DataFrame:
    """url, full_text, ats, slug of requests (url, address): the entry of the board where one ends, else the page's own text (``boards.full_descriptions``)."""
    spark = requests.sparkSession
    at = folders.folder(spark, "entries")
    ends = folders.written(boards.api_requests(landed(requests, hops, most)), f"{at}/ends")
    entries = folders.written(hops(ends.filter("address is not null").select("address").distinct()), f"{at}/entries")
    own = entries.filter("status between 200 and 299").select("address", "body")
    return boards.full_descriptions(ends.join(own, "address", "left").select("url", "final_url", "page", "body"))


def thin_adverts(postings: DataFrame, source: str = "adzuna") -> DataFrame:
    """url, address of an aggregator's adverts worth a request: title and place are wanted and the text looks cut."""
    from jobloom.functions.text import looks_truncated
    from jobloom.operators.screen import location_is_allowed, title_is_relevant

    c = F.col
    wanted = postings.filter((c("source") == source) & title_is_relevant(c("title")) & location_is_allowed(c("location")) & looks_truncated(c("description")))
    return wanted.select("url", c("url").alias("address")).filter("url is not null").distinct()


def with_full_texts(postings: DataFrame, hops: Hops, source: str = "adzuna", most: int = MOST_HOPS) -> tuple[DataFrame, DataFrame]:
    """The postings, thin adverts with the longer text found behind their address; and the boards that gave one (name, ats, slug), each once."""
    spark = postings.sparkSession
    found = folders.written(full_texts(thin_adverts(postings, source), hops, most), f"{folders.folder(spark, 'full-texts')}/0")
    named = postings.filter(F.col("source") == source).select("url", F.col("company").alias("name"))
    discovered = named.join(found.filter("ats is not null"), "url").select("name", "ats", "slug").distinct()
    return boards.longer_text(postings, found), discovered
