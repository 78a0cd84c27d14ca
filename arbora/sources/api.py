"""The remote side of a crawl: an API of profiles and paged lists, crawlers over it, and both as Spark sources.

An API object is made anew in every task from ``"module:factory"`` and string options, so nothing but text is shipped.
"""

from __future__ import annotations

import importlib
import json
import os
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arbora.sources.model import HUB_THRESHOLD

SIDES = ("following", "followers")
#: Remaining calls below which a crawl waits for the reset, and the wait where none is told.
FLOOR, FALLBACK_SECONDS = 5, 60


@dataclass
class Rate:
    """Quota of an API; the defaults hold until it has been asked."""

    limit: int = 5000
    remaining: int = 5000
    reset_at: int = 0


def pause_seconds(rate: Rate, now: int) -> int:
    """How long to wait before the next call."""
    if rate.remaining >= FLOOR:
        return 0
    return rate.reset_at - now if rate.reset_at > now else FALLBACK_SECONDS


class Api:
    """What a source must answer. ``page`` counts from 1 and gives an empty list behind the last page."""

    def profile(self, login: str) -> dict | None:
        raise NotImplementedError

    def page(self, login: str, side: str, number: int) -> list[dict]:
        raise NotImplementedError

    def logins(self) -> Iterator[str]:
        raise NotImplementedError

    def rate(self) -> Rate:
        return Rate()


class FolderApi(Api):
    """An API whose answers have been landed as files: ``ROOT/users/LOGIN.json`` and ``ROOT/SIDE/LOGIN/NUMBER.json``."""

    def __init__(self, root: str):
        self.root = root

    def _read(self, *parts: str):
        path = os.path.join(self.root, *parts)
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def profile(self, login: str) -> dict | None:
        return self._read("users", f"{login}.json")

    def page(self, login: str, side: str, number: int) -> list[dict]:
        return self._read(side, login, f"{number}.json") or []

    def logins(self) -> Iterator[str]:
        for name in sorted(os.listdir(os.path.join(self.root, "users"))):
            yield name.removesuffix(".json")


def folder_api(options: dict[str, str]) -> Api:
    return FolderApi(options["root"])


def make(factory: str, options: dict[str, str]) -> Api:
    module, name = factory.split(":")
    return getattr(importlib.import_module(module), name)(options)


def listed(api: Api, login: str, side: str, aborted: Callable[[], bool] = lambda: False, wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """The users of a list, page by page up to the first empty one. An abort ends it early, and what was read stands."""
    number = 1
    while not aborted():
        if seconds := pause_seconds(api.rate(), int(time.time())):
            wait(seconds)
        users = api.page(login, side, number)
        if not users:
            return
        yield from users
        number += 1


class PageSource(DataSource):
    """``spark.read.format("arbora_pages")`` with options api, partitions and those of the API: every list of every login.

    A task takes the logins whose checksum falls to it, so lists are read in parallel and never gathered.
    """

    @classmethod
    def name(cls) -> str:
        return "arbora_pages"

    def schema(self) -> str:
        return "login string, side string, place int, peer_login string, avatar_url string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.count = options, int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        api = make(self.options.get("api", "arbora.sources.api:folder_api"), self.options)
        for login in api.logins():
            if zlib.crc32(login.encode()) % self.count == partition.value:
                for side in SIDES:
                    for place, user in enumerate(listed(api, login, side)):
                        yield login, side, place, user["login"], user.get("avatar_url")


class Crawler:
    """From one scope to the users it lists. A crawler reads no tables and has no state."""

    name = ""

    def crawl(self, login: str, api: Api) -> dict[str, list[dict]]:
        raise NotImplementedError


class FollowCrawler(Crawler):
    name = "follow_crawler"

    def crawl(self, login: str, api: Api) -> dict[str, list[dict]]:
        return {side: list(listed(api, login, side)) for side in SIDES}


CRAWLERS: dict[str, Crawler] = {}


def register(crawler: Crawler) -> Crawler:
    CRAWLERS[crawler.name] = crawler
    return crawler


register(FollowCrawler())

_USERS = "array<struct<login:string,avatar_url:string>>"


def crawl_scopes(scopes: DataFrame, crawler: str, api: str = "arbora.sources.api:folder_api", threshold: int = HUB_THRESHOLD, **options: str) -> DataFrame:
    """Results of one batch of ``scopes`` (login, seq) as ``queue.crawl_step`` takes them.

    The profile's counts come first: lists of hubs are not read, so no list is longer than ``threshold``. Scopes
    without a profile are left out, for the caller to reset to retry.
    """
    step = CRAWLERS[crawler]

    def run(batches):
        source = make(api, options)
        for pdf in batches:
            rows = []
            for login, seq in zip(pdf.login, pdf.seq):
                profile = source.profile(login)
                if profile is None:
                    continue
                counts = [int(profile.get(side) or 0) for side in SIDES]
                lists = step.crawl(login, source) if max(counts) < threshold else {side: [] for side in SIDES}
                rows.append((login, seq, *counts, *([{"login": u["login"], "avatar_url": u.get("avatar_url")} for u in lists[side]] for side in SIDES)))
            yield pd.DataFrame(rows, columns=["login", "seq", "following_count", "followers_count", "following", "followers"])

    return scopes.select("login", "seq").mapInPandas(run, f"login string, seq long, following_count long, followers_count long, following {_USERS}, followers {_USERS}")
