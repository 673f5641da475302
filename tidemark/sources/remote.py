"""Client side of a paged remote source: identity of a request, cache, rate and budget.

No network is opened here: a transport callable does that, so that replay from
the cache and tests need none.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import threading
import time
from collections.abc import Callable, Iterator


class RemoteError(RuntimeError):
    """The remote source cannot be read within its rules."""


def request_hash(endpoint: str, params: dict) -> str:
    """The whole identity of a request, independent of the order of its parameters."""
    return hashlib.sha256(json.dumps([endpoint, params], sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def id_chunks(ids: list[str], most: int) -> list[list[str]]:
    """Sorted ids in chunks of at most `most`."""
    ordered = sorted(set(ids))
    return [ordered[k : k + most] for k in range(0, len(ordered), most)]


class Limiter:
    """A token bucket with a bound on requests in flight."""

    def __init__(self, per_second: float, in_flight: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = per_second, clock, sleep
        self.slots, self.lock, self.next = threading.BoundedSemaphore(in_flight), threading.Lock(), clock()

    def __enter__(self):
        self.slots.acquire()
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + 1 / self.rate
        if at > now:
            self.sleep(at - now)
        return self

    def __exit__(self, *_):
        self.slots.release()


class Budget:
    """Requests spent, in an append-only file that survives the process."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.lock = path, most, threading.Lock()

    def spent(self) -> int:
        if not os.path.exists(self.path):
            return 0
        with open(self.path) as f:
            return sum(json.loads(x)["cost"] for x in f if x.strip())

    def spend(self, request: str, cost: int = 1) -> None:
        with self.lock:
            if self.spent() + cost > self.most:
                raise RemoteError("the request budget is spent")
            with open(self.path, "a") as f:
                f.write(json.dumps({"request": request, "cost": cost}) + "\n")


class Cache:
    """Responses by request hash, compressed; written once."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def get(self, key: str):
        path = f"{self.root}/{key}.json.gz"
        if not os.path.exists(path):
            return None
        with gzip.open(path, "rt") as f:
            return json.load(f)

    def put(self, key: str, body) -> None:
        part = f"{self.root}/{key}.{os.getpid()}.part"
        with gzip.open(part, "wt") as f:
            json.dump(body, f)
        os.replace(part, f"{self.root}/{key}.json.gz")


class Client:
    """Cache first; in replay mode a miss is an error; live calls are limited, budgeted and retried."""

    def __init__(self, send: Callable[[str, dict], dict], cache: Cache, limiter: Limiter, budget: Budget, replay: bool = False, retries: int = 3):
        self.send, self.cache, self.limiter, self.budget, self.replay, self.retries = send, cache, limiter, budget, replay, retries

    def call(self, endpoint: str, params: dict) -> dict:
        key = request_hash(endpoint, params)
        if (held := self.cache.get(key)) is not None:
            return held
        if self.replay:
            raise RemoteError(f"not in the cache: {endpoint}")
        for attempt in range(self.retries):
            self.budget.spend(key)
            try:
                with self.limiter:
                    body = self.send(endpoint, params)
                break
            except OSError as e:
                if attempt + 1 == self.retries:
                    raise RemoteError(f"{endpoint} failed {self.retries} times") from e
        self.cache.put(key, body)
        return body

    def pages(self, endpoint: str, params: dict, most: int = 1000) -> Iterator[list]:
        """Pages in order until one names no next; more than `most` is an error."""
        page = 0
        while page is not None:
            if page >= most:
                raise RemoteError("too many pages")
            body = self.call(endpoint, params | {"page": page})
            yield body["rows"]
            page = body.get("next")

    def batch(self, endpoint: str, params: dict, polls: int = 100, wait: Callable[[int], None] = lambda k: None) -> dict:
        """Submit, poll, fetch; a submitted job is found again in the cache after a restart."""
        job = self.call(f"{endpoint}/submit", params)["job"]
        for k in range(polls):
            with self.limiter:
                status = self.send(f"{endpoint}/status", {"job": job})["status"]
            if status == "done":
                return self.call(f"{endpoint}/result", {"job": job})
            if status == "failed":
                raise RemoteError(f"job {job} failed")
            wait(k)
        raise RemoteError(f"job {job} did not end")
