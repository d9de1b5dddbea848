"""URL filter over a sorted digest array.

The rules' strings are hashed with 64-bit xxhash; the sorted keys lie in a file that each worker memory-maps, with the strings
beside them. A probe is a host's tail of whole labels joined with a beginning of the path, for each pair of lengths that some rule
has, so that very long hosts and paths cost no more than short ones. All probes of a batch go through one binary search, and a key
that is found counts only if the stored string equals the probe, so that collisions cannot decide. Of a url's rules the longest wins.
Two verdicts for one rule, or a verdict other than block and allow, are errors.

The file reaches the executors as a Spark file, so nothing needs a folder that they share. A null url or one without "://" has an
empty host and path, meets no rule and gets the default verdict. Urls are judged row by row: repeated rows get
equal results, and an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from functools import lru_cache

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # host, path, verdict


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def build(rules: list[Rule], hash_of=key_of) -> bytes:
    """The index: number of keys, sorted keys, offsets of the strings, verdicts, host and path lengths, strings."""
    verdicts: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if verdict not in ("block", "allow"):
            raise ValueError(f"the verdict of {host}{path} is neither block nor allow: {verdict}")
        if verdicts.setdefault((host, path), verdict) != verdict:
            raise ValueError(f"two verdicts for {host}{path}")
    entries = sorted((hash_of(host + path), f"{host}{path}".encode(), len(host), len(path), verdict) for host, path, verdict in set(rules))
    n = len(entries)
    text = b"".join(e[1] for e in entries)
    ends = np.cumsum([0, *(len(e[1]) for e in entries)])
    parts = [np.array([e[0] for e in entries], dtype="<u8"), ends.astype("<u8"), np.array([e[4] == "block" for e in entries], dtype="<u8"), np.array([e[2] for e in entries], dtype="<u8"), np.array([e[3] for e in entries], dtype="<u8")]
    return struct.pack("<Q", n) + b"".join(p.tobytes() for p in parts) + text


class DigestArray:
    """The mapped index."""

    def __init__(self, path: str, hash_of=key_of):
        self.hash_of = hash_of
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(whole[:8].view("<u8")[0])
        at = lambda start, count: whole[start : start + 8 * count].view("<u8")
        self.keys, self.ends = at(8, n), at(8 + 8 * n, n + 1)
        self.blocked, self.hosts, self.paths = (at(16 + 16 * n + 8 * n * k, n) for k in range(3))
        self.text = whole[16 + 40 * n :]
        self.lengths = sorted(set(zip(self.hosts.tolist(), self.paths.tolist(), strict=True)))

    def rule(self, i: int) -> str:
        return self.text[int(self.ends[i]) : int(self.ends[i + 1])].tobytes().decode()

    def probe(self, keys: np.ndarray, probes: list[tuple[str, int]]) -> list[int]:
        """The place of each probe (string, length of its host) among the rules, or -1."""
        found = [-1] * len(probes)
        if not len(self.keys):
            return found
        at = np.searchsorted(self.keys, keys)
        for p in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            i = int(at[p])
            while i < len(self.keys) and self.keys[i] == keys[p]:  # of several strings with one key, the equal one
                if int(self.hosts[i]) == probes[p][1] and self.rule(i) == probes[p][0]:
                    found[p] = i
                    break
                i += 1
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> list[int]:
        """The longest fitting rule of each url, or -1; of equally long ones that with the longer host."""
        probes, owner = [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for n, m in self.lengths:  # only tails and beginnings of the lengths that some rule has
                at = len(host) - n
                if m <= len(path) and (at == 0 or at > 0 and host[at - 1] == "."):
                    probes.append((host[at:] + path[:m], n))
                    owner.append(k)
        keys = np.fromiter((self.hash_of(p) for p, _ in probes), dtype=np.uint64, count=len(probes))
        best = [-1] * len(hosts)
        size = lambda i: (int(self.hosts[i] + self.paths[i]), int(self.hosts[i])) if i >= 0 else (-1, -1)
        for k, i in zip(owner, self.probe(keys, probes), strict=True):
            if i >= 0 and size(i) > size(best[k]):
                best[k] = i
        return best


@lru_cache(maxsize=4)
def mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per page: id, host, path, the deciding rule's string or null, and the verdict."""
    index = build(rules)
    name = f"url-rules-{hashlib.sha256(index).hexdigest()[:16]}.bin"
    context = pages.sparkSession.sparkContext
    if not any(f.endswith(f"/{name}") for f in context.listFiles):  # the name stands for the content
        folder = tempfile.mkdtemp(prefix="url-rules-")  # read by the driver's file server alone
        with open(os.path.join(folder, name), "wb") as out:
            out.write(index)
        context.addFile(os.path.join(folder, name))

    def work(ids, hosts, paths):
        own = mapped(name)
        best = own.judge(hosts, paths)
        return ids, hosts, paths, [own.rule(i) if i >= 0 else None for i in best], [default if i < 0 else "block" if own.blocked[i] else "allow" for i in best]

    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return map_rows(urls, "page_id long, host string, path string, rule string, verdict string", work)
