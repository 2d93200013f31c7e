"""URL filters: rules kept as a sorted array of 64-bit digests, probed by binary search.

``digest_file`` lays out one file: the sorted XXH64 keys of all rules, the offsets of their texts,
the texts, and the verdicts. Its bytes reach the executors as a broadcast; each
task maps them from an unnamed file, forms the keys a url can match (each parent of its host joined with each
path length that occurs among the rules), searches all of them at once, and compares the stored text
of every hit, so that two texts of one digest are told apart.

Rules are a list of at most ``MAX_RULES`` with ``MAX_BYTES`` in the file. A rule fits its host and
all subdomains when the url's path starts with the rule's path; the longest rule wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; a url
without a rule gets the default verdict; repeated rows are judged one by one; of equal rules the last
counts; no rules and an empty table are fine.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Bounds of the broadcast.
MAX_RULES, MAX_BYTES = 1_000_000, 128 << 20
ALLOW, BLOCK = "allow", "block"

_HOST = r"^.*?://([^/?#]*)"
_PATH = r"^.*?://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COLUMNS = "page_id long, host string, path string, rule string, verdict string"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, f"(?s){_HOST}", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, f"(?s){_PATH}", 1), F.lit(""))


def digest_file(rules: Sequence[tuple[str, str, str]]) -> bytes:
    """The layout of (host, path, verdict) rules."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a digest file holds {MAX_RULES}")
    verdicts = {(h + p).encode(): (len(p), v) for h, p, v in rules}
    texts = sorted(verdicts, key=lambda text: (xxh64_intdigest(text), text))
    keys = np.array([xxh64_intdigest(text) for text in texts], "<u8")
    ends = np.cumsum([0, *map(len, texts)]).astype("<u8")
    blocked = np.array([verdicts[text][1] == BLOCK for text in texts], "<u8")
    sizes = np.array([verdicts[text][0] for text in texts], "<u8")
    head = np.array([len(texts)], "<u8")
    content = b"".join([*(x.tobytes() for x in (head, keys, ends, blocked, sizes)), *texts])
    if len(content) > MAX_BYTES:
        raise ValueError(f"{len(content)} bytes of rules; a digest file holds {MAX_BYTES}")
    return content


class Digests:
    """The mapped file."""

    def __init__(self, content: bytes):
        with tempfile.TemporaryFile() as file:  # the mapping outlives the name
            file.write(content)
            file.flush()
            mapped = np.memmap(file, np.uint8, "r")
        n = int(mapped[:8].view("<u8")[0])
        at = 8
        parts = []
        for count in (n, n + 1, n, n):
            parts.append(mapped[at:at + 8 * count].view("<u8"))
            at += 8 * count
        self.keys, self.ends, self.blocked, self.sizes = parts
        self.texts = mapped[at:]
        self.path_lengths = np.unique(self.sizes).tolist()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Index of each probe's rule, or -1."""
        found = np.full(len(probes), -1, np.int64)
        wanted = np.fromiter(map(xxh64_intdigest, probes), np.uint64, len(probes))
        first = np.searchsorted(self.keys, wanted, "left")
        last = np.searchsorted(self.keys, wanted, "right")
        for i in np.flatnonzero(last > first).tolist():
            for k in range(first[i], last[i]):  # more than one only where digests collide
                if self.texts[int(self.ends[k]):int(self.ends[k + 1])].tobytes() == probes[i]:
                    found[i] = k
        return found


def parents(name: bytes) -> list[bytes]:
    """A host and all its parent domains, longest first."""
    out = [name] if name else []
    dot = name.find(b".")
    while dot >= 0:
        if dot + 1 < len(name):
            out.append(name[dot + 1:])
        dot = name.find(b".", dot + 1)
    return out


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]],
               default: str = ALLOW) -> DataFrame:
    """Host, path, rule and verdict of every page; only id and url are read."""
    shared = pages.sparkSession.sparkContext.broadcast(digest_file(rules))

    def judge(batches):
        digests = Digests(shared.value)
        sizes = digests.path_lengths
        for batch in batches:
            hosts, paths = (batch.column(c).to_pylist() for c in ("host", "path"))
            probes, rows = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                tail = p.encode()
                for parent in parents(h.encode()):
                    mine = [parent + tail[:k] for k in sizes if k <= len(tail)]
                    probes += mine
                    rows += [i] * len(mine)
            best: list[bytes | None] = [None] * batch.num_rows
            verdicts = [default] * batch.num_rows
            hits = digests.find(probes)
            for j in np.flatnonzero(hits >= 0).tolist():
                i, text, k = rows[j], probes[j], hits[j]
                inside = len(text) - int(digests.sizes[k])  # where the rule's path begins
                if text[inside:] and not paths[i].encode().startswith(text[inside:]):
                    continue
                if best[i] is None or len(text) > len(best[i]):
                    best[i], verdicts[i] = text, BLOCK if digests.blocked[k] else ALLOW
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"),
                 pa.array([b and b.decode() for b in best], pa.string()),
                 pa.array(verdicts, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), host(F.col("url")).alias("host"),
                        path(F.col("url")).alias("path")).mapInArrow(judge, COLUMNS)
