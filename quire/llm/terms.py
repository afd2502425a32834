"""Problem 5: frequency of every distinct term, by burst tries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.storage import staged, width

_TERM = re.compile(r"[^\W_]+")


class BurstTrie:
    """Access nodes on term prefixes over compact containers; a container that overflows bursts into longer prefixes."""

    def __init__(self, limit: int = 4096) -> None:
        self.limit = limit
        self.root: dict = {}
        self.size = 0

    def add(self, term: str, count: int, records: int) -> None:
        node, depth = self.root, 0
        while True:
            head = term[depth : depth + 1]
            child = node.get(head)
            if child is None:
                node[head] = {"": {term: [count, records]}}
                self.size += 1
                return
            bucket = child.get("")
            if bucket is None or isinstance(bucket, list):  # burst already: go one letter down
                if len(term) == depth + 1:
                    if bucket is None:
                        child[""] = [term, count, records]
                        self.size += 1
                    else:
                        bucket[1] += count
                        bucket[2] += records
                    return
                node, depth = child, depth + 1
                continue
            cell = bucket.get(term)
            if cell is not None:
                cell[0] += count
                cell[1] += records
                return
            bucket[term] = [count, records]
            self.size += 1
            if len(bucket) > self.limit:
                self._burst(node, head, depth)
            return

    def _burst(self, node: dict, head: str, depth: int) -> None:
        bucket = node[head].pop("")
        node[head] = child = {}
        for term, (c, r) in bucket.items():
            if len(term) == depth + 1:
                child[""] = [term, c, r]
            else:
                child.setdefault(term[depth + 1], {}).setdefault("", {})[term] = [c, r]

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, terms with their counters) of every container; a term that ends at a burst node is one of its own."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for head, child in node.items():
                if head == "":
                    continue
                rest = child.get("")
                if isinstance(rest, list):
                    yield rest[0], {rest[0]: rest[1:]}
                elif rest is not None:
                    yield prefix + head, rest
                    continue
                stack.append((prefix + head, child))

    def __len__(self) -> int:
        return self.size


_PACKED = "prefix string, size int, terms string, n binary, records binary"


def _pack(rows: list[tuple[str, list[str], list[list[int]]]]) -> pa.RecordBatch:
    """Containers as rows: prefix, number of terms, the terms in order, their counters."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([len(r[1]) for r in rows], pa.int32()),
            pa.array(["\n".join(r[1]) for r in rows], pa.string()),
            pa.array([np.array([c[0] for c in r[2]], dtype=np.int64).tobytes() for r in rows], pa.binary()),
            pa.array([np.array([c[1] for c in r[2]], dtype=np.int64).tobytes() for r in rows], pa.binary()),
        ],
        ["prefix", "size", "terms", "n", "records"],
    )


def _unpack(row: dict) -> Iterator[tuple[str, int, int]]:
    return zip(row["terms"].split("\n"), np.frombuffer(row["n"], dtype=np.int64).tolist(), np.frombuffer(row["records"], dtype=np.int64).tolist())


def _count(most_terms: int) -> Callable:
    """Count the terms of every record into a trie; its containers are sent when it holds ``most_terms``, and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
            rows = []
            for prefix, held in trie.containers():
                names = sorted(held)
                rows.append((prefix, names, [held[t] for t in names]))
                if len(rows) == 256:
                    yield _pack(rows)
                    rows = []
            if rows:
                yield _pack(rows)

        trie = BurstTrie()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for term, n in Counter(_TERM.findall(text.lower())).items():
                    trie.add(term, n, 1)
                if len(trie) >= most_terms:
                    yield from sent(trie)
                    trie = BurstTrie()
        yield from sent(trie)

    return run


def _bounds(packed: DataFrame, routes: int, sampled: int = 20_000) -> list[str]:
    """Prefixes at which routes begin, so that about as many terms go each way: long ones where many terms begin alike.

    Taken from at most ``sampled`` containers; this decides how evenly the work is spread, never a count."""
    rows = packed.select("prefix", "size").orderBy(F.xxhash64("prefix", "size"), "prefix").limit(sampled).collect()
    rows.sort(key=lambda r: r.prefix)
    total, held, out = sum(r.size for r in rows), 0, []
    for r in rows:
        if held * routes >= total * (len(out) + 1) and (not out or r.prefix > out[-1]):
            out.append(r.prefix)
        held += r.size
    return out


def _routed(bounds: list[str]) -> Callable:
    """Containers with their route; one that reaches over a bound is cut there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, routes = [], []
            for r in batch.to_pylist():
                terms = r["terms"].split("\n")
                first, last = bisect_right(bounds, terms[0]), bisect_right(bounds, terms[-1])
                cuts = [0, *(bisect_left(terms, b) for b in bounds[first:last]), len(terms)]
                counters = list(zip(np.frombuffer(r["n"], dtype=np.int64).tolist(), np.frombuffer(r["records"], dtype=np.int64).tolist()))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        rows.append((r["prefix"], terms[a:b], counters[a:b]))
                        routes.append(first + k)
            yield pa.RecordBatch.from_arrays([pa.array(routes, pa.int32()), *_pack(rows).columns], ["route", *[c.split(" ")[0] for c in _PACKED.split(", ")]])

    return run


def _merge(group: pa.Table) -> pa.Table:
    """The subtrees of all workers for one route as one trie, and its terms."""
    trie = BurstTrie()
    for batch in group.to_batches(max_chunksize=64):
        for row in batch.to_pylist():
            for term, n, records in _unpack(row):
                trie.add(term, n, records)
    names, n, records = [], [], []
    for _, held in trie.containers():
        names += held
        n += [c[0] for c in held.values()]
        records += [c[1] for c in held.values()]
    return pa.table({"term": pa.array(names, pa.string()), "n": pa.array(n, pa.int64()), "records": pa.array(records, pa.int64())})


def term_frequencies(records: DataFrame, column: str = "text", rare_at_most: int = 2, common_share: float = 0.1, most_terms: int = 500_000) -> DataFrame:
    """Count every term of ``column``: occurrences, records that hold it, and a mark.

    A term is a maximal run of letters or numbers of the lower-cased text.  Each worker counts into a burst trie
    and sends its containers (when it holds ``most_terms``, and at the end); matching subtrees of all workers are routed
    by adaptive prefixes (longer where many terms begin alike) to one worker and merged there.  ``mark`` is ``rare`` if at most ``rare_at_most`` records hold the term, else ``common`` if
    more than ``common_share`` of all records (null and empty texts count as records) do, else null.

    Result: term, n, records, mark.  Null and empty texts hold no term; an empty table gives an empty result.
    """
    spark = records.sparkSession
    total = records.count()
    texts = records.filter(F.col(column).isNotNull()).select(F.col(column).alias("text"))
    packed = staged(texts.mapInArrow(_count(most_terms), _PACKED), "tries")
    routes = 4 * width(spark)
    sent = packed.mapInArrow(_routed(_bounds(packed, routes)), "route int, " + _PACKED)
    merged = sent.groupBy("route").applyInArrow(_merge, "term string, n long, records long")
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > F.lit(common_share * total), "common")
    return merged.select("term", "n", "records", mark.alias("mark"))
