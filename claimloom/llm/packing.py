"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

A document longer than a bin is cut; its full pieces fill bins of their own. Other pieces go, longest first, to the fullest
bin that has room and no conflict: two copies (documents of one duplicate cluster) never share a bin, and a bin takes at most
``per_source`` pieces of a source. Bins stand in the order of what is left in them; the search starts at the piece's size and
goes on to the next larger residual until a bin is compatible. A bin carries one bitmap of the sources that are full in it
and one of its clusters. Frequent sources and clusters also keep, for each residual, how many bins would take them,
so that the search skips residuals where none does.

Documents are dealt to shards of about SHARD at random, so a frequent source or cluster spreads over all of them; a shard
is packed in one task and shares no bin with another. Only ids and sizes move, no texts.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import written

#: Code points in a bin.
CAPACITY = 8192
PER_SOURCE = 4
#: Documents in a shard, on average.
SHARD = 4096
#: A source or cluster with more pieces in a shard is frequent.
FREQUENT = 64

_OUT = "doc_id bigint, piece int, start bigint, end bigint, bin_id bigint, place int"


class _Bins:
    """The open bins of a shard."""

    def __init__(self, capacity: int, per_source: int, sources: list, clusters: list):
        self.capacity, self.per_source = capacity, per_source
        self.levels: dict[int, list[int]] = {}
        self.mask = 0
        self.left: list[int] = []
        self.held: list[Counter] = []
        self.full: list[int] = []
        self.copies: list[int] = []
        self.source_bit = {s: i for i, s in enumerate(dict.fromkeys(sources))}
        self.cluster_bit = {c: i for i, (c, n) in enumerate(Counter(clusters).items()) if c is not None and n > 1}
        #: For frequent ones: by residual, the number of bins that would take them, and the residuals with any.
        self.takers = {("s", self.source_bit[s]): Counter() for s, n in Counter(sources).items() if n > FREQUENT}
        self.takers |= {("c", self.cluster_bit[c]): Counter() for c, n in Counter(clusters).items() if c is not None and n > FREQUENT}
        self.taker_mask = dict.fromkeys(self.takers, 0)

    def _takes(self, key: tuple, b: int) -> bool:
        return not (self.full[b] if key[0] == "s" else self.copies[b]) >> key[1] & 1

    def _enter(self, b: int) -> None:
        r = self.left[b]
        self.levels.setdefault(r, []).append(b)
        self.mask |= 1 << r
        for key, count in self.takers.items():
            if self._takes(key, b):
                count[r] += 1
                self.taker_mask[key] |= 1 << r

    def _leave(self, b: int) -> None:
        r = self.left[b]
        self.levels[r].remove(b)
        if not self.levels[r]:
            self.mask &= ~(1 << r)
        for key, count in self.takers.items():
            if self._takes(key, b):
                count[r] -= 1
                if not count[r]:
                    self.taker_mask[key] &= ~(1 << r)

    def _tightest(self, size: int, source: int, cluster: int | None) -> int | None:
        mask = self.mask
        for key in (("s", source), ("c", cluster)):
            if key in self.taker_mask:
                mask &= self.taker_mask[key]
        mask = mask >> size << size
        while mask:
            r = (mask & -mask).bit_length() - 1
            for b in self.levels[r]:
                if not self.full[b] >> source & 1 and (cluster is None or not self.copies[b] >> cluster & 1):
                    return b
            mask &= mask - 1
        return None

    def put(self, size: int, source, cluster) -> tuple[int, int]:
        """The bin, and how many pieces it held before."""
        source, cluster = self.source_bit[source], self.cluster_bit.get(cluster)
        b = self._tightest(size, source, cluster)
        if b is None:
            b = len(self.left)
            self.left.append(self.capacity)
            self.held.append(Counter())
            self.full.append(0)
            self.copies.append(0)
        else:
            self._leave(b)
        place = sum(self.held[b].values())
        self.left[b] -= size
        self.held[b][source] += 1
        if self.held[b][source] >= self.per_source:
            self.full[b] |= 1 << source
        if cluster is not None:
            self.copies[b] |= 1 << cluster
        self._enter(b)
        return b, place


def pack(rows: pd.DataFrame, capacity: int, per_source: int) -> list[tuple]:
    """(row, piece, start, end, bin, place) of a shard: columns id, size, source, cluster."""
    n = rows["size"].to_numpy()
    rest = [int(x % capacity) if x % capacity or not x else 0 for x in n]
    order = sorted((i for i in range(len(n)) if rest[i] or not n[i]), key=lambda i: (-rest[i], rows["key"].iat[i]))
    sources, clusters = rows["source"].tolist(), [None if pd.isna(c) else c for c in rows["cluster"]]
    bins, out = _Bins(capacity, per_source, [sources[i] for i in order], [clusters[i] for i in order]), []
    for i in order:
        b, place = bins.put(rest[i], sources[i], clusters[i])
        out.append((i, int(n[i] // capacity), int(n[i]) - rest[i], int(n[i]), b, place))
    b = len(bins.left)
    for i in range(len(n)):
        for piece in range(int(n[i] // capacity)):
            out.append((i, piece, piece * capacity, (piece + 1) * capacity, b, 0))
            b += 1
    return out


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the cluster of their group; only ids, sizes and hashes move."""
    rows = written(rows, "sizes")
    first = groups.where("id IS NOT NULL").groupBy("id").agg(F.min("group").alias("group"))
    named = rows.where("id IS NOT NULL").join(first, "id", "left")
    loose = rows.where("id IS NULL")
    if loose.isEmpty():
        both = named
    else:
        # the group of an equal text, for the few hashes that rows without an id have
        equal = named.join(loose.select("cluster").distinct(), "cluster", "left_semi").groupBy("cluster").agg(F.min("group").alias("group"))
        both = named.unionByName(loose.join(equal, "cluster", "left"))
    cluster = F.when(F.col("group").isNull() | F.col("cluster").isNull(), F.col("cluster")).otherwise(F.xxhash64("group", F.lit("group")))
    return both.select("id", "size", "source", cluster.alias("cluster"))


def packed(docs: DataFrame, doc_id: str, text: str, source: str, cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, groups: DataFrame | None = None) -> DataFrame:
    """doc_id, piece (from 0), start, end (code points, end exclusive), bin_id, place in the bin: one row for each piece.

    The pieces of a document, in order, are its whole text. A null or empty text is one empty piece, which takes no room. A
    null source is a source of its own. Without a cluster column equal texts are copies; null clusters and empty texts are
    copies of nothing. ``groups`` (the id, component_id) joins near copies: rows with an id take its group as their cluster, and rows without one the
    group of an equal text. Rows without an id and repeated rows are packed like others. An empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    copies = F.when(F.length(whole) > 0, F.xxhash64(whole)) if cluster is None else F.xxhash64(F.col(cluster).cast("string"))
    copies = copies if cluster is None else F.when(F.col(cluster).isNotNull(), copies)
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.char_length(whole).cast("bigint").alias("size"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), copies.alias("cluster")
    )
    if groups is not None:
        rows = _grouped(rows, groups.select(F.col(doc_id).cast("bigint").alias("id"), F.col("component_id").alias("group")))
    n = max(1, -(-docs.count() // shard))
    # written: a task that is run again would number repeated rows anew, and deal them to other shards
    rows = written(rows.withColumn("key", F.xxhash64("id", "cluster", F.monotonically_increasing_id())), "keys").withColumn("shard", F.pmod("key", F.lit(n)))

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = pack(part, capacity, per_source)
        ids = part["id"].astype("Int64").to_numpy()
        named = [(ids[i], piece, a, b, key[0] << 32 | c, place) for i, piece, a, b, c, place in out]
        return pd.DataFrame(named, columns=["doc_id", "piece", "start", "end", "bin_id", "place"]).astype({"doc_id": "Int64"})

    return rows.groupBy("shard").applyInPandas(fill, _OUT).withColumnRenamed("doc_id", doc_id)


def texts(pieces: DataFrame, docs: DataFrame, doc_id: str, text: str, separator: str = "\n") -> DataFrame:
    """bin_id and text of every bin: its pieces in their places. A bin has at most its capacity and the separators. Ids must be unique."""
    rows = pieces.join(docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("whole")), doc_id)
    part = F.expr("substring(whole, CAST(start AS INT) + 1, CAST(end - start AS INT))")
    lists = rows.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))).alias("parts"))
    return lists.select("bin_id", F.array_join(F.transform("parts", lambda p: p.part), separator).alias("text"))
