"""Near copies by HyperMinHash sketches: banded registers find pairs, their estimate sorts out, full shingle sets confirm.

A text's shingle hashes fall into REGISTERS buckets. A register keeps its bucket's smallest hash in a few bits: the count of leading
zeros, and the MANTISSA bits behind the first one. An empty bucket borrows from another of the same text, in an order fixed for each
bucket, so that two texts' registers agree with the probability of their Jaccard similarity whatever their sizes are.

1. Sets are banded: WIDTH registers together are one band. A set is as central as the sets that its bands hold are many; the most central set of a
   band is its pivot. Two sets of similarity s miss each other in all bands with probability (1 - s^WIDTH)^BANDS (at 0.85: 3e-7).
2. Every set is compared with the pivot of its largest band, then with the pivots of other bands that it isn't connected with yet. The share of
   equal registers, less what unlike hashes agree by chance (``collisions``), estimates the similarity. Pairs that reach the limit less MARGIN
   (five standard deviations) are confirmed on their full sets.
3. Where the sets of a pivot aren't all connected by then, two others than the pivot may be linked. They are looked up by the rarest shingles in
   which they differ from the pivot (see ``_looked_up``): not all pairs are formed. Pairs found are estimated and confirmed like the others.

Equal sets are one set. A pivot is sent to its sets once for every PER_SALT of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.bytescan import Words, blocks, encoded, mix, shingles, spaced
from claimloom.llm.components import stars, with_roots
from claimloom.sources.scratch import written

REGISTERS, MANTISSA = 192, 10
BANDS, WIDTH = 32, 6
MARGIN = 0.2
#: Rows whose texts are in memory as Python objects at once.
ROWS = 1000
#: Sets that meet their pivot in one part, on average; a pivot of more has several parts.
PER_SALT = 256
#: Ids are put in so many slots to keep texts that no set needs from being shuffled; the join by id is exact.
SLOTS = 1 << 20

_BORROW = np.array([np.random.default_rng(31 + j).permutation(REGISTERS) for j in range(REGISTERS)])
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40))
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def least_linked(percent: int) -> int:
    """The size from which a set can be linked with another than its equal."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def registers(found: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each sorted array of shingle hashes; zeros for an empty one."""
    h, sizes = np.concatenate(found), [len(x) for x in found]
    owner, bucket = np.repeat(np.arange(len(found)), sizes), ((h & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(len(found) * REGISTERS, np.iinfo(np.uint64).max)
    np.minimum.at(least, owner * REGISTERS + bucket.astype(np.int64), h)
    least = least.reshape(len(found), REGISTERS)
    filled = least < np.iinfo(np.uint64).max
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - exponent, 63)
    out = (zeros << MANTISSA) | ((mantissa - 0.5).clip(0) * (2 << MANTISSA)).astype(np.int64)
    row, column = np.nonzero(~filled & (np.array(sizes) > 0)[:, None])
    for turn in range(REGISTERS):
        if not len(row):
            break
        source = _BORROW[column, turn]
        full = filled[row, source]
        out[row[full], column[full]] = out[row[full], source[full]]
        row, column = row[~full], column[~full]
    return np.where((np.array(sizes) > 0)[:, None], out, 0).astype(np.uint16)


def bands(sketches: np.ndarray) -> np.ndarray:
    parts = sketches[:, : BANDS * WIDTH].reshape(len(sketches), BANDS, WIDTH).astype(np.uint64)
    return mix((parts * _PLACE).sum(axis=2, dtype=np.uint64) ^ _BAND).view(np.int64)


def collisions(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The chance that registers of unlike hashes are equal, for sets of these sizes."""
    level = 2.0 ** -np.arange(40)
    # the smallest of x uniform numbers is between level / 2 and level
    shares = [(1 - level / 2) ** x - (1 - level) ** x for x in (np.maximum(1, n / REGISTERS)[:, None] for n in (na, nb))]
    return (shares[0] * shares[1]).sum(axis=1) / (1 << MANTISSA)


def estimated(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    chance = collisions(na, nb)
    return ((ra == rb).mean(axis=1) - chance) / (1 - chance)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """For a block of rows: its range, their shingles, and the hash of each set (0 of an empty one)."""
    for at in range(0, len(batch), ROWS):
        blobs = encoded(batch.column(1).slice(at, ROWS).to_pylist())
        for a, b in blocks(blobs):
            found = shingles(Words(blobs[a:b], spaced()), size)
            keys = [int((mix(s).sum() + np.uint64(len(s))).view(np.int64)) if len(s) else 0 for s in found]
            yield at + a, at + b, found, np.array(keys, np.int64)


def sketched(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """id, n (shingles), key (hash of the set) and sketch of every row; the sketch is null where a link is out of the question."""
    least = least_linked(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found, keys in _sets(batch, size):
                n = np.array([len(s) for s in found], np.int64)
                sketches = np.full(len(n), None)
                if (large := n >= least).any():
                    sketches[large] = [r.tobytes() for r in registers([found[i] for i in np.flatnonzero(large).tolist()])]
                columns = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(keys), pa.array(sketches.tolist(), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "key", "sketch"])

    return docs.mapInArrow(sketch, "id bigint, n bigint, key bigint, sketch binary")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """key, id (the smallest), n and sketch of every set that may be linked; equal sets are combined before the shuffle."""
    rows = signed.where("id IS NOT NULL AND sketch IS NOT NULL")
    return written(rows.groupBy("key").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("sketch").alias("sketch")), "sets")


def _banded(sets: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(found.ravel())], names=["a", "band"])

    return sets.select("key", "sketch").mapInArrow(cut, "a bigint, band bigint")


def banded_pairs(sets: DataFrame) -> DataFrame:
    """a, b, count: every set and the pivots of its bands, with how many sets its largest band with that pivot holds."""
    rows = _banded(sets)
    shared = written(rows.groupBy("band").agg(F.count("*").alias("count")).where("count > 1"), "bands")
    met = written(rows.join(shared, "band"), "met")
    central = met.groupBy("a").agg(F.sum("count").alias("central"))
    pivots = met.join(central, "a").groupBy("band").agg(F.max(F.struct("central", "a")).alias("p")).select("band", F.col("p.a").alias("b"))
    pairs = met.join(written(pivots, "pivots"), "band").where("a <> b")
    return written(pairs.groupBy("a", "b").agg(F.max("count").alias("count")), "pairs")


def salted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with the part (salt) in which each meets its b, and b and salt of all parts; the large b are one in PER_SALT pairs at most."""
    parts = F.ceil(F.col("rows") / PER_SALT)
    counts = pairs.groupBy("b").agg(F.count("*").alias("rows")).select("b", parts.alias("parts"))
    large = F.broadcast(counts.where("parts > 1"))
    dealt = pairs.join(large, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))).drop("parts")
    return dealt, counts


def _sent(table: DataFrame, counts: DataFrame, how: str = "inner") -> DataFrame:
    """The rows of ``table`` (key b), once for each part."""
    return counts.join(table, "b", how).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")


def beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both sides (named _a and _b); many pairs may have one b."""
    dealt, counts = salted(pairs)
    right = _sent(table.select(F.col("key").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns)), counts)
    left = table.select(F.col("key").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    return dealt.join(right, ["b", "salt"]).drop("salt").join(left, "a")


def likely(pairs: DataFrame, sets: DataFrame, percent: int, margin: float = MARGIN) -> DataFrame:
    """The pairs a, b whose estimate reaches the limit less ``margin``."""
    least = percent / 100 - margin

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (4, 5))
                keep = pa.array(estimated(ra, rb, na, nb) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    rows = beside(pairs, sets, ["sketch", "n"]).where(fits)
    return rows.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(estimate, "a bigint, b bigint")


def _shingled(docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """key and tokens (all shingles) of the given sets, from one text of each."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            for a, _, found, keys in _sets(batch, size):
                keep = [i for i, k in enumerate(keys.tolist()) if k == wanted[a + i]]
                if keep:
                    tokens = pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), tokens], names=["key", "tokens"])

    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    slots = F.broadcast(sets.select(slot.alias("slot")).distinct())  # SLOTS rows at most
    texts = docs.withColumn("slot", slot).join(slots, "slot", "left_semi").join(sets.select("id", "key"), "id").select("id", "text", "key")
    # a repeated row gives its set again
    return texts.mapInArrow(whole, "key bigint, tokens array<bigint>").groupBy("key").agg(F.first("tokens").alias("tokens"))


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    rows = beside(pairs, full, ["tokens"]).select("a", "b", F.size("tokens_a").alias("na"), F.size("tokens_b").alias("nb"), common.cast("long").alias("common"))
    return written(rows.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"), "links")


def _connected(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` with the components ca and cb of their sets, from the stars ``found``."""
    # many pairs may have one b: pivots are few, their components are looked up apart
    dealt, counts = salted(pairs)
    pivots = _sent(found.select(F.col("a").alias("b"), F.col("b").alias("cb")), counts, "left")
    named = dealt.join(found.select("a", F.col("b").alias("ca")), "a", "left")
    return named.join(pivots, ["b", "salt"]).drop("salt").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))


def _looked_up(pairs: DataFrame, found: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share a pivot, aren't connected by the stars ``found``, and may be linked.

    D is what a set has apart from its pivot p, either way; q and r are 100 less and plus ``percent``. Linked sets x and y differ in at most
    q / r of their sizes' sum, so of D(x) all but q / percent * n(x) elements are in D(y). x is not linked with p (if both were, they would be
    connected), therefore more than half of ``|D(y)| + q / r * (n(p) - n(y))`` are common too. With so many in common, the rarest of D(x) and of D(y), as many as
    are left and one more, have one in common. The two together need ``(|D(x)| + |D(y)| - q / r * (n(x) + n(y))) / 2`` in common, and of these none comes before the
    first that is found: as many must be left of either, from there on.
    """
    q, r = 100 - percent, 100 + percent
    named = written(_connected(pairs.select("a", "b"), found), "named")
    # a pivot's sets in several components, not counting the pivot itself
    mixed = named.groupBy("b").agg(F.min("ca").alias("x"), F.max("ca").alias("y")).where("x <> y").select("b")
    among = named.join(mixed, "b", "left_semi").select("a", "b", F.col("ca").alias("c"))
    apart = F.concat(F.array_except("tokens_a", "tokens_b"), F.array_except("tokens_b", "tokens_a"))
    rows = beside(among, full, ["tokens"]).select("a", "b", "c", F.size("tokens_a").alias("na"), F.size("tokens_b").alias("nb"), apart.alias("apart"))
    # similar: 100 * common >= percent * union, where union - common = |D|
    similar = (F.col("na") + F.col("nb")) * q >= F.size("apart") * r
    rows = written(rows.withColumn("linked", similar), "apart")
    elements = rows.select("a", "b", F.explode("apart").alias("token"))
    counts = elements.groupBy("b", "token").count().where("count > 1")
    lists = elements.join(counts, ["b", "token"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("t"))
    d = F.size("apart").cast("long")
    # every set offers its elements; one that isn't linked with the pivot asks with its own
    asking = F.struct(F.lit(True).alias("asks"), (d - F.floor(q * F.col("na") / percent)).cast("long").alias("common"))
    offering = F.struct(F.lit(False).alias("asks"), (F.floor((r * d + q * (F.col("nb") - F.col("na"))) / (2 * r)) + 1).cast("long").alias("common"))
    sides = rows.join(lists, ["a", "b"]).withColumn("side", F.explode(F.when(F.col("linked"), F.array(offering)).otherwise(F.array(asking, offering))))
    # what no other set of the pivot has comes first in order, and can't meet
    taken = F.greatest(F.lit(0), d - F.greatest(F.lit(1), F.col("side.common")) + 1 - (d - F.size("t"))).cast("int")
    rarest = F.posexplode(F.slice(F.transform("t", lambda x: x.token), F.lit(1), taken)).alias("place", "token")
    given = sides.select("a", "b", "c", "na", d.alias("d"), "side.asks", F.size("t").alias("size"), rarest)
    keyed = written(given.withColumn("left", F.col("size") - F.col("place")).drop("size", "place"), "keyed")
    several = keyed.groupBy("b", "token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("b", "token")
    met = written(keyed.join(several, ["b", "token"], "left_semi"), "met")
    right = met.where("NOT asks").select("b", "token", F.col("a").alias("y"), F.col("c").alias("cy"), F.col("na").alias("ny"), F.col("d").alias("dy"), F.col("left").alias("left_y"))
    # linked sets are of like size, and as far from the pivot but for what they differ in
    alike = f"100 * na >= {percent} * ny AND 100 * ny >= {percent} * na AND abs(d - dy) * {r} <= {q} * (na + ny)"
    enough = f"2 * {r} * least(left, left_y) >= {r} * (d + dy) - {q} * (na + ny)"
    both = met.where("asks").join(right, ["b", "token"]).where(f"c <> cy AND {alike} AND {enough}")
    return written(both.select(F.least("a", "y").alias("a"), F.greatest("a", "y").alias("b")).distinct(), "looked_up")


def linked(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all sets that links connect."""
    pairs = banded_pairs(sets)
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "key")
    full = written(_shingled(docs, sets.select("key", "id").join(wanted, "key", "left_semi"), size), "full")
    closest = written(pairs.groupBy("a").agg(F.max(F.struct("count", "b")).alias("m")).select("a", "m.b"), "closest")
    found = stars(_confirmed(written(likely(closest, sets, percent), "likely"), full, percent))
    rest = _connected(pairs.select("a", "b"), found).where("ca <> cb").select("a", "b").join(closest, ["a", "b"], "left_anti")
    # links found later are added to the stars of the earlier ones: these connect the same sets
    found = stars(found.unionByName(_confirmed(written(likely(written(rest, "rest"), sets, percent), "likely"), full, percent)))
    more = _looked_up(pairs, found, full, percent)
    return found.unionByName(_confirmed(written(likely(more, sets, percent), "likely"), full, percent))


def deduplicated(docs: DataFrame, doc_id: str, text: str, size: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles; words part at ASCII space,
    A-Z count as a-z. Shorter texts are one shingle. A null, empty or blank text has none and is linked with nothing. The component is known by the smallest
    id that links reach, whose rows are kept. A row without an id has a null component, links nothing and is kept. Repeated
    rows are exact copies: those of the smallest id are all kept. An empty table gives none. Texts of any length are shingled whole.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = written(sketched(rows, size, percent), "signatures")
    found = stars(linked(rows, distinct_sets(signed), size, percent))
    return in_classes(signed, with_roots(found)).select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def in_classes(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """id, n and component_id of every signed row, from the component of each linked set (node, component)."""
    # equal sets are known by their smallest id, components of sets by the smallest of those
    sets = signed.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    sets = sets.join(groups.withColumnRenamed("node", "key"), "key", "left")
    least = sets.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    names = sets.where("rows > 1 OR component IS NOT NULL").join(least, "component", "left").select("key", F.coalesce("least", "first").alias("name"))
    # sets with rows of one id alone keep it without a lookup
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(names, "key", "left")
    return out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("name", "id")).alias("component_id"))
