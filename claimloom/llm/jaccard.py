"""N-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets are one set. Sets are taken through these steps, each exact:

1. Of the hashes a set has, the smallest few are looked up; two linked sets have a known number of
   those in common, so sets that share fewer with other sets leave here.
2. The remaining sets are shingled once more, and their shingles counted. A set that shares too few
   shingles at all leaves. The others put theirs in order, rarest first; linked sets have one of the
   rarest in common (the prefix).
3. Similar sets are grouped: each is compared with the most central set of its prefix shingles, joins the
   one it is most similar to, and that one in turn its own. The most central set of a group is its pivot.
4. The token-group matrix holds which shingles each group's union has. Every set's overlap with every
   other group is bounded by it; only groups that reach the needed overlap are opened, as if the set were a member.
5. In a group, sets are looked up by the shingles in which they differ from the pivot (see ``_within``), and compared.

What a shingle or a set is known by is a 64-bit hash. Hot shingles are counted before the shuffle and
joined, never gathered; what links with the pivot of a large group of near copies isn't compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.bytescan import Words, mix, shingles, sliced, spaced
from claimloom.llm.components import components
from claimloom.sources.scratch import written


def _need(n, percent: int):
    """The fewest shingles that a set of n has in common with a linked one."""
    return (n * percent + 99) // 100


def _slack(n):
    return n // 10 + 1


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """For a block of rows: its range, their shingles, and the hash of each set (0 of an empty one)."""
    for at, blobs in sliced(batch.column(1)):
        found = shingles(Words(blobs, spaced()), size)
        keys = [int((mix(s).sum() + np.uint64(len(s))).view(np.int64)) if len(s) else 0 for s in found]
        yield at, at + len(blobs), found, np.array(keys, np.int64)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found, keys in _sets(batch, size):
                n = pa.array([len(s) for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, pa.array(keys)], names=["id", "n", "key"])

    return docs.mapInArrow(sign, "id bigint, n bigint, key bigint")


def _least(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """token, key, known: the smallest shingles of every text, summed up before the shuffle.

    A shingle that several sets of a block have is known to be shared: each of the texts gets a row (key as token) with how many
    of such it has, and only two rows with known = 0 go on for others to meet. The rest have known = -1.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, found, keys in _sets(batch, size):
                parts = [s[: len(s) - _need(len(s), percent) + _slack(len(s))] if len(s) else s for s in found]
                tokens, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                if not len(tokens):
                    continue
                names, at = np.unique(tokens, return_inverse=True)
                low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
                np.minimum.at(low, at, keys[owner])
                np.maximum.at(high, at, keys[owner])
                several = low != high
                local = np.bincount(owner[several[at]], minlength=len(parts))
                credited = np.flatnonzero(local)
                rest = ~several[at]
                token = np.concatenate((tokens[rest].view(np.int64), names[several].view(np.int64), names[several].view(np.int64), keys[credited]))
                key = np.concatenate((keys[owner[rest]], low[several], high[several], keys[credited]))
                known = np.concatenate((np.full(rest.sum(), -1), np.zeros(2 * several.sum()), local[credited])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(key), pa.array(known)], names=["token", "key", "known"])

    return docs.mapInArrow(emit, "token bigint, key bigint, known int")


def _shingled(docs: DataFrame, size: int) -> DataFrame:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            for a, _, found, keys in _sets(batch, size):
                keep = [i for i, k in enumerate(keys) if k == wanted[a + i]]
                if keep:
                    tokens = pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array([len(found[i]) for i in keep], pa.int64()), tokens], names=["key", "n", "tokens"])

    return docs.mapInArrow(whole, "key bigint, n bigint, tokens array<bigint>")


def _near(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _compared(pairs: DataFrame, sets: DataFrame, *more: Column) -> DataFrame:
    """a, b, their sizes na and nb and how much they have in ``common``; ``more`` may use their shared shingles ta and tb."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("common"), *more)


def _similar(percent: int) -> Column:
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def _shared_sets(rows: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """Distinct sets (key, n, id of one document) that may be linked with another: step 1.

    Copies each have their set's shared shingles, so counts are divided by the number of copies.
    """
    # conditions that the joins add to one use of the shuffle stand here, so that both uses are one shuffle of one scan
    tokens = _least(rows.where("id IS NOT NULL"), size, percent).where("token IS NOT NULL AND key IS NOT NULL").repartition("token")
    owner = F.when(F.col("known") <= 0, F.col("key"))
    shared = tokens.groupBy("token").agg(F.min(owner).alias("x"), F.max(owner).alias("y")).where("x <> y").select("token", F.lit(1).alias("met"))
    credit = F.when(F.col("known") > 0, F.col("known")).when((F.col("known") < 0) & F.col("met").isNotNull(), 1).otherwise(0)
    found = tokens.join(shared, "token", "left").groupBy("key").agg(F.sum(credit).alias("count")).where("count > 0")
    needed = F.floor(F.floor((F.col("n") * percent + 99) / 100) / 10) + 1
    sets = signed.where("n > 0 AND id IS NOT NULL").groupBy("key", "n").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    return sets.join(found, "key").where(F.col("count") >= needed * F.col("rows")).select("key", "n", "id")


#: Ids are put in so many slots to keep texts that no set needs from being shuffled; the join by id is exact.
SLOTS = 1 << 20


def _candidates(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """key, n, tokens (shared ones, rarest first), prefix (how many of them are looked up): step 2."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    slots = F.broadcast(sets.select(slot.alias("slot")).distinct())  # SLOTS rows at most
    texts = docs.withColumn("slot", slot).join(slots, "slot", "left_semi").join(sets.select("id", "key"), "id").select("id", "text", "key")
    full = written(_shingled(texts, size), "shingles")
    tokens = full.select("key", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").count().where("count > 1").select("token", F.col("count").cast("int").alias("count"))
    lists = tokens.join(counts, "token").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("count", "token"))).alias("t"))
    need = F.floor((F.col("n") * percent + 99) / 100)
    kept = lists.join(sets.select("key", "n"), "key").where(F.size("t") >= need)
    prefix = (F.size("t") - need + 1).cast("int")
    return kept.select("key", "n", F.transform("t", lambda t: t.token).alias("tokens"), prefix.alias("prefix"), (F.size("t") / F.col("n")).alias("shared"))


def _stars(looked_up: DataFrame, sets: DataFrame) -> DataFrame:
    """Every set compared with the most central set that has one of its prefix shingles."""
    central = looked_up.groupBy("token").agg(F.max(F.struct("shared", "n", "key")).alias("c"), F.count("*").alias("rows")).where("rows > 1")
    pairs = looked_up.join(central.select("token", F.col("c.key").alias("b")), "token").where("key <> b").select(F.col("key").alias("a"), "b").distinct()
    return written(_compared(pairs, sets), "stars")


def _groups(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """key, n, pivot: sets grouped with the most similar central set, that one in turn with its own; the most central is the pivot."""
    best = stars.groupBy("a").agg(F.max(F.struct(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), "b")).alias("m")).select("a", "m.b")
    found = components(best, "a", "b").withColumnRenamed("node", "key")
    named = sets.select("key", "n", "shared").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    pivots = named.groupBy("component").agg(F.max(F.struct("shared", "n", "key")).alias("p")).select("component", F.col("p.key").alias("pivot"))
    return written(named.join(pivots, "component").select("key", "n", "pivot"), "groups")


def _opened(looked_up: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Sets and the pivots of other groups whose union has enough of the set's shingles."""
    rows = looked_up.select("token", "key").join(grouped, "key")
    several = rows.groupBy("token").agg(F.min("pivot").alias("x"), F.max("pivot").alias("y")).where("x <> y").select("token")
    rows = written(rows.join(several, "token", "left_semi"), "grouped")
    matrix = rows.select("token", F.col("pivot").alias("other")).distinct()
    met = written(rows.join(matrix, "token").where("pivot <> other").select("key", "n", "other").distinct(), "met")
    members = grouped.select("key", F.col("pivot").alias("other")).join(met.select("other").distinct(), "other", "left_semi")
    union = members.join(sets.select("key", F.explode("tokens").alias("token")), "key").select("other", "token").distinct()
    asked = met.join(sets.select("key", "tokens"), "key").select("key", "n", "other", F.explode("tokens").alias("token"))
    overlap = asked.join(union, ["other", "token"]).groupBy("key", "n", "other").count()
    return overlap.where(F.col("count") >= F.floor((F.col("n") * percent + 99) / 100)).select(F.col("key").alias("a"), F.col("other").alias("b"))


def _within(against: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a group's sets that may be linked, from what each has apart from the pivot (its difference).

    If a isn't linked with the pivot, a linked b shares s elements of the differences with it; s is bounded from below
    for either side, so that the rarest ``size - s + 1`` of each difference have one in common. Two sets that are both linked with the pivot
    are connected and not looked at.
    """
    q, r = 100 - percent, 100 + percent
    elements = against.select("a", "b", F.explode("apart").alias("token"))
    counts = elements.groupBy("b", "token").count().where("count > 1")
    lists = elements.join(counts, ["b", "token"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("t"))
    d = F.col("na") + F.col("nb") - 2 * F.col("common")
    rows = against.join(lists, ["a", "b"], "left").withColumn("t", F.coalesce(F.transform("t", lambda x: x.token), F.array().cast("array<bigint>")))
    rows = rows.withColumn("d", d).withColumn("alone", F.col("d") - F.size("t") - F.col("pivot_alone"))
    least_any = F.greatest(F.lit(1), F.floor((r * F.col("d") + q * (F.col("nb") - F.col("na"))) / (2 * r)) + 1)
    least_unlinked = F.greatest(F.lit(1), F.col("d") - F.floor(q * F.col("na") / percent))

    def side(rows: DataFrame, least: Column, name: str) -> DataFrame:
        length = (F.col("d") - least + 1 - F.col("alone")).cast("int")
        taken = F.slice("t", F.lit(1), F.greatest(length, F.lit(0)))
        # what only the pivot has is apart from every set: the last in order, one entry stands for all
        last = F.when((length > F.size("t")) & (F.col("pivot_alone") > 0), F.array(F.lit(None).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        return rows.select("b", F.col("a").alias(name), F.col("na").alias(f"n_{name}"), F.col("component").alias(f"c_{name}"), F.explode(F.concat(taken, last)).alias("token")).withColumn(
            "token", F.coalesce("token", F.lit(0))
        )

    left, right = side(rows.where(~_similar(percent)), least_unlinked, "x"), side(rows, least_any, "y")
    met = left.join(right, ["b", "token"]).where((F.col("c_x") != F.col("c_y")) & _near("n_x", "n_y", percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what the join connects: steps 3 to 5."""
    looked_up = written(sets.select("key", "n", "shared", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token")), "prefixes")
    stars = _stars(looked_up, sets)
    grouped = _groups(stars, sets)
    pairs = grouped.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    pairs = pairs.unionByName(_opened(looked_up, grouped, sets, percent).where("a <> b")).distinct()
    apart = F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta"))
    against = written(_compared(pairs, sets, apart.alias("apart"), (F.col("nb") - F.size("tb")).alias("pivot_alone")), "apart")
    first = written(stars.where(_similar(percent)).select("a", "b").unionByName(against.where(_similar(percent)).select("a", "b")), "links")
    found = components(first, "a", "b").withColumnRenamed("node", "a")
    rows = against.join(found, "a", "left").withColumn("component", F.coalesce("component", "a"))
    several = rows.groupBy("b").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("b")
    rest = _compared(_within(written(rows.join(several, "b", "left_semi"), "apart"), percent), sets).where(_similar(percent))
    return first.unionByName(rest.select("a", "b"))


def joined(docs: DataFrame, doc_id: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles;
    words part at ASCII space, A-Z count as a-z. Shorter texts are one shingle. A null, empty or blank text has
    none and is linked with nothing. The component is known by the smallest id that links reach; a row
    without an id has a null component and links nothing. Repeated rows are exact copies. An empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = written(_signatures(rows, size), "signatures")
    shared = written(_shared_sets(rows, signed, size, percent), "shared_sets")
    candidates = written(_candidates(rows, shared, size, percent), "candidates")
    groups = components(written(_links(candidates, percent), "links"), "a", "b")
    # equal sets are known by their smallest id, groups of sets by the smallest of those
    sets = signed.where("n > 0").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    sets = sets.join(groups.withColumnRenamed("node", "key"), "key", "left")
    least = sets.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    names = sets.where("rows > 1 OR component IS NOT NULL").join(least, "component", "left").select("key", F.coalesce("least", "first").alias("name"))
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(names, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("name", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
