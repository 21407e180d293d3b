"""Near-duplicate groups by MinHash, banding, verification on full sets and connected components.

Every document gets many minima of universal hashes of its shingles. Documents
that agree on all minima of a band share a bucket. In rounds, each bucket's
members are compared with one of them, its hub, by their signatures: those that
agree on enough minima are linked to it, and those that agree on so many more
that all their own near copies must have been linked too leave the bucket (the
number of minima on which two documents differ obeys the triangle inequality).
What a bucket still holds after the last round, such as documents that share no
more than a passage, is dealt to blocks, whose pairs are units of work that
compare signatures and return at most one link for each document. So nobody's
pairs are listed, unlike documents are kept apart, and no pair is lost but by
6.5 standard deviations of the minima. The connected components of these links are the candidate groups. A
candidate group is verified on full shingle sets: its members are dealt to
classes by size, so that only equal and adjacent classes can hold near copies,
and in a class to blocks of bounded size; every such pair of blocks is one unit
of work that counts exact intersections through the shingles' own posting lists
and returns at most one link for each document. Small groups share a unit. The
components of the verified links are the result, however large a group is.
At similarity 0.85 the default 30 bands of 6 rows miss a pair with probability
7e-7; lower thresholds need other bands (36 of 5 miss 6e-7 at 0.8).

Copies of one word sequence collapse before any of this.

Defined cases: a NULL or empty text has no shingles and is alone; a text of
fewer words than a shingle has its whole word sequence as its only shingle.
Repeated rows fall into one component; a row without id never names a component
unless all its members lack one. Other columns are ignored by
``near_duplicates`` and kept by ``without_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldwater.llm.components import components
from fieldwater.llm.store import bounded_batches, small, spread_join, stored
from fieldwater.llm.words import tokens

SHINGLE = 5
BANDS = 30
ROWS = 6
SEED = 20240229
# One unit of verification holds two blocks at most, each of about so many shingles.
BLOCK_SHINGLES = 1_000_000
REMEMBERED = 100_000
# Rounds in which a bucket's members are compared with a hub, and the share of minima from which a member is done with.
ROUNDS = 2
SETTLED = 0.8
# Members of a bucket in one block of the comparison after the rounds, and rows of small buckets that share a unit.
BLOCK_MEMBERS = 2_000
UNIT_ROWS = 20_000

SIGNED = "doc_id long, digest string, key binary, n_shingles long, bands array<long>, signature binary"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_seen: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` words; of all words when there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    if len(_seen) > REMEMBERED:
        _seen.clear()
    hashes = np.fromiter((_seen.get(w) or _seen.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
    n = len(words) - size + 1
    made = hashes[:n].copy()
    for k in range(1, size):
        made *= _STEP
        made += hashes[k : n + k]
    return np.unique(_mixed(made))


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, dtype=np.uint64)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], part: int = 2048) -> np.ndarray:
    """The smallest value of each hash a*x+b over the set."""
    a, b = family
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), part):
        values = shingles[i : i + part, None] * a
        values += b
        np.minimum(best, values.min(axis=0), out=best)
    return best


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    family = _hash_family(bands * rows)
    powers = _mixed(np.arange(1, rows + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _MIX)
    with np.errstate(over="ignore"):
        for batch in batches:
            keys, sizes, signed, kept = [], [], [], []
            for raw in batch.column(2).to_pylist():
                own = tokens(raw or b"")
                shingles = shingle_set(own, size)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh128_digest(b" ".join(own)) if own else None)
                if own:
                    least = minima(shingles, family)
                    folded = (least.reshape(bands, rows) * powers).sum(axis=1, dtype=np.uint64)
                    signed.append(_mixed(folded ^ salt).view(np.int64))
                    # Two bytes a minimum are enough to tell different ones apart.
                    kept.append(least.astype("<u2").tobytes())
                else:
                    signed.append(np.zeros(0, np.int64))
                    kept.append(None)
            arrays = [
                batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                pa.array(signed, pa.list_(pa.int64())), pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "key", "n_shingles", "bands", "signature"])


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, key, n_shingles, bands, signature) of every row; ``key`` stands for the word sequence, NULL without words."""
    bounded_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(body).alias("digest"), body.cast("binary").alias("raw"))
    return stored(picked.mapInArrow(lambda it: _sign(it, bands, rows, size), SIGNED), "signatures")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (
            np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u2").reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            for name in ("one", "other")
        )
        agree = (left == right).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("key"), pa.array(agree, pa.int64())], ["hub", "key", "agree"])


def agreement(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(hub, key, agree): on how many minima the two agree. ``known`` holds the signature of every key."""
    own = pairs.join(known.withColumnRenamed("signature", "other"), "key")
    both = spread_join(own, known.select(F.col("key").alias("hub"), F.col("signature").alias("one")), "hub")
    return both.select("hub", "key", "one", "other").mapInArrow(_agreeing, "hub binary, key binary, agree long")


def signature_bounds(count: int, percent: int) -> tuple[int, int, int]:
    """(linked, settled, alike): the minima on which two must agree to be linked by a hub, to be done with, and to be linked directly.

    Documents of similarity ``percent`` differ on more minima than lie between
    the first two, or agree on fewer than the last, with a probability of some 1e-9.
    """
    miss = 1 - percent / 100
    apart = math.ceil(count * miss + 6.5 * math.sqrt(count * miss * (1 - miss)))
    settled = math.ceil(SETTLED * count)
    return max(1, settled - apart), settled, max(1, count - apart)


def _alike(table: pa.Table, least: int) -> pa.Table:
    """Links of one unit: rows (bucket, key, side, signature) of a block, of two blocks, or of several whole buckets."""
    keys, side = table.column("key").to_pylist(), table.column("side").to_numpy()
    bucket = table.column("bucket").to_numpy()
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(keys), -1)
    order = np.argsort(bucket, kind="stable")
    links: list[tuple[int, int]] = []
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        first, second = (rows[side[rows] == end] for end in (side[rows].min(), side[rows].max()))
        same = side[rows].min() == side[rows].max()
        parent = {int(k): int(k) for k in rows}

        def root(k: int, parent=parent) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for at, x in enumerate(first):
            others = second[at + 1 :] if same else second
            for y in others[(signature[others] == signature[x]).sum(axis=1) >= least]:
                if (p := root(int(x))) != (q := root(int(y))):
                    parent[p] = q
                    links.append((int(x), int(y)))
    return pa.table({"a": pa.array([keys[x] for x, _ in links], pa.binary()), "b": pa.array([keys[y] for _, y in links], pa.binary())})


def remaining_links(left: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Links (a, b) that connect all members of a bucket whose signatures agree on ``least`` minima; ``left`` holds (key, bucket)."""
    sized = left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"), F.count("*").alias("n"))
    placed = stored(spread_join(left, sized.filter("n > 1").drop("n"), "bucket"), "remaining")
    units = max(1, math.ceil(placed.filter("blocks = 1").count() / UNIT_ROWS))
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    met = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.when(
        F.col("blocks") > 1, F.struct("bucket", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"))
    ).otherwise(F.struct(F.lit(None).cast("long").alias("bucket"), F.pmod(F.xxhash64("bucket"), F.lit(units)).cast("int").alias("i"), F.lit(0).alias("j")))
    dealt = met.select("bucket", "key", (F.col("block") > F.col("other")).cast("int").alias("side"), unit.alias("unit"))
    return dealt.join(known, "key").groupBy("unit").applyInArrow(lambda t: _alike(t, least), "a binary, b binary")


def candidate_links(placed: DataFrame, known: DataFrame, count: int, percent: int) -> DataFrame:
    """Links (a, b) between word sequences of a bucket, confirmed by signature; ``placed`` holds (key, bucket)."""
    linked, settled, alike = signature_bounds(count, percent)
    links, left = [], placed
    for _ in range(ROUNDS):
        hubs = left.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
        met = stored(left.join(hubs, "bucket").filter("hub <> key"), "met")
        agreed = stored(agreement(stored(met.select("hub", "key").distinct(), "pairs"), known), "agreed")
        links.append(agreed.filter(F.col("agree") >= linked).select(F.col("hub").alias("a"), F.col("key").alias("b")))
        done = agreed.filter(F.col("agree") >= settled).select("hub", "key")
        left = stored(met.join(done, ["hub", "key"], "left_anti").select("key", "bucket"), "left")
        if left.isEmpty():
            break
    else:
        links.append(stored(remaining_links(left, known, alike), "remaining-links"))
    return reduce(DataFrame.unionByName, links).distinct()


def candidate_groups(signed: DataFrame, owners: DataFrame, count: int, percent: int) -> DataFrame:
    """(node, component) of the word sequences that share a bucket and enough of their signatures with another."""
    ours = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("rep_digest")) & (signed["key"] == F.col("_key"))
    firsts = signed.join(owners.select(F.col("key").alias("_key"), "rep", "rep_digest"), ours).dropDuplicates(["key"])
    firsts = stored(firsts.select("key", "bands", "signature"), "firsts")
    placed = stored(firsts.select("key", F.explode("bands").alias("bucket")), "buckets")
    return components(candidate_links(placed, firsts.select("key", "signature"), count, percent))


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets at ``left`` and at ``right`` whose similarity is at least ``percent`` hundredths.

    At most one link for each newly joined pair of groups is returned. Pairs of
    ``left`` with itself are taken once when both sides are the same.
    """
    size = np.array([len(s) for s in sets])
    same = len(left) == len(right) and (left == right).all()
    # Posting lists of the right side: documents by shingle.
    owner = np.repeat(right, size[right])
    flat = np.concatenate([sets[k] for k in right]) if len(right) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    kinds, start, count = np.unique(flat, return_index=True, return_counts=True)
    parent = list(range(len(sets)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    for x in left:
        own = sets[x]
        at = np.searchsorted(kinds, own)
        at = at[(at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == own)] if len(kinds) else at[:0]
        if same:
            at = at[count[at] > 1]
        lengths = count[at]
        if not lengths.sum():
            continue
        # Members of all its posting lists, one list after another.
        steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shared = np.bincount(owner[np.repeat(start[at], lengths) + steps], minlength=len(sets))
        alike = np.flatnonzero(100 * shared >= percent * (size + size[x] - shared))
        for y in alike:
            if y != x and shared[y] and (a := root(int(x))) != (b := root(int(y))):
                parent[a] = b
                links.append((int(x), int(y)))
    return links


def _verify(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Links of one unit: rows (key, block, raw) of one side, or of two sides that are compared with each other."""
    keys, blocks, sets, seen = [], [], [], set()
    for key, block, raw in zip(*(table.column(c).to_pylist() for c in ("key", "block", "raw")), strict=True):
        own = tokens(raw)
        if key not in seen and xxhash.xxh128_digest(b" ".join(own)) == key:
            seen.add(key)
            keys.append(key)
            blocks.append(block)
            with np.errstate(over="ignore"):
                sets.append(shingle_set(own, size))
    where = np.array(blocks, np.int64)
    first = np.flatnonzero(where == where.min()) if len(where) else where
    second = np.flatnonzero(where == where.max()) if len(where) else where
    links = exact_links(sets, first, second, percent)
    return pa.table({"a": pa.array([keys[x] for x, _ in links], pa.binary()), "b": pa.array([keys[y] for _, y in links], pa.binary())})


def verified_links(docs: DataFrame, owners: DataFrame, groups: DataFrame, percent: int, size: int, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between word sequences of a candidate group, confirmed on full sets."""
    members = stored(
        groups.select("node", "component").unionByName(groups.select(F.col("component").alias("node"), "component")).distinct()
        .join(owners, F.col("node") == F.col("key")).select("key", "rep", "rep_digest", "n_shingles", "component"),
        "members",
    )
    # Sets as alike as that differ in size by less than a class.
    width = math.log(100 / percent) * 1.001 if percent < 100 else 1e-9
    members = members.withColumn("class", F.floor(F.log("n_shingles") / width))
    weights = stored(members.groupBy("component", "class").agg(F.sum("n_shingles").alias("weight")), "weights")
    total = weights.agg(F.sum("weight")).first()[0] or 0
    units = max(1, math.ceil(total / BLOCK_SHINGLES))
    whole, line = W.partitionBy("component"), W.partitionBy("component").orderBy("class")
    beside = lambda step: F.when(step("class").over(line) == F.col("class") + (1 if step is F.lead else -1), step("blocks").over(line))
    split = weights.select(
        "component", "class", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int").alias("blocks"), (F.sum("weight").over(whole) > BLOCK_SHINGLES).alias("large")
    ).withColumns({"below": F.coalesce(beside(F.lag), F.lit(0)), "above": F.coalesce(beside(F.lead), F.lit(0))})
    # A group of one block shares its unit with others; in a larger one the blocks of a class meet each other and those of the next class.
    placed = members.join(split, ["component", "class"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    def meetings(count, made):
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), made)

    def unit(low, high, i, j, side):
        return F.struct(
            F.col("component").alias("component"), low.alias("low"), high.alias("high"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side")
        )

    own, one = F.col("class"), F.lit(1).cast("long")
    block = F.col("block")
    units_of = F.when(
        F.col("large"),
        F.concat(
            meetings("blocks", lambda k: unit(own, own, F.least(block, k), F.greatest(block, k), F.when(block > k, 1).otherwise(0))),
            meetings("above", lambda k: unit(own, own + one, block, k, F.lit(0))),
            meetings("below", lambda k: unit(own - one, own, k, block, F.lit(1))),
        ),
    ).otherwise(F.array(F.struct(
        F.lit(None).cast("binary").alias("component"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"),
        F.pmod(F.xxhash64("component"), F.lit(units)).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"),
    )))
    dealt = stored(
        placed.withColumn("_unit", F.explode(units_of))
        .select("key", "rep", "rep_digest", F.col("_unit.side").alias("block"), F.struct(*[F.col(f"_unit.{c}") for c in ("component", "low", "high", "i", "j")]).alias("unit")),
        "dealt",
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    on = F.col("_id").eqNullSafe(F.col("rep")) & (F.md5("_text") == F.col("rep_digest"))
    rows = texts.join(small(dealt), on).select("key", "block", F.col("_text").cast("binary").alias("raw"), "unit")
    return rows.groupBy("unit").applyInArrow(lambda t: _verify(t, size, percent), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, percent: int = 85, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept) for every row; documents are linked from ``percent`` hundredths on."""
    signed = signatures(docs, bands, rows, size, doc_id, text)
    # One owner for each word sequence: its smallest id, and that row's text.
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n_shingles"))
    owners = stored(
        signed.filter("key is not null").groupBy("key").agg(owner.alias("o"), F.count("*").alias("copies"))
        .select("key", F.col("o.doc_id").alias("rep"), F.col("o.digest").alias("rep_digest"), F.col("o.n_shingles").alias("n_shingles"), "copies"),
        "owners",
    )
    groups = candidate_groups(signed, owners, bands * rows, percent)
    links = stored(verified_links(docs, owners, groups, percent, size, doc_id, text), "links")
    found = components(links)
    named = owners.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    # Most sequences are alone; only the others are looked up.
    linked = found.select(F.col("component").alias("k")).unionByName(found.select(F.col("node").alias("k"))).distinct()
    touched = named.join(linked, F.col("key") == F.col("k"), "left").filter(F.col("k").isNotNull() | (F.col("copies") > 1))
    changed = stored(touched.join(least, "component").select(F.col("key").alias("_key"), "component_id"), "changed")
    joined = signed.join(small(changed), F.col("key") == F.col("_key"), "left")
    own = F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "digest", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_copies(
    docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each group, with all its columns."""
    dropped = near_duplicates(docs, percent, bands=bands, rows=rows, doc_id=doc_id, text=text).filter("not kept")
    dropped = stored(dropped.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "dropped")
    on = docs[doc_id].eqNullSafe(F.col("_id")) & (F.md5(F.coalesce(docs[text], F.lit(""))) == F.col("_digest"))
    return docs.join(small(dropped), on, "left_anti")
