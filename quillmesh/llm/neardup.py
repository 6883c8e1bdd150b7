"""Near-duplicates by b-bit MinHash: band candidates, packed signatures, exact confirmation.

1. Sign (one pass over the texts, map only). The distinct shingles of a text are hashed to 64 bits;
   160 minima give 32 band keys of 5 minima each, and 2 low bits of each (mixed) minimum are packed
   into 5 longs. A pair at similarity 0.8 misses every band with probability 3e-6.
2. Texts with the same shingle set collapse to their smallest id; all later steps see only these.
3. In each bucket (band, key) every member is paired with the bucket's smallest id: pairs grow
   with the rows, not with the square of a group. Equal low bits, counted with bit_count and
   corrected for chance collisions (1/4), estimate the similarity; pairs under ``FLOOR`` (over six
   standard deviations below the threshold) are dropped. The rest are confirmed on full sets.
4. Components of the confirmed links, by contraction to the smallest neighbour (the number of
   nodes at least halves each round).
5. Buckets of three or more in which several components are left: members were compared with the
   smallest id only. Each such bucket names its largest component; its other members become
   *visitors* of that component. Each component's shingle sets are dealt by size class (classes a
   quarter apart, so similar sets are of the same or of neighbouring ones) into blocks of bounded
   size; its visitors, in rooms of their own, meet every block of the three classes and are compared
   with all sets there, other visitors included. A pair of block and room returns only the links it
   finds. So no link in a bucket is lost, and no pairs are emitted.
6. Components again, over all links.

Edge cases. Null text, empty text or white space only: no shingles, linked with nothing, even if
equal. Fewer words than a shingle has: the whole sequence is one shingle. Null doc_id: never
linked, component null, kept. Repeated rows with one doc_id: both rows are returned alike; with
different texts: they are one document that has the links of each. Very long texts: whole, minima in
slices. Ties: the smallest id is a bucket's centre and a component's name. Empty table: no rows.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, map_arrow, release, remembered

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Estimates below this are not confirmed.
FLOOR = 0.55
#: Shingles of a block of members, and of a room of the visitors that are compared with it.
BLOCK_SHINGLES, ROOM_SHINGLES = 50_000, 400_000
REMEMBER = 200_000

_MULTIPLIERS = (np.random.default_rng(20_240_607).integers(0, 2**31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_OFFSETS = np.random.default_rng(77_003).integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """64-bit hash by word; frequent words are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBER and len(word) <= 40:
            self[word] = value
        return value


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(remembered("near-duplicates", _WordHash).__getitem__, found), np.uint64, len(found))
    if len(h) < size:
        h = np.concatenate([h, np.full(size - len(h), 0x5BD1E995, np.uint64)])
    n = len(h) - size + 1
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[i : i + n]
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        best = np.minimum(best, (x[i : i + 2048, None] * _MULTIPLIERS + _OFFSETS).min(axis=0))
    return best


def signature(best: np.ndarray) -> tuple[list[int], list[int]]:
    """Band keys, and two low bits of each mixed minimum packed 32 to a long."""
    with np.errstate(over="ignore"):
        rows = best.reshape(BANDS, ROWS).astype(np.uint64)
        keys = np.zeros(BANDS, np.uint64)
        for i in range(ROWS):
            keys = (keys ^ (keys >> np.uint64(31))) * _MIX + rows[:, i] + np.uint64(1)
        mixed = (best * np.uint32(2654435761)) >> np.uint32(30)
    bits = mixed.astype(np.uint64).reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return keys.view(np.int64).tolist(), np.bitwise_or.reduce(bits, axis=1).view(np.int64).tolist()


SIGNED = "doc_id long, n_shingles long, digest binary, bits array<long>, bands array<long>"


def sign(docs: DataFrame, size: int = 2) -> DataFrame:
    """One row per document: set size, digest of the set, packed bits and band keys (null if the set is empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                counts, digests, bits, bands = [], [], [], []
                for text in part.column(1):
                    found = shingles(text.as_py(), size)
                    counts.append(len(found))
                    if len(found):
                        keys, packed = signature(minima(found))
                        digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    else:
                        keys = packed = None
                        digests.append(None)
                    bits.append(packed)
                    bands.append(keys)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, f.type) for v, f in zip((counts, digests, bits, bands), list(schema)[1:], strict=True)]], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SIGNED)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed bits: the share of equal pairs of bits, less what chance makes equal."""
    even = F.lit(0x5555555555555555).cast("long")
    unequal = None
    for i in range(HASHES // 32):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        n = F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(even))
        unequal = n if unequal is None else unequal + n
    return (1 - unequal / F.lit(float(HASHES)) - 0.25) / 0.75


def components(links: DataFrame) -> DataFrame:
    """a, b -> id, component (the smallest id that links lead to), for every id in a link."""
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while True:
        both = edges.select(F.col("b").alias("id"), F.col("a").alias("parent")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("parent")))
        direct = parents = cut(both.groupBy("id").agg(F.min("parent").alias("parent")))
        # Two jumps up the chain of parents.
        for _ in range(2):
            up = parents.toDF("parent", "above")
            parents = parents.join(up, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"))
        parents = cut(parents)
        before = labels, edges
        labels = cut(parents.toDF("id", "component") if labels is None else labels.join(parents.toDF("component", "parent"), "component", "left").select("id", F.coalesce("parent", "component").alias("component")))
        one = parents.toDF("a", "pa")
        two = parents.toDF("b", "pb")
        edges = cut(edges.join(one, "a").join(two, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct())
        release(parents, direct, *before)
        if edges.isEmpty():
            release(edges)
            return labels


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b -> those whose full sets are similar enough. texts: id, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            ids, others = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, (a, b) in enumerate(zip(ids, others, strict=True)):
                if last[0] != a:
                    last = a, shingles(batch.column(2)[i].as_py(), size)
                if _similar(last[1], shingles(batch.column(3)[i].as_py(), size), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    joined = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return map_arrow(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column of sets one after another, and the sets' sizes."""
    column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), np.diff(offsets)


def _visit(percent: int):
    """Compare a block's members with a room of the component's visitors, and the visitors there with each other."""

    def run(key, members: pa.Table, visitors: pa.Table) -> pa.Table:
        if not members.num_rows or not visitors.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        seats = members.column("id").to_pylist()
        # Shared shingles are counted through an index of the block (all shingles sorted, beside their
        # owners), so that dissimilar texts cost nothing.
        values, lengths = _sets(members.column("set"))
        order = np.argsort(values, kind="stable")
        values, owners = values[order], np.repeat(np.arange(len(seats), dtype=np.int32), lengths)[order]
        # Members are of one component already; only links that join two groups are returned.
        home = [None if m else i for i, m in zip(seats, members.column("member").to_pylist(), strict=True)]
        group: dict[int | None, int | None] = {}

        def top(x: int | None) -> int | None:
            while (y := group.get(x, x)) != x:
                group[x] = group.get(y, y)
                x = y
            return x

        found: list[tuple[int, int]] = []
        shingles_of, sizes = _sets(visitors.column("v_set"))
        ends = np.cumsum(sizes)
        for i, end, n in sorted(zip(visitors.column("v_id").to_pylist(), ends.tolist(), sizes.tolist(), strict=True)):
            s = shingles_of[end - n : end]
            first = np.searchsorted(values, s, "left")
            times = np.searchsorted(values, s, "right") - first
            upto = np.cumsum(times)
            hits = np.repeat(first - (upto - times), times) + np.arange(upto[-1])
            both = np.bincount(owners[hits], minlength=len(seats))
            for g in np.flatnonzero((both > 0) & (100 * both >= percent * (n + lengths - both))).tolist():
                one, two = top(i), top(home[g])
                if one != two:
                    group[one] = two
                    found.append((i, seats[g]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; see the module's head."""
    signed = cut(sign(docs, size))
    filled = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    leads = cut(filled.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    cells = leads.select("id", F.posexplode("bands").alias("band", "key"))
    # Written, so that the join reads two plain exchanges, of which adaptive execution can split a hot bucket's.
    buckets = cut(cells.groupBy("band", "key").agg(F.min("id").alias("centre"), F.count("*").alias("members")).filter("members > 1"))
    shared = cut(cells.join(buckets, ["band", "key"]).select("band", "key", "id", "centre", "members"))
    bits = leads.select("id", "bits")
    star = shared.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b").filter(estimate(F.col("bits_a"), F.col("bits_b")) >= FLOOR).select("a", "b")
    star = cut(star)
    wanted = star.select(F.col("a").alias("id")).union(star.select("b")).union(shared.filter("members > 2").select("id")).distinct()
    candidates = cut(texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    links = cut(confirm(star, candidates, size, percent))
    found = components(links)

    # Buckets with several components: all members against the largest component's.
    placed = shared.filter("members > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    largest = cut(per.groupBy("band", "key").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("top"), F.count("*").alias("several")).filter("several > 1").select("band", "key", (-F.col("top.c")).alias("home")))
    crowd = cut(placed.join(largest, ["band", "key"]).select("home", "id", (F.col("component") == F.col("home")).alias("member")).groupBy("home", "id").agg(F.max("member").alias("member")))
    if not crowd.isEmpty():
        more = _visits(crowd, candidates, size, percent)
        links = cut(links.union(more))
        found = components(links)

    same = filled.select("doc_id", "digest", "n_shingles").join(leads.select("digest", "n_shingles", "id"), ["digest", "n_shingles"]).select("doc_id", "id")
    owner = same.join(found, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(owner, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _visits(crowd: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the visitors of a component, its members and one another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingles(t.as_py(), size).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "n", "set"])

    sets = cut(map_arrow(texts.join(crowd.select("id").distinct(), "id", "left_semi").select("id", "text"), run, "id long, n long, set array<long>"))
    # Sets of which one is more than 100 / percent times the other's size can't be similar.
    sized = crowd.join(sets.select("id", "n"), "id").withColumn("class", F.floor(F.log("n") / math.log(100 / percent)).cast("int"))
    many = lambda n, most: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(n), F.lit(0)) / most)).cast("int")
    homes = cut(sized.groupBy("home", "class").agg(many(F.col("n"), BLOCK_SHINGLES).alias("blocks"), F.sum(F.when(~F.col("member"), F.col("n"))).alias("visiting")))
    # A class of a component is met by its own visitors and those of the classes beside it.
    near = homes.filter("visiting > 0").select("home", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"), "visiting").groupBy("home", "class").agg(many(F.col("visiting"), ROOM_SHINGLES).alias("rooms"))
    cells = cut(homes.join(near, ["home", "class"]).select("home", "class", "blocks", "rooms"))
    seated = sized.join(cells, ["home", "class"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Everyone is in one block, which every room of visitors meets.
    seated = seated.withColumn("room", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1))).select("home", "class", "block", "room", "id", "member").join(sets.select("id", "set"), "id")
    roaming = sized.filter(~F.col("member")).select("home", "id", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class")).join(cells, ["home", "class"])
    roaming = roaming.withColumn("room", F.pmod(F.xxhash64("id", F.lit(1)), F.col("rooms")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Columns of their own names and ids: both sides come from one table.
    roaming = roaming.select("home", "class", "block", "room", "id").join(sets.select("id", "set"), "id").select(*[F.col(c).alias(f"v_{c}") for c in ("home", "class", "block", "room", "id", "set")])
    keys = ["home", "class", "block", "room"]
    return seated.groupBy(*keys).cogroup(roaming.groupBy(*[f"v_{k}" for k in keys])).applyInArrow(_visit(percent), "a long, b long")
