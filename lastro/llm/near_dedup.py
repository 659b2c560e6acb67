"""SimHash near-duplicates found with BK-trees.

Fingerprints within three differing bits agree on at least one of four blocks of bits, so each
distinct fingerprint goes to four shards, one per block and value. Every shard builds a BK-tree
(children keyed by their integer Hamming distance to the parent) and each new fingerprint follows
only the edges within the radius. A shard of more than ``TREE_LIMIT`` fingerprints is cut again by
four blocks of the bits that its members need not share, and so on: no tree grows with the corpus
and no link is lost. Trees grow with the corpus in number, so they are not sent to every task by a
broadcast; a shard's fingerprints are sent by a shuffle to the one task that holds their tree.

Defined results: a null text, and one without words, has fingerprint 0 and is linked like any other;
fewer than three words are one shingle; equal rows have equal results and all stay in the table; an
empty table gives an empty one; a null id never names a component unless all of its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stage, unstage

SHINGLE_WORDS = 3
HASH_SEED = 42
RADIUS = 3
TREE_LIMIT = 512
BITS = (1 << 64) - 1
SLICE = 1 << 16


def simhash(text: bytes | None) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - SHINGLE_WORDS + 1].tolist(), ends[SHINGLE_WORDS - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE):
        hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in zip(starts[at : at + SLICE], ends[at : at + SLICE], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def simhash_column(text: Column) -> Column:
    """The fingerprint's 64 bits as a long."""

    @F.arrow_udf("long")
    def simhashes(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(x) for x in as_bytes(texts)], np.uint64).view(np.int64))

    return simhashes(text)


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


class BKTree:
    """Integers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, item: int, radius: int) -> list[int]:
        """Positions of the items at ``radius`` or nearer."""
        found, todo = [], [0] if self.items else []
        while todo:
            node = todo.pop()
            distance = (item ^ self.items[node]).bit_count()
            if distance <= radius:
                found.append(node)
            below = self.children[node]
            todo.extend(below[k] for k in range(distance - radius, distance + radius + 1) if k in below)
        return found

    def add(self, item: int) -> None:
        node, new = 0, len(self.items)
        self.items.append(item)
        self.children.append({})
        while new:
            distance = (item ^ self.items[node]).bit_count()
            step = self.children[node].setdefault(distance, new)
            if step == new:
                break
            node = step


def shard_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fingerprint, root) for every member linked within the shard to a smaller one; one row a member at most."""
    tree, root = BKTree(), list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for new, item in enumerate(members):
        for old in tree.within(item, radius):
            a, b = find(old), find(new)
            root[max(a, b)] = min(a, b)
        tree.add(item)
    return [(item, members[r]) for at, item in enumerate(members) if (r := find(at)) != at]


def _cut(mask: int) -> list[int]:
    """``mask`` with each quarter of the bits that it lacks; within the radius, two values agree on one quarter at least."""
    free = [b for b in range(64) if not mask >> b & 1]
    ends = [round(len(free) * k / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return [mask | sum(1 << b for b in free[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard. A shard gives its links, or all its rows again (root null) if it is over the limit."""
    shard, held, over, links, again = None, [], False, [], []

    def close() -> None:
        if shard is not None and not over and len(held) > 1:
            links.extend(shard_links(sorted(x & BITS for x in held)))

    def batch() -> pa.RecordBatch:
        rows = [(_signed(a), _signed(b), None) for a, b in links] + again
        links.clear()
        again.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["fingerprint", "root", "mask"])

    for rows in batches:
        mask, key, value = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "key", "fingerprint"))
        cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mask)], strict=True):
            if a == b:
                continue
            if (here := (mask[a], key[a])) != shard:
                close()
                shard, held, over = here, [], False
            held.extend(value[a:b].tolist())
            if over or (len(held) > TREE_LIMIT and 64 - (int(mask[a]) & BITS).bit_count() > TREE_LIMIT.bit_length() - 1):
                over = True
                again.extend((x, None, int(mask[a])) for x in held)
                held = []
            if len(links) + len(again) > 50_000:
                yield batch()
    close()
    yield batch()


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (fingerprint, root) that join all distinct ``prints.fingerprint`` within the radius, staged."""
    level, found = prints.select("fingerprint", F.lit(0).cast("long").alias("mask")), None
    cuts = {0: _cut(0)}
    while True:
        wider = F.create_map(*[F.lit(_signed(x)) if isinstance(x, int) else x for m, c in cuts.items() for x in (m, F.array(*[F.lit(_signed(y)).cast("long") for y in c]))]) if len(cuts) > 1 else None
        masks = F.array(*[F.lit(_signed(y)).cast("long") for y in cuts[0]]) if wider is None else F.element_at(wider, F.col("mask"))
        spread = level.select("fingerprint", F.explode(masks).alias("mask")).withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
        out = stage(spread.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_trees, "fingerprint long, root long, mask long"), "bk-links")
        links = out.where("root is not null").select("fingerprint", "root")
        found = links if found is None else found.unionByName(links)
        level = out.where("root is null").select("fingerprint", "mask")
        if level.isEmpty():
            return found
        level, cuts = level.distinct(), {m: _cut(m) for c in cuts.values() for m in c}


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``links`` (a, b) that has a link.

    Large and small stars in turn, staged each round, until a round changes nothing.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = stage(small.where("a <> b").distinct(), "edges")
        unstage(edges)
        edges = new


def _named(prints: DataFrame, key: str) -> DataFrame:
    """(fingerprint, component_id): the smallest ``key`` of staged ``prints`` reachable from each distinct simhash."""
    first = prints.groupBy(F.col("simhash").alias("fingerprint")).agg(F.min(key).alias("first_id"))
    links = fingerprint_links(first.select("fingerprint"))
    roots = components(links.select(F.col("fingerprint").alias("a"), F.col("root").alias("b")))
    linked = first.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return stage(linked.join(least, "root").select("fingerprint", "component_id"), "components")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, simhash, component_id) for every row: the smallest id reachable over links of three or fewer differing bits."""
    prints = stage(docs.select(F.col(doc_id).alias("doc_id"), simhash_column(F.col(text)).alias("simhash")), "simhash")
    return prints.join(_named(prints, "doc_id"), F.col("simhash") == F.col("fingerprint")).select("doc_id", "simhash", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, null last, then the smallest row number."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")), "near-rows")
    own_id = F.col(f"record.`{doc_id}`")
    key = F.struct(own_id.isNull().alias("no_id"), own_id.alias("id"), "row")
    prints = stage(rows.select(key.alias("key"), simhash_column(F.col(f"record.`{text}`")).alias("simhash")), "simhash")
    kept = _named(prints, "key").select(F.col("component_id.row").alias("row")).distinct()
    return rows.join(kept, "row", "left_semi").select("record.*")
