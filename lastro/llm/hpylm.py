"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling in Spark tasks.

Tokens are lower-cased words and one end a text (the empty word). A context restaurant serves the words
that follow one preceding word, or the start of a text. Every word that is learned has one, whatever it costs
(``CONTEXT_TOKENS`` is 1; with more, what follows a rarer word is a customer of the root). All context
restaurants share the root as their parent; its base is uniform over the V known tokens and one unknown. The
seating is kept as table counts. A sweep draws each (context, word) cell's table
count from its conditional given the rest, by generalised Stirling numbers, then the root's, whose
customers are the contexts' tables. A word's cells and its root dish lie in one task, so a sweep needs no
shuffle: only the restaurants' totals couple the words, and they are summed between two jobs. A cell met
once sits at one table, whatever the draws, so only its number goes to the sampler. Beyond the first
``EXACT`` customers of a cell, arrivals are seated in blocks of a sixteenth of those seated, with one
probability a block. Draws are hashes of word, context and sweep, so the number of tasks, their order and a task
run again change none. Predictive probabilities average ``SAMPLES`` sweeps and add up to one in each context.

Words go by their 64-bit hash, and so do word pairs when a text is scored. Each task counts its pairs before they are
shuffled, in packed columns by ranges of the word. A text's score is a sum over its words, of the root's probability and
of the context's share for it, and over its pairs, of what the pair's own customers add to these.

Of the cells met once only those are written that a score may ask for: a held-out text may hold any, and a learned
one is joined to those with a word whose values aren't at hand. At hand are the broadcast words, and words met once, which all
have the same values; marks tell these from rarer words met again. Any other pair of a learned text that isn't written was
met once, and its share follows from the values of its words. The model itself is drawn from cells met more often.

Values of the most frequent words and pairs, ``KNOWN_WORDS`` and ``KNOWN_PAIRS`` or fewer, are broadcast;
all others of a text are joined to the model. Which are broadcast changes the cost, never a score: a word
beyond them is taken for a context until the join with the counts tells.

Defined results: a null text counts as empty (its end is its only token); a null id counts as the empty
text in the folds; words never learned get the unknown's share; repeated rows each keep their own row; with
nothing to learn from, N and V are 0 and every token has probability one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stage, unstage

END = b""
STRENGTH = 1.0
#: A word met so often in the texts learned from has a context restaurant: with 1 every word.
CONTEXT_TOKENS = 1
EXACT = 256
MANY = 9
BURN_IN = 3
SAMPLES = 4
SEED = 1789
KNOWN_WORDS = 1 << 19
#: Of them, those that Spark's own joins broadcast: the driver builds these tables in its heap.
SENT_WORDS = 1 << 17
KNOWN_PAIRS = 1 << 21
#: The logarithm of the most bits that tell kept pairs, and of those that tell words met again.
MARKS = 27
WORD_MARKS = 27
#: Slices of the keys that are joined to the texts one after the other, a power of two.
SLICES = 2
#: Bytes of text of a task whose words or pairs are counted together, bytes of text scored together, and rows seated together, about.
HELD_BYTES = 16_000_000
TOGETHER = 1 << 22
HELD_ROWS = 400_000
BATCH = 1 << 16


def word_key(word: bytes) -> int:
    x = xxhash.xxh64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


#: The context at the start of a text; no word holds a blank.
START = word_key(b" ")


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, by: v << np.uint64(by) | v >> np.uint64(64 - by)
    h = seed + (p5 + np.uint64(8)) ^ turn(x.view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """As Spark's xxhash64 of the two longs."""
    return _hash_long(words, _hash_long(contexts, np.uint64(42))).view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, about ``most`` bytes of text at a time; texts are in the first column."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(batch.num_rows, int(np.searchsorted(ends, before + most - size)) + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held.clear()
    pa.default_memory_pool().release_unused()


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words met; the number of each token among them and that of the token before it; tokens of each text. 0 is the start of a text, 1 its end.

    Arrow folds and cuts as ``bytes.lower`` and ``bytes.split`` do, but for empty words at blanks on the edges.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    numbers, owner = coded.indices.to_numpy() + np.int32(2), np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    if END in words:
        real = numbers != words.index(END) + 2
        numbers, owner = numbers[real], owner[real]
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    after, before = np.ones(int(sizes.sum()), np.int32), np.zeros(int(sizes.sum()), np.int32)
    at = np.arange(len(numbers)) + owner
    after[at], before[at + 1] = numbers, numbers
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    return np.concatenate((np.array([START, word_key(END)]), keys)), after, before, sizes


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches, HELD_BYTES):
        keys, words, _, _ = _tokens(piece.column(0))
        counts = np.bincount(words, minlength=len(keys))
        met = np.flatnonzero(counts)
        yield from _flat([pa.array(keys[met]), pa.array(counts[met].astype(np.int64))], ["w", "n"])


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, the first of them sorted and kept as differences, byte by byte."""
    planes = [np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T for x in (np.diff(columns[0], prepend=np.int64(0)), *columns[1:])]
    return len(columns[0]).to_bytes(8, "little") + pa.compress(np.concatenate(planes).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of all, one after the other."""
    parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(columns)]
    for data in packed:
        n = int.from_bytes(data[:8], "little")
        raw = np.frombuffer(pa.decompress(data[8:], n * 8 * columns, "zstd"), np.uint8).reshape(columns, 8, n)
        for k in range(columns):
            column = np.ascontiguousarray(raw[k].T).view(np.int64)[:, 0]
            parts[k].append(column if k else column.cumsum())
    return [np.concatenate(x) for x in parts]


def _pair_counts_udf(known, shards: int):
    """(shard, pairs, others): counted pairs of texts and whether each is learned, by ranges of the word; pairs: of broadcast words, by their numbers."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = known.value
        for piece in _pieces(batches, HELD_BYTES):
            keys, w, u, sizes = _tokens(piece.column(0))
            learned = np.repeat(piece.column(1).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            places, near, taken = kind.table.find(keys), kind.near(keys), kind.of(keys)[u]
            at_hand = places > 0
            as_context = at_hand.copy()
            as_context[0] = True
            both = taken & at_hand[w] & as_context[u]
            pairs, counts = np.unique((places[w[both]] << kind.bits | places[u[both]]) << 1 | learned[both], return_counts=True)
            cuts = np.searchsorted(pairs, (np.arange(shards + 1) * len(kind.table.keys) // shards + 1) << kind.bits + 1)
            rest = taken & ~both
            others, met = np.unique((w[rest].astype(np.int64) << 32 | u[rest]) << 1 | learned[rest], return_counts=True)
            w, u, of_learned = others >> 33, others >> 1 & 0xFFFFFFFF, others & 1
            met = met * of_learned << 1 | (of_learned == 0) | ~(near[w] & near[u])
            w, u = keys[w], keys[u]
            order = np.argsort(w)
            w, u, met = w[order], u[order], met[order]
            ends = np.searchsorted((w >> 32) + (1 << 31), np.arange(shards + 1) * (1 << 32) // shards)
            full = [k for k in range(shards) if cuts[k] < cuts[k + 1] or ends[k] < ends[k + 1]]
            packed = [_packed(pairs[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]) for k in full], [_packed(*(x[ends[k] : ends[k + 1]] for x in (w, u, met))) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["shard", "pairs", "others"])

    return job


def _cells_udf(known, every: bool):
    """(w, u, c) of a shard's pairs; c: how often learned texts hold the pair. Pairs met once only where a score may ask for them, or ``every`` one."""

    def job(rows: pa.Table) -> pa.Table:
        kind = known.value
        pairs, counts = _unpacked(rows.column("pairs").to_pylist(), 2)
        w, u, met = _unpacked(rows.column("others").to_pylist(), 3)
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
        learned, pairs = pairs & 1, pairs >> 1
        names = np.concatenate((np.array([START]), kind.table.keys))
        sums = [_summed([pairs], counts * learned, learned == 0, every)]
        order = np.lexsort((u, w))
        sums.append(_summed([w[order], u[order]], met[order] >> 1, met[order] & 1 == 1, every))
        ((pairs,), c), ((w, u), more) = sums
        columns = (names[pairs >> kind.bits], w), (names[pairs & (1 << kind.bits) - 1], u), (c, more)
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in columns], names=["w", "u", "c"])

    return job


def _summed(keys: list[np.ndarray], counts: np.ndarray, asked: np.ndarray, every: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted keys with their summed counts, without those not wanted."""
    if not len(counts):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in keys]))))
    counts, asked = np.add.reduceat(counts, first), np.logical_or.reduceat(asked, first)
    wanted = counts > 0 if every else (counts > 1) | (counts == 1) & asked
    return [x[first[wanted]] for x in keys], counts[wanted]


class Contexts:
    """Which words are contexts: those of the broadcast words that are, and perhaps any other."""

    def __init__(self, known: pa.Table, texts: int, others: bool, again: Marks) -> None:
        """``known``: (w, n); ``others``: whether a word beyond them may be a context; ``again``: of the words beyond them that were met more than once."""
        self.others, self.again = others, again
        self.table, self.least = Table(known, "w", {"n": float("inf") if others else 0.0}), CONTEXT_TOKENS
        self.start = texts >= self.least
        #: Of a broadcast word's number.
        self.bits = max(1, len(self.table.keys).bit_length())

    def of(self, keys: np.ndarray) -> np.ndarray:
        found = self.table.values["n"][self.table.find(keys)] >= self.least
        found[keys == START] = self.start
        return found

    def once(self, keys: np.ndarray) -> np.ndarray:
        """Which keys, if learned, are surely words met once: all of these have the same values."""
        return (self.table.find(keys) == 0) & (keys != START) & ~self.again.of(keys)

    def near(self, keys: np.ndarray) -> np.ndarray:
        """Which learned keys have values that are at hand when a text is scored: broadcast words, the start of a text, words met once."""
        return (self.table.find(keys) > 0) | (keys == START) | ~self.again.of(keys)


@cache
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for 1 <= t <= c <= EXACT."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[1, 1] = 0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        table[c + 1, t] = table[c, t] + np.log(c - discount * t)
        table[c + 1, t + 1] = np.logaddexp(table[c + 1, t + 1], table[c, t])
    return table


def uniforms(keys: np.ndarray, sweep: int) -> np.ndarray:
    """A number below one for each cell's key in a sweep, the same wherever and in whatever order cells are drawn."""
    return (_hash_long(keys, np.uint64(SEED + sweep)) >> np.uint64(11)) * 2.0**-53


def binomials(n: np.ndarray, share: np.ndarray, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Binomial draws by the inverse of their distribution; those with a mean over ``MANY`` by the normal one of that mean and variance."""
    u, mean = uniforms(keys, sweep), n * share
    out = np.zeros(len(n), np.int64)
    few, many = np.flatnonzero(mean <= MANY), np.flatnonzero(mean > MANY)
    if len(few):
        odds = np.minimum(share[few], 1 - 1e-12)
        # how much rarer one success more is, up to numbers that are met less than once in 10^12 draws
        largest = mean[few].max()
        successes = np.arange(1, 2 + int(min(n[few].max(), largest + 8 * largest**0.5 + 8)))
        rarer = (n[few, None] - successes + 1) / successes * (odds / (1 - odds))[:, None]
        chances = np.cumprod(np.concatenate((np.exp(n[few] * np.log1p(-odds))[:, None], np.maximum(rarer, 0)), axis=1), axis=1)
        out[few] = np.minimum((u[few, None] >= chances.cumsum(1)).sum(1), n[few])
    if len(many):
        angle = uniforms(keys[many], sweep + (1 << 40)) * (2 * np.pi)
        normal = np.sqrt(-2 * np.log(1 - u[many])) * np.cos(angle)
        out[many] = np.rint(np.clip(mean[many] + np.sqrt(mean[many] * (1 - share[many])) * normal, 0, n[many]))
    return out


def draw_tables(customers: np.ndarray, opening: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """A table count for each cell; ``opening``: (strength + discount x tables of the restaurant) x the parent's probability.

    Draws hang on the cell's key and the sweep alone.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    first, log_s = np.minimum(customers, EXACT).astype(np.int16), stirling(round(discount, 6))
    # two customers share a table or not
    two = np.flatnonzero(first == 2)
    share = 1 - discount
    tables[two] += share < uniforms(keys[two], sweep) * (share + opening[two])
    order = np.flatnonzero(first > 2)
    order = order[np.argsort(first[order], kind="stable")]
    at = 0
    while at < len(order):
        many = order[at : at + 2048]
        widest = int(first[many[-1]])
        weights = log_s[first[many], 1 : widest + 1] + np.arange(1, widest + 1) * np.log(opening[many])[:, None]
        weights = np.exp(weights - weights.max(1, keepdims=True)).cumsum(1)
        tables[many] = 1 + (weights < uniforms(keys[many], sweep)[:, None] * weights[:, -1:]).sum(1)
        at += len(many)
    large = np.flatnonzero(customers > EXACT)
    seated, step = np.full(len(large), EXACT, np.int64), 0
    while len(large):
        step += 1
        block = np.minimum(customers[large] - seated, seated // 16)
        share = opening[large] / (seated - discount * tables[large] + opening[large])
        tables[large] += binomials(block, share, keys[large], sweep + 4096 * step)
        seated += block
        more = seated < customers[large]
        large, seated = large[more], seated[more]
    return np.minimum(tables, customers)


class Seating:
    """Table counts of the cells of some words, sorted by word, given the restaurants' totals.

    A row without a context holds the number of a word's cells that were met once.
    """

    def __init__(self, rows: pa.Table, totals: dict, first_sweep: int = 0) -> None:
        w, customers, tables = (rows.column(c).to_numpy() for c in ("w", "c", "tables"))
        first = np.concatenate(([True], w[1:] != w[:-1]))
        index, cell = np.cumsum(first) - 1, rows.column("u").is_valid().to_numpy()
        self.names, self.rows = w[first], int(first.sum())
        self.words, self.customers, self.context_tables = index[cell], customers[cell], tables[cell]
        self.w, self.u = w[cell], rows.column("u").drop_null().to_numpy()
        self.alone = np.bincount(index[~cell], customers[~cell], self.rows).astype(np.int64)
        self.totals, self.swept = totals, first_sweep
        self.cell_keys, self.root_keys = pair_keys(self.u, self.w), pair_keys(np.full(self.rows, START), self.names)
        self.tables = np.ones(len(self.words), np.int64)
        self.root_customers = self.alone + np.bincount(self.words, minlength=self.rows)
        self.root_tables = np.ones(self.rows, np.int64)

    def sweep(self) -> None:
        t = self.totals
        self.swept += 1
        base = (STRENGTH + t["d0"] * t["root_tables"]) * t["base"]
        parent = (self.root_customers - t["d0"] * self.root_tables + base) / (STRENGTH + t["root_customers"])
        opening = (STRENGTH + t["d1"] * self.context_tables) * parent[self.words]
        self.tables = draw_tables(self.customers, opening, t["d1"], self.cell_keys, self.swept)
        self.root_customers = self.alone + np.bincount(self.words, self.tables, self.rows).astype(np.int64)
        self.root_tables = draw_tables(self.root_customers, np.full(self.rows, base), t["d0"], self.root_keys, -self.swept)


def _whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``HELD_ROWS`` of the rows, which come sorted by word; no word is cut."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= HELD_ROWS:
            w = batch.column("w").to_numpy()
            # rows after the last change of word wait for the next batch
            cut = np.flatnonzero(w[1:] != w[:-1])
            if len(cut):
                at = int(cut[-1]) + 1
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, at)])
                held, size = [batch.slice(at)], batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _flat(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns, names=names).to_batches(BATCH)


def _totals_udf(totals: dict):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3, np.int64)
        for rows in _whole_words(batches):
            seating = Seating(rows, totals)
            for _ in range(BURN_IN):
                seating.sweep()
            sums += [seating.root_tables.sum(), (seating.root_customers == 1).sum(), (seating.root_customers == 2).sum()]
            contexts, at = np.unique(seating.u, return_inverse=True)
            yield from _flat([pa.nulls(len(contexts), pa.int32()), pa.array(contexts), pa.array(np.bincount(at, seating.tables, len(contexts)).astype(np.int64))], ["what", "u", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, -3], pa.int32()), pa.nulls(3, pa.int64()), pa.array(sums)], ["what", "u", "n"])

    return job


def _samples_udf(totals: dict):
    """A row for each cell (tables: its own) and one for each word, without a context (c, tables: of the root)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_words(batches):
            seating = Seating(rows, totals, BURN_IN)
            for _ in range(BURN_IN):
                seating.sweep()
            tables, customers, root = np.zeros(len(seating.words)), np.zeros(seating.rows), np.zeros(seating.rows)
            for _ in range(SAMPLES):
                seating.sweep()
                tables += seating.tables / SAMPLES
                customers += seating.root_customers / SAMPLES
                root += seating.root_tables / SAMPLES
            yield from _flat([pa.array(seating.w), pa.array(seating.u), pa.array(seating.customers.astype(np.float64)), pa.array(tables)], ["w", "u", "c", "tables"])
            yield from _flat([pa.array(seating.names), pa.nulls(seating.rows, pa.int64()), pa.array(customers), pa.array(root)], ["w", "u", "c", "tables"])

    return job


def _discount(ones: int, twos: int) -> float:
    """The usual estimate from counts of counts, kept away from 0 and 1."""
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


class Model:
    """``words``: a staged row (w, n, p, back, opening) for each word. ``n``, ``v``: tokens and distinct tokens learned.

    p: the root's probability; back: the share that the word, as a context, leaves to the root; opening: that
    share before it is divided by the context's customers.
    """

    def __init__(self, texts: DataFrame) -> None:
        """``texts``: the column text of all texts to learn from; with a column learned, those where it is false are only to be scored."""
        spark = texts.sparkSession
        texts = texts.select("text", "learned" if "learned" in texts.columns else F.lit(True).alias("learned"))
        counts = stage(texts.where("learned").select("text").mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-counts")
        size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") >= CONTEXT_TOKENS).alias("contexts"), F.count_if(F.col("n") == 1).alias("once")).first()
        self.n, self.v = size["n"] or 0, size["v"]
        ends = counts.where(F.col("w") == word_key(END)).first()
        #: The most frequent words, for broadcasts.
        least = _least_step(counts, KNOWN_WORDS, "n")
        self.is_known = _step("n") >= F.lit(least) if least is not None else F.lit(False)
        self.known = stage(counts.where(self.is_known), "lm-known")
        least = _least_step(self.known, SENT_WORDS, "n")
        self.is_sent = self.is_known & (_step("n") >= F.lit(least)) if least is not None else F.lit(False)
        known = self.known.toArrow()
        at_hand = int((known.column("n").to_numpy() >= CONTEXT_TOKENS).sum())
        again = counts.where(~self.is_known & (F.col("n") > 1)).select(F.col("w").alias("key"))
        self.contexts = Contexts(known, ends["n"] if ends else 0, at_hand < size["contexts"], Marks(again, again.count(), WORD_MARKS))
        shared = spark.sparkContext.broadcast(self.contexts)
        # a shard's pairs are summed together: enough shards for all tasks, and none too large for one
        shards = 1 + max(min(256, self.n >> 19), self.n >> 22)
        dealt = texts.mapInArrow(_pair_counts_udf(shared, shards), "shard int, pairs binary, others binary").groupBy("shard")
        cells = lambda every: dealt.applyInArrow(_cells_udf(shared, every), "w long, u long, c long")
        start = spark.range(int(self.contexts.start)).select(F.lit(START).alias("u"), F.lit(ends["n"] if ends else 0).cast("long").alias("customers"))
        # every token is followed by one, but ends: a context has as many customers as it was met
        frequent = counts.where((F.col("n") >= CONTEXT_TOKENS) & (F.col("w") != word_key(END))).select(F.col("w").alias("u"), F.col("n").alias("customers")).unionByName(start)
        if CONTEXT_TOKENS > 1 and at_hand < size["contexts"]:
            all_cells, cells = cells, lambda every: all_cells(every).join(frequent, "u", "left_semi").select("w", "u", "c")
        #: A row for each cell (w, u, c), counted anew where it is read.
        self.cells = cells(True)
        #: The cells that are written: those met more than once, and of the others those that a score may ask for.
        self.kept = kept = stage(cells(False), "lm-cells")
        release(spark)
        cells = kept.where("c > 1")
        none, met = F.lit(0).cast("long"), counts
        # what isn't seated in a cell met more often sits alone
        beside = lambda all_: F.col(all_) - F.coalesce("seated", none)
        seated = cells.groupBy("u").agg(F.sum("c").alias("seated"), F.count("*").alias("cells"))
        contexts = frequent.join(seated, "u", "left").select("u", "customers", beside("customers").alias("alone"), (beside("customers") + F.coalesce("cells", none)).alias("tables"))
        contexts = stage(contexts, "lm-contexts")
        inside = cells.groupBy("w").agg(F.sum("c").alias("seated"))
        # the root's own customers: words after rarer words, and the tables of cells met once
        counts = stage(counts.join(inside, "w", "left").select("w", "n", beside("n").alias("alone")), "lm-counts")
        total = contexts.agg(F.sum("customers").alias("n"), F.sum("tables").alias("cells"), F.sum("alone").alias("ones")).first()
        repeated = kept.agg(F.count("*").alias("cells"), F.count_if(F.col("c") == 2).alias("twos")).first()
        #: How many cells are kept.
        self.held = repeated["cells"]
        direct = self.n - (total["n"] or 0)
        totals = {"d1": _discount(total["ones"] or 0, repeated["twos"]), "d0": 0.5, "root_customers": direct + (total["cells"] or 0), "root_tables": self.v, "base": 1 / (self.v + 1)}
        # A word met once sits at one table, whatever the draws: only the others are seated.
        single = size["once"]

        def rows(now: DataFrame) -> DataFrame:
            seated = cells.join(now.where("customers > 1").select("u", "tables").hint("shuffle_hash"), "u").select("w", "u", "c", "tables")
            alone = counts.where("n > 1 and alone > 0").select("w", F.lit(None).cast("long").alias("u"), F.col("alone").alias("c"), none.alias("tables"))
            return seated.unionByName(alone).repartition("w").sortWithinPartitions("w")

        drawn = stage(rows(contexts).mapInArrow(_totals_udf(totals), "what int, u long, n long"), "lm-tables")
        sums = {r["what"]: r["n"] for r in drawn.where("what is not null").groupBy("what").agg(F.sum("n").alias("n")).collect()}

        def opened(tables: DataFrame) -> DataFrame:
            """Contexts with all tables, of the summed ``tables`` and of the cells met once."""
            return contexts.select("u", "customers", "alone").join(tables, "u", "left").select("u", "customers", (F.col("alone") + F.coalesce("t", F.lit(0))).alias("tables"))

        then = stage(opened(drawn.where("what is null").groupBy("u").agg(F.sum("n").alias("t"))), "lm-contexts")
        unstage(drawn)
        release(spark)
        if self.v:
            get = lambda what: sums.get(what, 0)
            totals = totals | {"root_customers": direct + (then.agg(F.sum("tables")).first()[0] or 0), "root_tables": single + get(-1), "d0": _discount(single + get(-2), get(-3))}
        self.d0, self.d1 = totals["d0"], totals["d1"]
        self.seating = seating = stage(rows(then).mapInArrow(_samples_udf(totals), "w long, u long, c double, tables double"), "lm-seating")
        root = seating.where("u is null").select("w", F.col("c").alias("rc"), F.col("tables").alias("rt"))
        root = counts.select("w", "n").join(root, "w", "left").select("w", "n", F.coalesce("rc", F.lit(1.0)).alias("rc"), F.coalesce("rt", F.lit(1.0)).alias("rt"))
        last = opened(seating.where("u is not null").groupBy("u").agg(F.sum("tables").alias("t")))
        opening = F.lit(STRENGTH) + F.lit(self.d1) * F.col("tables")
        last = last.select(F.col("u").alias("w"), opening.alias("opening"), (opening / (F.col("customers") + STRENGTH)).alias("back"))
        joined = stage(root.join(last, "w", "full"), "lm-words")
        # fewer contexts than words: the cells are then counted anew by ``met``
        for used in (contexts, then, counts, *([met] if CONTEXT_TOKENS == 1 else [])):
            unstage(used)
        release(spark)
        seats = joined.agg(F.sum("rc"), F.sum("rt")).first()
        self.root_seats = STRENGTH + (seats[0] or 0.0)
        self.unknown = (STRENGTH + self.d0 * (seats[1] or 0.0)) / (self.v + 1) / self.root_seats
        #: The values of a word met once.
        self.once = {"p": (1 - self.d0) / self.root_seats + self.unknown, "opening": STRENGTH + self.d1, "back": (STRENGTH + self.d1) / (1 + STRENGTH)}
        if CONTEXT_TOKENS > 1:
            self.once |= {"opening": STRENGTH, "back": 1.0}
        p = (F.col("rc") - F.lit(self.d0) * F.col("rt")) / self.root_seats + self.unknown
        one = F.lit(1.0)
        #: A row for each word and for the start of a text, which has no n.
        self.values = joined.select("w", "n", F.coalesce(p, one).alias("p"), F.coalesce("back", one).alias("back"), F.coalesce("opening", F.lit(STRENGTH)).alias("opening"))
        self.words = self.values.where("n is not null")

    def probabilities(self, words: DataFrame) -> DataFrame:
        """``words`` of the model with p: array<double>, the root's predictive probability alone."""
        return words.select("w", "n", F.array("p").alias("p"))

    def unknown_probabilities(self) -> np.ndarray:
        return np.array([self.unknown])

    def gains(self, sent: DataFrame, hot: Column) -> DataFrame:
        """(u, w, gain, own, hot) of the kept cells: the logarithm of a pair's probability over the root's share in it; ``sent``: words small enough to broadcast.

        own: the pair's own customers in this, where both are words of the scorer's broadcast; else 0. ``hot``: of the count c.
        """
        own = self.seating.where(F.col("u").isNotNull()).select("u", "w", (F.col("c") - F.lit(self.d1) * F.col("tables")).alias("own"), hot.alias("hot"))
        cells = own.unionByName(self.kept.where(F.col("c") == 1).select("u", "w", F.lit(1 - self.d1).alias("own"), hot.alias("hot")))
        # the start of a text, which has no n, is at hand as well
        side = lambda df, key, name: df.select(F.col("w").alias(key), F.col(name).alias(f"{key}_{name}"), (self.is_known | F.col("n").isNull()).alias(f"{key}_near"))
        found = cells.join(F.broadcast(side(sent, "w", "p")), "w", "left").join(F.broadcast(side(sent, "u", "opening")), "u", "left")
        near, rare = found.where("w_p is not null"), found.where("w_p is null").drop("w_p", "w_near")
        found = near.unionByName(rare.join(side(self.words.where(~self.is_sent), "w", "p"), "w"))
        near, rare = found.where("u_opening is not null"), found.where("u_opening is null").drop("u_opening", "u_near")
        found = near.unionByName(rare.join(side(self.words.where(~self.is_sent), "u", "opening"), "u"))
        return found.select("u", "w", F.log10(F.lit(1.0) + F.col("own") / (F.col("u_opening") * F.col("w_p"))).alias("gain"), F.when(F.col("w_near") & F.col("u_near"), F.col("own")).otherwise(F.lit(0.0)).alias("own"), "hot")


def _least_step(totals: DataFrame, most: int, n: str) -> int | None:
    """The least step (a sixteenth of a doubling of ``n``) such that ``most`` rows or fewer are there or above."""
    left, least = most, None
    for at, size in sorted(((r[0], r[1]) for r in totals.groupBy(_step(n)).count().collect()), reverse=True):
        if size > left:
            break
        left, least = left - size, at
    return least


def _step(n: str) -> Column:
    return F.floor(F.log2(n) * 16)


class Table:
    """Values by 64-bit key; the first row stands for keys that aren't there."""

    def __init__(self, rows: pa.Table, key: str, columns: dict[str, float], last: dict[str, float] | None = None) -> None:
        """``last``: values of one more row, which no key finds."""
        keys = rows.column(key).to_numpy()
        order = np.argsort(keys)
        self.keys = keys[order]
        # keys are hashes: a bucket of their upper bits holds about one
        self.shift = 64 - max(1, len(keys).bit_length())
        buckets = (self.keys >> self.shift) + (1 << 63 - self.shift)
        self.first = np.searchsorted(buckets, np.arange((1 << 64 - self.shift) + 1)).astype(np.int32)
        self.values = {c: np.concatenate(([other], rows.column(c).to_numpy()[order].astype(np.float64), [last[c]] if last else [])) for c, other in columns.items()}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, 0 for those that aren't there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        bucket = (keys >> self.shift) + (1 << 63 - self.shift)
        at, end = self.first[bucket], self.first[bucket + 1]
        found, left = np.zeros(len(keys), np.int64), np.flatnonzero(at < end)
        while len(left):
            now = at[left]
            same = self.keys[now] == keys[left]
            found[left[same]] = now[same] + 1
            at[left] += 1
            left = left[~same & (now + 1 < end[left])]
        return found


class Marks:
    """Which keys may be among some: a bit for each, 2^``most`` bits at most; others may share it."""

    def __init__(self, keys: DataFrame, rows: int, most: int) -> None:
        """``keys``: the column key."""
        self.bits = 1 << min(most, max(6, (16 * rows).bit_length()))
        at = keys.select(F.shiftright(F.col("key").bitwiseAND(self.bits - 1), 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 AS int))").alias("bit"))
        found = at.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.int64)
        self.words[found.column("at").to_numpy()] = found.column("bits").to_numpy()

    def of(self, keys: np.ndarray) -> np.ndarray:
        return (self.words[(keys & (self.bits - 1)) >> 6] >> (keys & 63) & 1) == 1


def _score_texts(texts: pa.Array, learned: np.ndarray, words: Table, pairs: Table, start: float, contexts: Contexts, marks: Marks, once: float) -> tuple:
    """Tokens, known tokens, base and score of each text by broadcast values, and its other words' and pairs' keys with their numbers.

    ``marks``: of the other pairs that are kept. A learned text's pair was met: if it isn't kept, once, and then it gains by what
    ``once`` adds to the root's share. Where both words' values are at hand, that is taken for all pairs but the broadcast ones; the
    join makes it good for the others. A pair of a word met once needs none.
    """
    keys, w, u, sizes = _tokens(texts)
    text = np.repeat(np.arange(len(texts)), sizes)
    of_learned, found, single = np.repeat(learned, sizes), words.find(keys), contexts.once(keys)
    w_single, u_single = of_learned & single[w], of_learned & single[u]
    last = len(words.keys) + 1
    places, before = np.where(w_single, last, found[w]), np.where(u_single, last, found[u])
    pair = pair_keys(keys[u], keys[w])
    pair_places = pairs.find(pair)
    total = lambda x: np.bincount(text, x, len(texts))
    rare, far = places == 0, (pair_places == 0) & contexts.of(keys)[u]
    if contexts.least > 1:
        far &= ~u_single
    gain = pairs.values["gain"][pair_places]
    sure = far & of_learned & ~rare & (before > 0)
    assumed = np.flatnonzero(sure)
    gain[assumed] = np.log10(1 + once / (words.values["opening"][before[assumed]] * words.values["p"][places[assumed]]))
    far &= ~(sure & (w_single | u_single))
    far[far] = marks.of(pair[far])
    base, score = total(words.values["base"][places]), start + total(words.values["score"][places] + gain)
    others, owner = np.concatenate((keys[w[rare]], pair[far])), np.concatenate((text[rare], text[far]))
    return sizes, total(~rare).astype(np.int64), base, score, others[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(texts))


def _score_udf(known):
    @F.arrow_udf("struct<n_tokens: long, n_known: long, base: double, score: double, others: array<long>>")
    def score(texts: pa.Array, learned: pa.Array) -> pa.Array:
        values = known.value
        rows = pa.RecordBatch.from_arrays([texts, learned], ["text", "learned"])
        parts = [_score_texts(piece.column(0), piece.column(1).to_numpy(zero_copy_only=False), *values) for piece in _pieces(iter([rows]), TOGETHER)]
        kinds = (np.int64, np.int64, np.float64, np.float64, np.int64, np.int64)
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in enumerate(kinds)]
        offsets = pa.array(np.concatenate(([0], np.cumsum(columns[5]))), pa.int32())
        return pa.StructArray.from_arrays([*map(pa.array, columns[:4]), pa.ListArray.from_arrays(offsets, pa.array(columns[4]))], ["n_tokens", "n_known", "base", "score", "others"])

    return score


def fold(doc_id: str, modulus: int = 7) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    learned = fold(doc_id) != held_out
    model = Model(docs.select(F.col(text).alias("text"), learned.alias("learned")))
    known = stage(model.values.where("n is null").unionByName(model.values.where(model.is_known)), "lm-known")
    space = F.lit(float(model.n + model.v + 1))
    word_values = lambda df: df.select("w", F.log10((F.col("n") + 1) / space).alias("base"), (F.log10("p") + F.log10("back")).alias("score"), "p", "opening")
    unknown_base, unknown_score = -float(np.log10(model.n + model.v + 1)), float(np.log10(model.unknown))
    once = model.once | {"base": float(np.log10(2 / (model.n + model.v + 1))), "score": float(np.log10(model.once["p"] * model.once["back"]))}
    words = Table(word_values(known).toArrow(), "w", {"base": unknown_base, "score": unknown_score, "p": 1.0, "opening": 1.0}, once)
    start = float(np.log10((known.where("n is null").first() or {"back": 1.0})["back"]))
    least = _least_step(model.kept.where("c > 1"), KNOWN_PAIRS, "c")
    hot = _step("c") >= F.lit(least) if least is not None else F.lit(False)
    rare = word_values(model.words.where(~model.is_known)).select(F.col("w").alias("key"), F.lit(1).alias("n"), (F.col("base") - unknown_base).alias("base"), (F.col("score") - unknown_score).alias("score"), F.lit(0.0).alias("own"), F.lit(False).alias("hot"))
    gains = model.gains(known.where(F.col("n").isNull() | model.is_sent), hot).select(F.xxhash64("u", "w").alias("key"), F.lit(0).alias("n"), F.lit(0.0).alias("base"), F.col("gain").alias("score"), "own", "hot")
    all_ = stage(gains.unionByName(rare), "lm-far")
    pairs = Table(all_.where("hot").select("key", F.col("score").alias("gain")).toArrow(), "key", {"gain": 0.0})
    far = all_.where("not hot").drop("hot")
    marks = Marks(far.where("n = 0").select("key"), model.held, MARKS)
    unstage(model.kept)
    release(docs.sparkSession)
    scored = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == held_out).alias("held_out"), _score_udf(docs.sparkSession.sparkContext.broadcast((words, pairs, start, model.contexts, marks, 1 - model.d1)))(F.col(text), learned).alias("s"))
    scored = stage(scored.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "s.*"), "lm-scored")
    release(docs.sparkSession)
    # held-out texts have nothing assumed; a learned one's pair of broadcast words was taken for one met once
    assumed = F.log10(F.lit(1.0) + (F.pow(F.lit(10.0), "score") - 1) * F.lit(1 - model.d1) / F.col("own"))
    score = F.col("score") - F.when(F.col("held_out") | (F.col("own") == 0), F.lit(0.0)).otherwise(assumed)
    sums = None
    for k in range(SLICES):
        # the shuffle of one slice of the keys is gone before the next
        own = F.col("key").bitwiseAND(SLICES - 1) == k
        part = scored.select("row", "held_out", F.explode("others").alias("key")).where(own).join(far.where(own).hint("shuffle_hash"), "key").groupBy("row").agg(F.sum("n").alias("n"), F.sum("base").alias("base"), F.sum(score).alias("score"))
        part = stage(part, "lm-sums")
        release(docs.sparkSession)
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("n", "base", "score")])
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.drop("others").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "rare_n").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), add("base", "rare_base").alias("base_score"), add("score", "rare_score").alias("score")
    )
