"""Alignment of two tokenizers over the same bytes.

A text's tokens are laid out over its bytes: the owner array of a tokenizer repeats each token's number once
for each byte that it covers. Consecutive distinct pairs of owners are the overlaps of tokens of A and B; where
both owners change at once, or the text ends, lies a cut. Cuts part the tokens into groups, each with the same
bytes on both sides, and link the two tokens that end there.

Neither tokenizer of this kind joins bytes across the end of a word and a space behind it, so a cut lies there in any
text, and a text's figures are those of its words, in their order. Each task aligns a word with its space once
and keeps what it found for words it met, ``HELD_LETTERS`` or fewer letters of them; new words are aligned many at a
time, as one text. Tokenizers that do join across such ends have their texts aligned whole.

Links are counted by pair of ids over the whole corpus. Each task adds up the pairs of its texts before they are
shuffled. The ``KNOWN_PAIRS`` most frequent pairs, or fewer, are broadcast with their counts, all others are
joined to them; which are broadcast changes the cost, never a result. What is broadcast for the second
tokenizer's ids is no more than its vocabulary.

Defined results: tokenizer A reads a space and the text, B the text, to which it adds the space. A text that is
null or empty, or whose tokens' bytes on either side are not the space and the text, has no tokens: its figures
are 0, its groups are '' . Strings of special tokens are ordinary text. Repeated rows and null ids each keep
their own row and count each in the corpus; an empty table gives an empty one; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Most pairs of ids whose counts are broadcast.
KNOWN_PAIRS = 1 << 20
#: Pairs of a task that are added up together, and bytes of text encoded together, about.
HELD_PAIRS = 4_000_000
TOGETHER = 1 << 21
#: Letters of the words whose alignments a task keeps, and of the words aligned as one text, about.
HELD_LETTERS = 1_500_000
ALIGNED_LETTERS = 1 << 18
#: Where a word ends before a space. What isn't a letter, digit or ASCII sign may be a blank to a tokenizer and cuts nothing.
WORD_END = re.compile(r"(?<=[\w!-~])(?= )")
OTHER_END = re.compile(r"[^\w!-~] |  ")
#: A text that tells whether a tokenizer joins across ends of words.
PROBE = "One, two  three\n\n four's 5,6 (seven)  \n  eight ação -- 日本 x.\t9 don't  A1 "


class ByteLevel:
    """A byte-level BPE of the tokenizers library; special strings are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        # printable bytes stand for themselves, the others in their order for the characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.tokens = [b""] * (max(entries.values()) + 1)
        for entry, at in entries.items():
            self.tokens[at] = bytes(signs[c] for c in entry)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A model of the sentencepiece library that puts a space before a text."""

    SPACE = "▁"

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.tokens = [self.bytes_of(i) for i in range(self.model.vocab_size())]

    def bytes_of(self, at: int) -> bytes:
        piece = self.model.id_to_piece(at)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(at) else piece.replace(self.SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def encoder(path: str) -> ByteLevel | Pieces:
    """One a process."""
    found = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    found.sizes = np.array([len(t) for t in found.tokens], np.int32)
    found.digits = [str(i) for i in range(len(found.tokens))]
    return found


class Alignment:
    """Owner arrays of two token sequences that cover the same bytes."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray) -> None:
        a = np.repeat(np.arange(len(a_sizes), dtype=np.int32), a_sizes)
        b = np.repeat(np.arange(len(b_sizes), dtype=np.int32), b_sizes)
        a_ends, b_ends = np.append(a[1:] != a[:-1], True), np.append(b[1:] != b[:-1], True)
        if not len(a):
            a_ends = b_ends = np.zeros(0, bool)
        either, both = np.flatnonzero(a_ends | b_ends), np.flatnonzero(a_ends & b_ends)
        #: Token numbers that share bytes, in order: the owners of each run of bytes without a change.
        self.overlaps = a[either], b[either]
        #: Byte offsets where both sides' tokens end, and the numbers of the tokens that end there.
        self.cuts, self.links = both + 1, (a[both], b[both])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of A and of B."""
        a, b = (np.diff(ends, prepend=-1) for ends in self.links)
        at = np.arange(len(self.cuts))
        return np.repeat(at, a), np.repeat(at, b)


def aligned(a: ByteLevel | Pieces, b: ByteLevel | Pieces, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, Alignment] | None]:
    """Ids of A and B and their alignment for each text; None for one without tokens. Long texts are encoded a few at a time."""
    at, held, size = 0, [], 0
    while at < len(texts) or held:
        if at < len(texts) and size < TOGETHER:
            held.append(texts[at] or "")
            size += len(held[-1])
            at += 1
            continue
        for text, a_ids, b_ids in zip(held, a.encode(held), b.encode(held), strict=True):
            whole = b" " + text.encode()
            if text and b"".join(map(a.tokens.__getitem__, a_ids)) == whole == b"".join(map(b.tokens.__getitem__, b_ids)):
                a_at, b_at = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
                yield a_at, b_at, Alignment(a.sizes[a_at], b.sizes[b_at])
            else:
                yield None
        held, size = [], 0


def written(a: ByteLevel | Pieces, b: ByteLevel | Pieces, a_ids: np.ndarray, b_ids: np.ndarray, found: Alignment) -> str:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""
    a_group, b_group = found.groups()
    a_at = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, "left")
    b_at = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")
    # 2 x place: the token; 2 x place + 1: what comes after it
    out = np.full(2 * (len(a_ids) + len(b_ids)), ",", object)
    out[2 * a_at] = [a.digits[i] for i in a_ids.tolist()]
    out[2 * b_at] = [b.digits[i] for i in b_ids.tolist()]
    out[2 * a_at[found.links[0]] + 1] = "|"
    out[2 * b_at[found.links[1]] + 1] = ";"
    return "".join(out[:-1].tolist())


GROUPS = pa.list_(pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("end", pa.int64())]))


def align_texts(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, groups, overlaps) for every row.

    groups: the ids of both sides between two cuts and the byte offset where they end; overlaps: the numbers, from
    0, of the tokens that share bytes.
    """

    @F.arrow_udf("struct<groups: array<struct<a_ids: array<int>, b_ids: array<int>, end: long>>, overlaps: array<struct<a: int, b: int>>>")
    def align(texts: pa.Array) -> pa.Array:
        groups, overlaps = [], []
        for x in aligned(encoder(a_path), encoder(b_path), texts.to_pylist()):
            if x is None:
                groups.append([])
                overlaps.append([])
                continue
            a_ids, b_ids, found = x
            sides = [[[i for i, _ in g] for _, g in groupby(zip(ids.tolist(), group.tolist(), strict=True), key=lambda p: p[1])] for ids, group in zip((a_ids, b_ids), found.groups(), strict=True)]
            groups.append([{"a_ids": p, "b_ids": q, "end": e} for p, q, e in zip(*sides, found.cuts.tolist(), strict=True)])
            overlaps.append([{"a": p, "b": q} for p, q in zip(*(o.tolist() for o in found.overlaps), strict=True)])
        pairs = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(groups, GROUPS), pa.array(overlaps, pairs)], ["groups", "overlaps"])

    return docs.select(F.col(doc_id).alias("doc_id"), align(F.col(text)).alias("x")).select("doc_id", "x.*")


def words_of(text: str) -> list[str]:
    """Parts of a text that a space precedes, each; together, with these spaces, they are the space and the text."""
    if OTHER_END.search(text) or text.startswith(" "):
        parts = [p[1:] for p in WORD_END.split(" " + text)]
    else:
        parts = text.split(" ")
    if len(parts) > 1 and not parts[-1]:
        # a last space alone stays with its word: a tokenizer sees no text in it
        parts[-2:] = [parts[-2] + " "]
    return parts


class Words(dict):
    """What is found for each word: numbers of tokens of A and B, of groups, the groups as text, linked pairs as bytes; None if its bytes differ."""

    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> None:
        self.a, self.b, self.letters = a, b, 0
        ends = lambda side: any(WORD_END.search(t.decode("utf-8", "ignore")) for t in side.tokens)
        by_words = lambda side: side.encode([PROBE])[0] == [i for ids in side.encode(words_of(PROBE)) for i in ids]
        self.usable = all(not ends(side) and by_words(side) for side in (a, b))

    def learn(self, texts: list[list[str]]) -> None:
        """Have all words of these texts at hand."""
        new = {w for words in texts for w in words if w not in self}
        if self.letters + sum(map(len, new)) > HELD_LETTERS and self:
            self.clear()
            self.letters, new = 0, {w for words in texts for w in words}
        held, size = [], 0
        for word in new:
            if not WORD_END.match(word + " ", len(word)):
                # the last word of a text may end otherwise: another one behind it would not be parted from it
                self._align([word])
                continue
            held.append(word)
            size += len(word) + 1
            if size > ALIGNED_LETTERS:
                self._align(held)
                held, size = [], 0
        if held:
            self._align(held)
        self.letters += sum(map(len, new))

    def _align(self, words: list[str]) -> None:
        # each word has its space, so that together they are a text of which the first space is the tokenizer's
        found = next(aligned(self.a, self.b, [" ".join(words)]), None) if words != [""] else None
        if found is None:
            if len(words) == 1:
                self[words[0]] = None
            else:
                half = len(words) // 2
                self._align(words[:half])
                self._align(words[half:])
            return
        a_ids, b_ids, alignment = found
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        last = np.searchsorted(alignment.cuts, ends)
        if (alignment.cuts[last] != ends).any():
            raise ValueError("a token joins two words")
        groups = written(self.a, self.b, a_ids, b_ids, alignment).split(";")
        links = a_ids[alignment.links[0]] << 32 | b_ids[alignment.links[1]]
        firsts, befores = [0, *(last[:-1] + 1).tolist()], [(-1, -1), *zip(*(x[last[:-1]].tolist() for x in alignment.links), strict=True)]
        for word, first, end, (a0, b0), a1, b1 in zip(words, firsts, (last + 1).tolist(), befores, alignment.links[0][last].tolist(), alignment.links[1][last].tolist(), strict=True):
            self[word] = a1 - a0, b1 - b0, end - first, ";".join(groups[first:end]), links[first:end].tobytes()


@cache
def _words(a_path: str, b_path: str) -> Words:
    """One a process."""
    return Words(encoder(a_path), encoder(b_path))


def figures_by_word(known: Words, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes] | None]:
    """Tokens of A and B, groups, their text and the linked pairs of each text; None for one without tokens."""
    at, held, size = 0, [], 0
    while at < len(texts) or held:
        if at < len(texts) and size < TOGETHER:
            held.append(words_of(texts[at]) if texts[at] else [])
            size += len(texts[at] or "")
            at += 1
            continue
        known.learn(held)
        for words in held:
            parts = [known[w] for w in words]
            if not parts or None in parts:
                yield None
                continue
            n_a, n_b, n_groups, groups, pairs = zip(*parts, strict=True)
            yield sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(pairs)
        held, size = [], 0


def figures_by_text(a: ByteLevel | Pieces, b: ByteLevel | Pieces, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes] | None]:
    """As ``figures_by_word``, each text aligned whole."""
    for x in aligned(a, b, texts):
        if x is None:
            yield None
            continue
        a_ids, b_ids, found = x
        links = a_ids[found.links[0]] << 32 | b_ids[found.links[1]]
        yield len(a_ids), len(b_ids), len(found.cuts), written(a, b, a_ids, b_ids, found), links.tobytes()


def _figures_udf(a_path: str, b_path: str):
    """Figures of each text, and its distinct linked pairs (A's id x 2^32 + B's) with how often each is there."""

    @F.arrow_udf("struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, pairs: array<long>, times: array<int>>")
    def figures(texts: pa.Array) -> pa.Array:
        known, texts = _words(a_path, b_path), texts.to_pylist()
        found = figures_by_word(known, texts) if known.usable else figures_by_text(known.a, known.b, texts)
        numbers, hashes, pairs, times = [], [], [], []
        for x in found:
            n_a, n_b, n_groups, text, links = x or (0, 0, 0, "", b"")
            own, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
            numbers.append((n_a, n_b, n_groups, len(links) // 8))
            hashes.append(hashlib.sha256(text.encode()).hexdigest() if x else "")
            pairs.append(own)
            times.append(n)
        offsets = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
        flat = lambda parts, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind)))
        columns = [pa.array([r[c] for r in numbers], pa.int64()) for c in range(4)]
        return pa.StructArray.from_arrays([*columns, pa.array(hashes, pa.string()), flat(pairs, np.int64), flat(times, np.int32)], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return figures


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate([n for _, n in held]))
        held.clear()
        yield from pa.table([keys, sums], names=["pair", "n"]).to_batches(1 << 16)

    for batch in batches:
        held.append((_flat(batch, "pairs"), _flat(batch, "times").astype(np.int64)))
        size += len(held[-1][0])
        if size >= HELD_PAIRS:
            yield from out()
            size = 0
    if held:
        yield from out()


def pair_counts(figures: DataFrame) -> DataFrame:
    """(pair, n, is_best): links of each pair over all rows, and whether no pair of its B id has more; staged."""
    counts = stage(figures.select("pairs", "times").mapInArrow(_pair_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    # as many rows as the second tokenizer has ids, at most
    return counts.select("pair", "n", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))


def _known_pairs(counts: DataFrame) -> tuple[pa.Table, int]:
    """The most frequent pairs, and the least count of them; equal counts are in or out together."""
    left, least = KNOWN_PAIRS, 1 << 62
    # 16 steps to each doubling: their number grows with the logarithm of the corpus
    step = F.floor(F.log2("n") * 16)
    for size, lowest in ((r[1], r[2]) for r in counts.groupBy(step.alias("s")).agg(F.count("*"), F.min("n")).orderBy(F.desc("s")).collect()):
        if size > left:
            break
        left, least = left - size, lowest
    return counts.where(F.col("n") >= least).toArrow(), least


def _sums_udf(known):
    """n_best and count_sum over the broadcast pairs, and the other pairs with how often each is there."""

    @F.arrow_udf("struct<n_best: long, count_sum: long, others: array<long>, often: array<int>>")
    def sums(pairs: pa.Array, times: pa.Array) -> pa.Array:
        keys, n, best = known.value
        own, often = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in pairs])))
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        here = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        at = at[here]
        row = np.repeat(np.arange(len(pairs)), np.diff(ends))
        total = lambda values: [int(x) for x in _row_sums(values, row[here], len(pairs))]
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~here], minlength=len(pairs))))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(own[~here])), pa.ListArray.from_arrays(offsets, pa.array(often[~here].astype(np.int32)))]
        columns = [pa.array(total(often[here] * best[at] if len(at) else np.empty(0, np.int64)), pa.int64()), pa.array(total(often[here] * n[at] if len(at) else np.empty(0, np.int64)), pa.int64())]
        return pa.StructArray.from_arrays([*columns, *lists], ["n_best", "count_sum", "others", "often"])

    return sums


def _row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.int64)
    np.add.at(out, row, values)
    return out


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    figures = docs.select(F.col(doc_id).alias("doc_id"), _figures_udf(a_path, b_path)(F.col(text)).alias("f"))
    figures = stage(figures.select(F.monotonically_increasing_id().alias("row"), "doc_id", "f.*"), "align-figures")
    counts = stage(pair_counts(figures), "align-counts")
    known, least = _known_pairs(counts)
    order = np.argsort(keys := known.column("pair").to_numpy())
    values = keys[order], known.column("n").to_numpy()[order], known.column("is_best").to_numpy()[order].astype(np.int64)
    sums = _sums_udf(docs.sparkSession.sparkContext.broadcast(values))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    near = stage(figures.select(*kept, sums("pairs", "times").alias("s")).select(*kept, "s.*"), "align-sums")
    rare = near.select("row", F.explode(F.arrays_zip("others", "often")).alias("o")).select("row", F.col("o.others").alias("pair"), F.col("o.often").alias("times"))
    far = rare.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum")
    )
    zero = F.lit(0)
    return near.join(far, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("best", zero)).cast("long").alias("n_best"), (F.col("count_sum") + F.coalesce("sum", zero)).cast("long").alias("count_sum"), "groups_sha256",
    )
