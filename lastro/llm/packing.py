"""Best-two-fit packing of documents' tokens into sequences of bounded length.

Pieces are dealt at random, by a seeded hash, to groups of about ``GROUP_PIECES``. In each group a
sequence is filled greedily with the longest piece that fits, until none does; then its smallest
piece is replaced by two unpacked pieces that fit its expanded gap more tightly, the tightest pair
first. A group leaves one sequence badly filled at most, so groups cost about one sequence in ten
thousand.

Defined results: a null text is packed as an empty one (the end id alone); only documents longer than
a sequence are cut; repeated rows are packed once each; ties in length go by id, then piece; an empty
table gives an empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stage
from .token_counts import SPECIAL, tokenizer, words_of

LENGTH = 2048
END_ID = 0
#: Pieces that one task packs at a time, about.
GROUP_PIECES = 50_000
#: Pre-tokens of one generation of a worker's cache; it holds two.
CACHED_WORDS = 500_000
#: Bytes of text whose new pre-tokens are encoded together, about.
TOGETHER = 1 << 21
#: Signs that end a word are a pre-token of their own after a letter; accented letters are those of Latin-1.
SIGNS = string.punctuation.encode()
ACCENTED = frozenset(chr(c).encode() for c in range(0xDF, 0x100) if chr(c).isalpha())


#: Bytes of a-z and of the lower-case letters of Latin-1.
LETTERS = (string.ascii_lowercase + "".join(x.decode() for x in ACCENTED)).encode()


def letters_tokenizer(path: str):
    """The tokenizer for words of lower-case letters: they are one pre-token and no normaliser changes them."""
    from tokenizers import Tokenizer, pre_tokenizers

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.normalizer = None
    found.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return found


class WordIds:
    """Ids of pre-tokens as little-endian unsigned 32-bit numbers, those used last kept."""

    def __init__(self, path: str) -> None:
        self.any, self.letters = tokenizer(path), letters_tokenizer(path)
        self.model = self.letters.model
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each text's pre-tokens, which never share an id."""
        self.learn(set().union(*texts))
        return [b"".join(map(self.new.__getitem__, words)) for words in texts]

    def learn(self, words: set[bytes]) -> None:
        if len(self.new) > CACHED_WORDS:
            self.new, self.old = {}, self.new
        ends, unknown = [], set()
        for word in words.difference(self.new):
            if (ids := self.old.get(word)) is not None:
                self.new[word] = ids
            elif SPECIAL not in word and (head := word.rstrip(SIGNS)) != word and (head[-1:].islower() or head[-2:] in ACCENTED):
                ends.append((word, head, word[len(head) :]))
                unknown.update(ends[-1][1:])
            else:
                unknown.add(word)
        unknown.difference_update(self.new)
        plain = {w for w in unknown if not w.translate(None, LETTERS)}
        # The model takes words of a-z as they are; all others are mapped to its alphabet first.
        basic = {w for w in plain if w.isascii()}
        self.new.update((w, array("I", [t.id for t in self.model.tokenize(w.decode())]).tobytes()) for w in basic)
        plain -= basic
        unknown -= basic
        for kind, new in ((self.letters, list(plain)), (self.any, list(unknown - plain))):
            found = kind.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            self.new.update((word, array("I", x.ids).tobytes()) for word, x in zip(new, found, strict=True))
        self.new.update((word, self.new[head] + self.new[tail]) for word, head, tail in ends)


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_bytes(texts: Iterable[bytes | None], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, about ``TOGETHER`` bytes of text at a time."""
    held, size = [], 0
    for text in texts:
        held.append(words_of(text))
        size += len(text or b"")
        if size > TOGETHER:
            yield from word_ids(path).of(held)
            held, size = [], 0
    yield from word_ids(path).of(held)


def _pieces_udf(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def pieces(texts: pa.Array) -> pa.Array:
        ends, columns = [0], ([], [], [], [])
        for ids in token_bytes(as_bytes(texts), path):
            ids += end
            for piece, start in enumerate(range(0, len(ids), 4 * length)):
                part = ids[start : start + 4 * length]
                for column, value in zip(columns, (piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
            ends.append(len(columns[0]))
        kinds, names = (pa.int32(), pa.int64(), pa.int64(), pa.int64()), ("piece", "start", "length", "ids_crc32")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names))

    return pieces


def best_two_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Sequences, as lists of positions in ``lengths``; each is at most ``most`` long in all.

    ``present`` has bit x set while a piece of length x is unpacked, ``mirror`` bit most - x: two
    pieces of lengths x and t - x are unpacked if ``present`` and ``mirror`` shifted by most - t meet.
    """
    left: list[list[int]] = [[] for _ in range(most + 1)]
    for at in range(len(lengths) - 1, -1, -1):
        left[lengths[at]].append(at)
    present, mirror, out = 0, 0, []

    def flip(x: int) -> None:
        nonlocal present, mirror
        present ^= 1 << x
        mirror ^= 1 << (most - x)

    for x in range(most + 1):
        if left[x]:
            flip(x)

    def take(x: int) -> int:
        at = left[x].pop()
        if not left[x]:
            flip(x)
        return at

    def pair(gap: int, over: int) -> tuple[int, int] | None:
        """Lengths of two unpacked pieces, the largest sum from ``gap`` down to ``over`` + 1."""
        for total in range(gap, over, -1):
            both = present & (mirror >> (most - total)) & ((1 << total) - 1)
            while both:
                x = both.bit_length() - 1
                if 2 * x != total or len(left[x]) > 1:
                    return x, total - x
                both ^= 1 << x
        return None

    while present:
        gap, chosen = most, []
        while fits := present & ((1 << (gap + 1)) - 1):
            x = fits.bit_length() - 1
            chosen.append((take(x), x))
            gap -= x
        if gap and present:
            at, small = chosen[-1]
            if two := pair(gap + small, small):
                chosen.pop()
                chosen += [(take(two[0]), two[0]), (take(two[1]), two[1])]
                if not left[small]:
                    flip(small)
                left[small].append(at)
        out.append([at for at, _ in chosen])
    return out


def _pack_udf(length: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        sizes = table.column("length").to_pylist()
        group = table.column("group")[0].as_py()
        order, sequence, offset = [], [], []
        for number, members in enumerate(best_two_fit(sizes, length)):
            place = 0
            for at in members:
                order.append(at)
                sequence.append((group << 32) + number)
                offset.append(place)
                place += sizes[at]
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(order, pa.int64()))
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def token_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): every document's tokens and its end id, cut at ``length``."""
    found = docs.select(F.col(doc_id).alias("doc_id"), _pieces_udf(tokenizer_path, length, end_id)(F.col(text)).alias("pieces"))
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "pieces").select("row", "doc_id", F.inline("pieces"))


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every row of staged ``pieces``."""
    groups = max(1, math.ceil(pieces.count() / GROUP_PIECES))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(11), "row", "piece"), F.lit(groups)))
    kind = dict(pieces.dtypes)["doc_id"]
    return dealt.groupBy("group").applyInArrow(_pack_udf(length), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    return pack(stage(token_pieces(docs, tokenizer_path, text, doc_id, length), "pieces"), length)
