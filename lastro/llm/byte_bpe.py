"""Byte-level BPE by prefix dynamic programming: encoding, decoding, appends and edits.

Every prefix of a byte string has one encoding, and its last token tells how the rest of it goes on: with
``last[i]`` the last token of the prefix of i bytes, the encoding is read backwards from the end. A token t
that ends at i is ``last[i]`` if the boundary before it stands, that is, if no merge of the bytes of
``last[i - len(t)]`` and t crosses it; one token alone passes. So prefixes are settled from left to right, in
time that grows with the length, an append goes on from the stored tokens, and after an edit only the
prefixes near it are settled anew: once as many in a row as the longest token has bytes are what they were
before, so are all later ones.

Texts are cut by the vocabulary's pattern first and each match is encoded alone; a task keeps the ids of the
matches it met, ``HELD_MATCHES`` or fewer.

Defined results: a null text counts as empty (no ids, the hash of nothing); strings of special tokens are
ordinary text; repeated rows and null ids each keep their own row; an empty table gives an empty one; other
columns are left out, whatever their names. Null ids decode to null, ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches of a task whose ids are kept.
HELD_MATCHES = 400_000
#: Token pairs of a process whose boundaries are kept.
HELD_PAIRS = 1 << 20
#: How far the pattern looks beyond a match, in characters, at most.
LOOK_AHEAD = 3
NEVER = 1 << 62


class Vocabulary:
    """Ranks of byte strings, which are their ids too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        #: Finds all tokens that end at a byte, the longest first; it takes text, a character for each byte.
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.endings.add_word(token.decode("latin-1"), rank)
        self.endings.make_automaton()
        self.longest = max(map(len, ranks))
        self.stands = lru_cache(HELD_PAIRS)(self._stands)
        self.halves = cache(self._halves)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte."""
        text = self.tokens[token]
        for cut in range(1, len(text)):
            a, b = self.ranks.get(text[:cut], NEVER), self.ranks.get(text[cut:], NEVER)
            if max(a, b) < token and self._stands(a, b, token):
                return a, b
        return None

    def _stands(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether BPE over the bytes of both keeps the boundary between them, up to the merge of rank ``before``.

        The merges that made a's right and b's left edge are undone, the last first. Between two of them the
        edges must not merge with each other earlier than the next merge on either side, the left one first
        where both have one rank.
        """
        left = right = before
        while True:
            merged = self.ranks.get(self.tokens[a] + self.tokens[b], NEVER)
            if merged < left and (merged <= right if right < before else merged < right):
                return False
            a_halves, b_halves = self.halves(a), self.halves(b)
            if a_halves and (a > b or not b_halves):
                left, a = a, a_halves[1]
            elif b_halves:
                right, b = b, b_halves[0]
            else:
                return True

    def settle(self, text: bytes, last: list[int], start: int) -> Iterator[int]:
        """Settle ``last`` of every prefix longer than ``start``, which are there up to it, and yield each length."""
        begin = max(0, start - self.longest)
        done = start
        for at, token in self.endings.iter(text[begin:].decode("latin-1")):
            if (end := begin + at + 1) <= done:
                continue
            before = end - len(self.tokens[token])
            if before == 0 or (before > 0 and self.stands(last[before], token)):
                last[end], done = token, end
                yield end

    def encode_match(self, text: bytes) -> list[int]:
        """Ids of a byte string without regard to the pattern."""
        if (rank := self.ranks.get(text)) is not None:
            return [rank]
        return Prefixes(self, text).ids()

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.encode_match(m.encode())]


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b"") -> None:
        self.vocabulary, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> int:
        """Number of prefixes settled."""
        start = len(self.text)
        self.text += more
        self.last.extend([-1] * len(more))
        return sum(1 for _ in self.vocabulary.settle(self.text, self.last, start))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of the bytes from ``start`` to ``end``; number of prefixes settled."""
        old = self.last[end + 1 :]
        text = self.text[:start] + new + self.text[end:]
        last = self.last[: start + 1] + [-1] * len(new) + old
        changed, settled, same = start + len(new), 0, 0
        for at in self.vocabulary.settle(text, last, start):
            settled += 1
            if at > changed:
                same = same + 1 if last[at] == old[at - changed - 1] else 0
                if same >= self.vocabulary.longest:
                    break
        self.text, self.last = text, last
        return settled

    def ids(self) -> list[int]:
        found, at = [], len(self.text)
        while at:
            found.append(self.last[at])
            at -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One a process."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def reencode(known: Vocabulary, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int], int]:
    """The edited text, its ids, and the number of bytes encoded for it.

    Matches that end well before the edit keep their ids, and so do all from the first match after it
    that begins where one began before.
    """
    whole = text[:start] + new + text[end:]
    shift = len(whole) - len(text)
    kept, starts = 0, set()
    for m in known.pattern.finditer(text):
        if m.end() + LOOK_AHEAD <= start:
            kept = m.end()
        elif m.start() >= end:
            starts.add(m.start() + shift)
    fresh, at = [], kept
    for m in known.pattern.finditer(whole, kept):
        if m.start() in starts:
            break
        fresh.append(m.group().encode())
        at = m.end()
    ends = np.cumsum([0, *(len(known.tokens[i]) for i in ids)])
    first = int(np.searchsorted(ends, len(text[:kept].encode())))
    rest = int(np.searchsorted(ends, len(text[: at - shift].encode()))) if at < len(whole) else len(ids)
    return whole, ids[:first] + [i for m in fresh for i in known.encode_match(m)] + ids[rest:], sum(map(len, fresh))


class _Held(dict):
    """Ids by match, as bytes; emptied when full."""

    def __init__(self, known: Vocabulary) -> None:
        self.known = known

    def __missing__(self, match: str) -> bytes:
        if len(self) >= HELD_MATCHES:
            self.clear()
        found = np.array(self.known.encode_match(match.encode()), "<i4").tobytes()
        if len(match) < 64:
            self[match] = found
        return found


@cache
def _held(path: str, pattern: str) -> _Held:
    return _Held(vocabulary(path, pattern))


def _lists(parts: list[bytes | None]) -> pa.Array:
    sizes = np.array([len(p or b"") // 4 for p in parts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in parts), "<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encoder(path: str, pattern: str):
    """A column function: a text's ids as array<int>."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        held = _held(path, pattern)
        find = held.known.pattern.findall
        return _lists([b"".join(map(held.__getitem__, find(t.as_py() or ""))) for t in texts])

    return encode


def _decoded(tokens: list[bytes], ids: pa.Array) -> Iterator[tuple[np.ndarray, bytes] | None]:
    values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    for at, there in enumerate(ids.is_valid().to_pylist()):
        own = values[offsets[at] : offsets[at + 1]]
        yield (own, b"".join(map(tokens.__getitem__, own.tolist()))) if there else None


def decoder(path: str, pattern: str):
    """A column function: the bytes of ids."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([x and x[1] for x in _decoded(vocabulary(path, pattern).tokens, ids)], pa.binary())

    return decode


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) for every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), encoder(path, pattern)(F.col(text)).alias("ids"))


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, bytes) for every row."""
    return encoded.select(F.col(doc_id).alias("doc_id"), decoder(path, pattern)(F.col(ids)).alias("bytes"))


def reencode_edits(encoded: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text, ids, n_fresh) for every row of ``edits`` (doc_id, start, end, new) whose document is there.

    ``encoded``: (doc_id, text, ids). ``start`` and ``end`` are places between characters, from 0, held within the
    text; null ones stand at its end, so that a row with ``new`` alone appends. Each edit is made to the document
    as it is in ``encoded``. n_fresh: bytes encoded for it.
    """

    @F.arrow_udf("struct<text: string, ids: array<int>, n_fresh: long>")
    def edit(texts: pa.Array, ids: pa.Array, start: pa.Array, end: pa.Array, new: pa.Array) -> pa.Array:
        known, out = vocabulary(path, pattern), []
        for text, own, a, b, put in zip(texts.to_pylist(), ids.to_pylist(), start.to_pylist(), end.to_pylist(), new.to_pylist(), strict=True):
            text = text or ""
            a = len(text) if a is None else min(max(0, a), len(text))
            b = len(text) if b is None else min(max(a, b), len(text))
            out.append(dict(zip(("text", "ids", "n_fresh"), reencode(known, text, own or [], a, b, put or ""), strict=True)))
        return pa.array(out, pa.struct([("text", pa.string()), ("ids", pa.list_(pa.int32())), ("n_fresh", pa.int64())]))

    stored = encoded.select("doc_id", F.col("text").alias("old"), F.col("ids").alias("old_ids"))
    place = lambda c: F.col(c).cast("int")
    joined = edits.select("doc_id", place("start").alias("start"), place("end").alias("end"), "new").join(stored, "doc_id")
    return joined.select("doc_id", edit("old", "old_ids", "start", "end", "new").alias("e")).select("doc_id", "e.*")


def _digest(path: str, pattern: str):
    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digest(ids: pa.Array) -> pa.Array:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        rows = [(len(own), sha(own.astype("<u4").tobytes()), sha(text)) for own, text in _decoded(vocabulary(path, pattern).tokens, ids)]
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def digest_of(ids: Column, path: str, pattern: str) -> Column:
    """n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of ids that aren't null."""
    return _digest(path, pattern)(ids)


def encoding_digest(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: its text's ids, and what they decode to."""
    encoded = encode_texts(docs, path, pattern, text, doc_id)
    return encoded.select("doc_id", digest_of(F.col("ids"), path, pattern).alias("d")).select("doc_id", "d.*")
