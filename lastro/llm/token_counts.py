"""Token counts without token ids.

A pre-token is a run of non-blank bytes: the tokenizer drops blanks and never joins pieces across
them, so a text's count is the sum over its pre-tokens, and each distinct pre-token is counted once.
Frequent pre-tokens, at most ``KNOWN_WORDS`` of them, are counted first and broadcast with their
piece counts; every other pre-token of the corpus is counted once and joined to the per-document
frequencies. Which pre-tokens are broadcast changes the cost, never a count.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text count
as the library counts them; repeated rows and null ids each keep their own row; an empty table gives
an empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stage

#: Most pre-tokens whose counts are broadcast.
KNOWN_WORDS = 1 << 18
#: Documents from which the frequent pre-tokens are taken, about.
SAMPLE_DOCUMENTS = 20_000
LIMIT = 2048
#: Special strings begin so; they are matched before letters are lower-cased.
SPECIAL = b"<|"
#: First bytes of the combining marks that compose with letters of A-Z, before the tokenizer lower-cases these.
MARKS = (b"\xcc", b"\xcd")


@cache
def tokenizer(path: str):
    """The library's tokenizer, one a process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    ids = lambda text: found.encode(text, add_special_tokens=False).ids
    if ids("One, two\n  three") != ids("one,") + ids("two") + ids("three"):
        raise ValueError(f"{path} doesn't fold A-Z and drop blanks: its pre-tokens are not words")
    return found


def words_of(text: bytes | None) -> list[bytes]:
    """A text's pre-tokens, A-Z lower-cased as the tokenizer does, save where a special string or a composed letter may be."""
    if not text:
        return []
    if SPECIAL in text or any(x in text for x in MARKS):
        return [w if SPECIAL in w or not w.isascii() else w.lower() for w in text.split()]
    return text.lower().split()


def _pieces_udf(path: str):
    @F.arrow_udf("int")
    def pieces(words: pa.Array) -> pa.Array:
        encode = tokenizer(path).encode_batch_fast
        out: list[int] = []
        for at in range(0, len(words), 4096):
            out.extend(len(x.ids) for x in encode(words.slice(at, 4096).to_pylist(), add_special_tokens=False))
        return pa.array(out, pa.int32())

    return pieces


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for rows in batches:
        for text in as_bytes(rows.column(0)):
            total.update(words_of(text))
            if len(total) > 400_000:
                yield out()
                total.clear()
    yield out()


def frequent_words(docs: DataFrame, text: str = "text", most: int = KNOWN_WORDS, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(word, n): the most frequent pre-tokens of a seeded sample, ``most`` or fewer, ties kept or left together."""
    rows = max(1, docs.count())
    picked = docs.select(text).sample(False, min(1.0, sample / rows), 7) if rows > sample else docs.select(text)
    totals = stage(picked.mapInArrow(_word_totals, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample-words")
    # 16 steps to each doubling of n: the number of steps doesn't grow with the corpus beyond its logarithm
    step = F.floor(F.log2("n") * 16)
    left, least = most, None
    for at, size in sorted(((r[0], r[1]) for r in totals.where("n > 1").groupBy(step).count().collect()), reverse=True):
        if size > left:
            break
        left, least = left - size, at
    return totals.where("n > 1").where(step >= F.lit(least)) if least is not None else totals.where("false")


def _known_udf(known, result: str):
    @F.arrow_udf(result)
    def count(texts: pa.Array) -> pa.Array:
        pieces, sums, words, freqs, ends = known.value, [], [], [], [0]
        for text in as_bytes(texts):
            total = 0
            for word, n in Counter(words_of(text)).items():
                if (p := pieces.get(word)) is None:
                    words.append(word)
                    freqs.append(n)
                else:
                    total += p * n
            sums.append(total)
            ends.append(len(words))
        at = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(words, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(freqs, pa.int32()))]
        return pa.StructArray.from_arrays([pa.array(sums, pa.int64()), *lists], ["known", "words", "freqs"])

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    pieces = _pieces_udf(tokenizer_path)
    frequent = frequent_words(docs, text).select("word", pieces("word").alias("pieces"))
    known = docs.sparkSession.sparkContext.broadcast({r.word.encode(): r.pieces for r in frequent.toLocalIterator()})
    count = _known_udf(known, "struct<known: long, words: array<string>, freqs: array<int>>")
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), count(F.col(text)).alias("c"))
    counted = stage(counted.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "c.*"), "word-counts")
    rare = counted.select("row", F.explode(F.arrays_zip("words", "freqs")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.freqs").alias("freq"))
    counts = rare.select("word").distinct().select("word", pieces("word").alias("pieces"))
    sums = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("rare"))
    n_tokens = F.col("known") + F.coalesce("rare", F.lit(0))
    return counted.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left").select("doc_id", "n_bytes", n_tokens.cast("long").alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
