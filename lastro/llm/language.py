"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its
letters' vectors, each permuted (rolled) by its place, by multiplication; a text's vector bundles its
trigrams by addition. A language's prototype bundles the unit vectors of its texts; a text gets the
language whose prototype has the largest cosine with its vector.

Defined results: a null text, and one without any letter, is ``und`` with score 0; so is every text if no
labelled text was learned; a null id counts as the empty text in the folds; ties go to the smaller
language; repeated rows have equal results; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

DIMENSIONS = 1024
#: Most labelled texts learned for each language, about; which ones is decided by a hash of the id.
LEARNED_TEXTS = 2500
SEED = 77
UNKNOWN = "und"
SLICE = 2048
#: A text of so many letters whose best cosine is below this is in none of the learned languages: that of unrelated
#: profiles is 0 with a deviation of 1 / sqrt(DIMENSIONS), about 0.03. Shorter texts hold too few trigrams to tell.
LEAST_SCORE = 0.1
LEAST_LETTERS = 64

_letters = np.full(0x110000, -1, np.int32)
_vectors = [np.zeros((1, DIMENSIONS), np.int8) for _ in range(3)]


def _learn_letters(codes: np.ndarray) -> None:
    """Number the new letters and draw their vectors; everything that isn't a letter is number 0, a blank of its own vector."""
    new = []
    for code in np.unique(codes[_letters[codes] < 0]).tolist():
        _letters[code] = len(_vectors[0]) + len(new) if chr(code).isalpha() else 0
        if _letters[code]:
            new.append(code)
    if not _vectors[0].any():
        blank = _draw(0)
        for place in range(3):
            _vectors[place] = np.roll(blank, place)[None, :]
    if new:
        drawn = np.stack([_draw(code) for code in new])
        for place in range(3):
            _vectors[place] = np.concatenate((_vectors[place], np.roll(drawn, place, 1)))


def _draw(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def profile(text: str) -> np.ndarray | None:
    """The text's bundled vector; None if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters[codes]
    if (letters < 0).any():
        _learn_letters(codes)
        letters = _letters[codes]
    if not letters.any():
        return None
    letters = np.concatenate(([0], letters, [0])).astype(np.int64)
    letters = letters[np.concatenate(([True], (letters[1:] != 0) | (letters[:-1] != 0)))]
    grams, counts = np.unique((letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:], return_counts=True)
    total, mask = np.zeros(DIMENSIONS, np.float32), (1 << 21) - 1
    for at in range(0, len(grams), SLICE):
        g = grams[at : at + SLICE]
        bound = _vectors[2][g >> 42] * _vectors[1][(g >> 21) & mask] * _vectors[0][g & mask]
        total += counts[at : at + SLICE].astype(np.float32) @ bound.astype(np.float32)
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if (vector := profile(text.decode())) is not None:
                total[lang] = total.get(lang, 0) + vector / max(float(np.linalg.norm(vector)), 1e-9)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "vector"])


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Language to unit prototype, from ``labelled`` (doc_id, lang, text)."""
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, LEARNED_TEXTS / n) * (1 << 20)))])
    picked = labelled.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
    sums = picked.select("lang", "text").mapInArrow(_sums, "lang string, vector array<double>")
    found: dict[str, np.ndarray] = {lang: np.zeros(DIMENSIONS) for lang in sizes}
    for r in sums.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():
        found[r["lang"]][r["at"]] = r["x"]
    return {lang: v / n for lang, v in sorted(found.items()) if (n := np.linalg.norm(v))}


def _predict_udf(known):
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, matrix = known.value
        names, scores = [], []
        for text in as_bytes(texts):
            vector = profile(text.decode()) if text and langs else None
            if vector is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            cosines = matrix @ vector / max(float(np.linalg.norm(vector)), 1e-9)
            best = int(cosines.argmax())
            names.append(langs[best])
            scores.append(min(1.0, max(0.0, float(cosines[best]))))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def predictor(learned: dict[str, np.ndarray], df: DataFrame):
    """A column function of a text: struct<lang_pred, score>."""
    langs = sorted(learned)
    matrix = np.stack([learned[x] for x in langs]) if langs else np.zeros((0, DIMENSIONS))
    return _predict_udf(df.sparkSession.sparkContext.broadcast((langs, matrix)))


def fold(doc_id: str, modulus: int = 4):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def identify_languages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; texts of fold ``held_out`` are not learned from."""
    labelled = docs.where(fold(doc_id) != held_out).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    predict = predictor(prototypes(labelled), docs)
    found = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == held_out).alias("held_out"), predict(F.col(text)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def known_languages_only(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``docs`` without those in no learned language; a null ``lang`` gets the prediction, all else stays as it is.

    Rejected: a null text, one without a letter, and one of ``LEAST_LETTERS`` letters or more that resembles no
    learned language (``LEAST_SCORE``).
    """
    labelled = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    learned = prototypes(labelled)
    if not learned:  # nothing to compare with: any text with a letter stays
        return docs.where(F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)))
    # else Spark would push the filter below the prediction and predict twice
    predict = predictor(learned, docs).asNondeterministic()
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), predict(F.col(text)).alias("p"))
    alike = (F.col("p.score") >= LEAST_SCORE) | (F.regexp_count(F.col(f"record.`{text}`"), F.lit(r"\p{L}")) < LEAST_LETTERS)
    kept = found.where((F.col("p.lang_pred") != UNKNOWN) & alike)
    kind = dict(docs.dtypes)[lang]
    filled = F.coalesce(F.col(f"record.`{lang}`"), F.col("p.lang_pred").cast(kind)).alias(lang)
    return kept.select(*[filled if c == lang else F.col(f"record.`{c}`") for c in docs.columns])
