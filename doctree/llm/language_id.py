"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs, drawn from a seed and its code point. A trigram of letters
(word edges count as a blank) binds its letters by multiplying their vectors, each rotated by its place.
The trigrams of a text are bundled by addition; so are those of all training texts of a language, which
makes its prototype. A text gets the language whose prototype has the largest cosine with its vector.

Bundles of prototypes are integer sums, so they do not depend on how Spark splits the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.llm.common import held_out, slices, table

DIMENSIONS = 1024
SEED = 20_111
#: Prototypes are sent to every task, so their number has a bound: 4096 of them have 16 MB.
MOST_LANGUAGES = 4096
#: A cosine below this can't be told from that of two unrelated vectors of 1024 signs (three deviations).
NOISE = 3 / DIMENSIONS**0.5
#: The letters of a text of which half the noise is asked: a short text's few trigrams prove little either way.
HALF = 200
BLANK = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(65536)
def _letter_vector(code_point: int, dimensions: int) -> np.ndarray:
    signs = np.random.default_rng([SEED, code_point]).integers(0, 2, dimensions, dtype=np.int8)
    return signs * np.int8(2) - np.int8(1)


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place in ``texts`` of every trigram, its number, and by number the three code points."""
    lowered = ["" if t is None else t.lower() for t in texts]
    points = np.frombuffer(("\0".join(lowered) + "\0").encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen & _letters())
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    code = place[points]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)  # one blank between words
    code, owner = np.concatenate([[0], code[keep], [0]]), owner[keep]
    base = len(alphabet) + 1
    middle = code[1:-1] != 0
    number = ((code[:-2] * base + code[1:-1]) * base + code[2:])[middle]
    owner = owner[middle]
    if base**3 <= 1 << 22:
        there = np.zeros(base**3, bool)
        there[number] = True
        distinct = np.flatnonzero(there)
        rank = np.zeros(base**3, np.int64)
        rank[distinct] = np.arange(len(distinct))
        number = rank[number]
    else:
        distinct, number = np.unique(number, return_inverse=True)
    points_of = np.concatenate([[BLANK], alphabet])
    grams = np.stack([points_of[distinct // base**2], points_of[distinct // base % base], points_of[distinct % base]], 1)
    return owner, number, grams


def _bound(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The vector of each trigram."""
    out = np.ones((len(grams), dimensions), np.int8)
    for k in range(3):
        points, which = np.unique(grams[:, k], return_inverse=True)
        vectors = [np.roll(_letter_vector(int(p), dimensions), 2 - k) for p in points]
        out *= np.stack(vectors)[which] if vectors else np.ones((0, dimensions), np.int8)
    return out


def bundles(texts: list[str | None], group: np.ndarray, n_groups: int, dimensions: int) -> np.ndarray:
    """The summed trigram vectors of the texts of each group, exact in float64."""
    owner, number, grams = _trigrams(texts)
    out = np.zeros((n_groups, dimensions))
    of = group[owner]
    for start in range(0, len(grams), 4096):  # a large alphabet has more trigrams than fit at once
        some = (number >= start) & (number < start + 4096)
        width = min(4096, len(grams) - start)
        counts = np.bincount(of[some] * width + (number[some] - start), minlength=n_groups * width)
        kind = np.float32 if counts.max(initial=0) < 1 << 14 and n_groups > 64 else np.float64
        out += counts.reshape(n_groups, width).astype(kind) @ _bound(grams[start : start + width], dimensions).astype(kind)
    return out


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages in order of name, and their prototypes as rows. Null texts and null languages teach nothing."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            done = 0
            for part in slices(batch.column(0)):
                names = batch.column(1).slice(done, len(part)).to_pylist()
                done += len(part)
                known = sorted(set(names))
                group = np.array([known.index(n) for n in names], np.int64)
                for name, row in zip(known, bundles(part.to_pylist(), group, len(known), dimensions), strict=True):
                    sums[name] = sums.get(name, 0) + row.astype(np.int64)
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(row)], ["lang", "place", "value"])

    rows = docs.select(F.col(text), F.col(lang)).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    summed = rows.mapInArrow(partial, "lang string, place int, value bigint").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    per_lang = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    found = sorted(per_lang.select("lang", F.col("v.value").alias("v")).limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang}")
    kept = [(name, np.array(v, np.float64)) for name, v in found if any(v)]
    return [name for name, _ in kept], np.array([v for _, v in kept]).reshape(len(kept), dimensions)


def predicted(text: Column, languages: list[str], rows: np.ndarray, dimensions: int = DIMENSIONS) -> Column:
    """struct(lang, score) of a text: ``und`` and 0 if it is null, has no letter, or nothing was learned."""
    unit = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)).T

    def score(texts: pa.Array) -> pa.Array:
        lang, best = [], []
        for part in slices(texts, 1_000_000):
            vectors = bundles(part.to_pylist(), np.arange(len(part)), len(part), dimensions)
            if not languages:
                lang += ["und"] * len(part)
                best += [0.0] * len(part)
                continue
            norm = np.linalg.norm(vectors, axis=1)
            cosine = vectors @ unit / np.maximum(norm, 1e-300)[:, None]
            top = cosine.argmax(1)
            lang += [languages[k] if n else "und" for k, n in zip(top, norm, strict=True)]
            best += np.where(norm > 0, np.clip(cosine[np.arange(len(top)), top], 0, 1), 0).tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(best, pa.float64())], ["lang", "score"])

    return F.arrow_udf(score, "lang string, score double")(text)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", into: str = "lang_id") -> DataFrame:
    """``docs`` with the struct column ``into`` (lang, score), learned from the rows that aren't held out.

    Null or letterless texts get ``und`` with score 0; so does every text if no row teaches a language.
    Repeated rows count each time in training and get equal results. Equal cosines go to the first name.
    A column that already has the name ``into`` is replaced.
    """
    names, rows = prototypes(docs.where(~held_out(doc_id)), text, lang)
    return docs.withColumn(into, predicted(F.col(text), names, rows))


def accepted(docs: DataFrame, least: float = NOISE, text: str = "text", half: int = HALF) -> DataFrame:
    """The rows in a recognised language: not ``und``, and a cosine above the noise of the vectors.

    The least cosine grows with the text, ``least * n / (n + half)`` for n characters: what a few trigrams say is weak
    evidence against a text, what thousands say is strong. Texts that are null or have no letter go. Where no row
    teaches a language nothing can be told from noise, and every text with a letter stays. Repeated rows have one
    fate; an empty table gives an empty one; columns of any name stay as they are.
    """
    own = "doctree_lang_id"
    names, rows = prototypes(docs.where(~held_out()), text)
    if not names:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    n = F.length(text)
    found = docs.withColumn(own, predicted(F.col(text), names, rows))
    return found.where((F.col(f"{own}.lang") != "und") & (F.col(f"{own}.score") >= F.lit(least) * n / (n + half))).drop(own)


def op9_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"))


QUERIES = {"op9_hyperdimensional_language_id": op9_hyperdimensional_language_id}
ORACLE_SQL: dict[str, str] = {}
