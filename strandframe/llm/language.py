"""Operator 10: language identification by bit-sliced Bloom filters over byte n-grams.

One table of slots serves all languages: a slot holds a bit mask of languages, in as many 64-bit words as these need, and the
AND of the slots that an n-gram hashes to is the mask of all languages whose filter may hold it. A text is scored by counting, per language, the n-grams whose
masks have that language's bit; the counts are corrected for the filter's false positive rate (the filling of that
language's bit slice to the power of the number of hash functions), and the largest corrected count decides.

The n-grams of a language are those that occur in at least SHARE of its learning documents and not at a far lower rate
than in the language that uses them most. Rates are taken over all learning documents, by partial sums. What is learned does
not grow with the corpus: a language has at most 1 / SHARE times as many n-grams as its documents have on the mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_of, table, without
from .tokens import U, mixed, small

#: Bytes of an n-gram; runs of anything but letters count as one blank, and a text starts and ends with one.
GRAM = 4
#: An n-gram belongs to a language if it is in at least this share of its documents ...
SHARE = 0.002
#: ... and at least at this part of the rate at which the language that uses it most has it.
RATIO = 0.2
#: Hash functions, and slots for each n-gram (as a power of two at least).
HASHES = 3
ROOM = 12
#: Languages of one word of a mask.
WORD_BITS = 64
UNKNOWN = "und"
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def byte_grams(text: str | None) -> np.ndarray:
    """The text's n-grams as numbers, with repeats; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not plain:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(f" {plain} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        b = np.concatenate([b, np.full(GRAM - len(b), 32, np.uint32)])
    n = len(b) - GRAM + 1
    out = b[:n].copy()
    for j in range(1, GRAM):
        out = (out << np.uint32(8)) | b[j : j + n]
    return out


def held_out(key) -> F.Column:
    """Whether a key is kept from learning: crc32 of it as text, modulo 5, is 0; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def gram_counts(docs: DataFrame, text: str, lang: str, weight_chars: int = 1 << 16) -> DataFrame:
    """(lang, gram, n): the number of documents with that n-gram; gram -1 counts documents. Summed per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(name, []).append(np.unique(byte_grams(t)).astype(np.int64))
            for name, parts in found.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                g, n = np.append(g, -1), np.append(n, len(parts))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return docs.select(text, lang).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilters:
    """The learned table: languages in code point order, one array of slots for each word of a mask, and each language's filling."""

    def __init__(self, langs: list[str], slots: list[np.ndarray]):
        self.langs, self.slots = langs, slots
        wrong = [np.count_nonzero(slots[i // WORD_BITS] & U(1 << i % WORD_BITS)) / len(slots[i // WORD_BITS]) for i in range(len(langs))]
        self.wrong = np.array(wrong) ** HASHES

    @staticmethod
    def places(grams: np.ndarray, size: int) -> np.ndarray:
        x = grams.astype(U)
        return np.stack([mixed(x * U(_ODD[i]) + U(i)) & U(size - 1) for i in range(HASHES)])

    @classmethod
    def build(cls, langs: list[str], grams: np.ndarray, masks: list[np.ndarray]) -> LanguageFilters:
        """From distinct n-grams and, for each word of a mask, their bits."""
        size = 1 << max(10, (len(grams) * ROOM).bit_length())
        slots = [np.zeros(size, U) for _ in masks]
        for at in cls.places(grams, size):
            for s, m in zip(slots, masks, strict=True):
                np.bitwise_or.at(s, at, m)
        return cls(langs, slots)

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, all languages that may contain it, by words of the mask."""
        out = []
        at = self.places(grams, len(self.slots[0])) if self.slots else ()
        for s in self.slots:
            got = s[at[0]]
            for i in range(1, HASHES):
                got &= s[at[i]]
            out.append(got)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its score: the corrected share of the text's n-grams in it, of that share over all languages' shares where several hold them."""
        grams = byte_grams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        got = self.masks(grams)
        if len(self.langs) <= 8:
            of = np.bincount(got[0].astype(np.uint8), minlength=256)
            counts = np.array([of[_HAS[i]].sum() for i in range(len(self.langs))], float)
        else:
            counts = np.array([np.count_nonzero(got[i // WORD_BITS] & U(1 << i % WORD_BITS)) for i in range(len(self.langs))], float)
        share = np.clip((counts / len(grams) - self.wrong) / (1 - self.wrong + 1e-12), 0, 1)
        best = int(np.argmax(share))
        return self.langs[best], float(share[best])


_HAS = [np.flatnonzero((np.arange(256) >> i) & 1) for i in range(8)]


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageFilters:
    """Learns from all rows with a text, a language and a key that is not held out; rows that repeat count as often.

    What comes to the driver is one row per language and one per n-gram that some language keeps. An n-gram counts from two
    documents on, or from one if its language has no more. An empty table gives a model without languages.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    counts = gram_counts(usable, text, lang).persist()
    sizes = {r["lang"]: r["n"] for r in counts.filter("gram = -1").collect()}
    langs = sorted(sizes)
    if not langs:
        counts.unpersist()
        return LanguageFilters([], [])
    known = docs.sparkSession.createDataFrame([(name, i, sizes[name]) for i, name in enumerate(langs)], "lang string, i int, size long")
    rates = counts.filter("gram >= 0").join(known, "lang").withColumn("rate", F.col("n") / F.col("size")).filter((F.col("rate") >= SHARE) & (F.col("n") >= F.least(F.lit(2), "size")))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("rate", "i")).alias("all"))
    of = F.transform(F.filter("all", lambda x: x["rate"] >= F.col("top") * RATIO), lambda x: x["i"])
    kept = top.select("gram", of.alias("of")).toArrow()
    counts.unpersist()
    grams, n = kept.column("gram").to_numpy(), kept.column("of").combine_chunks().value_lengths().to_numpy()
    at, which = np.repeat(np.arange(len(grams)), n), kept.column("of").combine_chunks().flatten().to_numpy()
    masks = [np.zeros(len(grams), U) for _ in range(-(-len(langs) // WORD_BITS))]
    for w, m in enumerate(masks):
        here = which // WORD_BITS == w
        np.bitwise_or.at(m, at[here], np.left_shift(U(1), (which[here] % WORD_BITS).astype(U)))
    return LanguageFilters.build(langs, grams, masks)


def identify(docs: DataFrame, model: LanguageFilters, *, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) from the text alone: 'und' with 0 for a null text or one without a letter.

    Works row by row on whole texts; rows that repeat come out alike, ties go to the language first in code point order. Other columns pass
    through; columns of the added names are replaced.
    """
    docs = without(docs, "lang_pred", "score")
    p = clear_of(docs.columns, "p")["p"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in s], columns=["lang_pred", "score"])

    return docs.withColumn(p, predict(F.col(text))).select(*docs.columns, f"{p}.lang_pred", f"{p}.score")


def op10_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
