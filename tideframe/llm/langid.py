"""Language identification with language-bitmask n-gram filters.

Training counts letter n-grams per language over a bounded sample of labelled rows and keeps each language's most
frequent ones. They go into a bit-sliced Bloom filter: one array of bitmasks, bit L for language L, so that the
conjunction of a few probes returns at once all languages that hold an n-gram. A text's n-grams are looked
up, the bits are counted per language and corrected by each language's false-positive rate; the
largest corrected count decides.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import map_texts, mix64, text_slices

#: Bound of the training sample: documents of each language, and languages (bits of a mask).
SAMPLE_PER_LANG, MAX_LANGS = 1500, 64
#: Bytes of text whose n-grams are held at once: some 150 bytes each.
SLICE = 250_000
SIZES = (3, 4)
#: n-grams kept of each language, and the smallest share of the language's n-grams that one must make up.
KEEP, LEAST_SHARE = 40_000, 4e-6
PROBES, BITS = 3, 20

_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _ALPHA


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all letter n-grams of the texts, the index of the text that each is from, and the letters of each text.

    Texts are lower-cased; a run of characters that are no letters counts as one space; each text has one at either end.
    """
    low = [f" {t.lower()} " if t else " " for t in texts]
    sizes = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    letter = _alpha()[codes]
    letters = np.bincount(at[letter], minlength=len(low))
    first = np.zeros(len(codes), dtype=bool)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    keep = letter | first
    keep[1:] |= letter[:-1]
    codes, at = np.where(letter, codes, 32)[keep].astype(np.uint64), at[keep]
    hashes, owners = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        inside = at[:m] == at[n - 1 :]
        h = np.full(m, n, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + codes[i : m + i]
        hashes.append(mix64(h[inside]))
        owners.append(at[:m][inside])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), letters
    return np.concatenate(hashes), np.concatenate(owners), letters


def _probes(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(BITS * i)) & np.uint64((1 << BITS) - 1) for i in range(PROBES)]


@dataclass
class Model:
    """The languages in order, the bit-sliced filter, and each language's false-positive rate."""

    langs: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> Model:
        langs = sorted(grams)
        kind = next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(langs) <= n)
        masks = np.zeros(1 << BITS, dtype=kind)
        for i, lang in enumerate(langs):
            for p in _probes(grams[lang].astype(np.uint64)):
                masks[p] |= kind(1 << i)
        fill = np.array([np.mean((masks >> kind(i)) & kind(1)) for i in range(len(langs))])
        return cls(langs, masks, fill**PROBES)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (the corrected share of n-grams that the language holds) of each text."""
        h, at, letters = grams_of(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total = np.bincount(at, minlength=len(texts)).astype(float)
        probes = _probes(h)
        mask = self.masks[probes[0]]
        for p in probes[1:]:
            mask &= self.masks[p]
        hits = np.stack([np.bincount(at[(mask >> mask.dtype.type(i)) & mask.dtype.type(1) != 0], minlength=len(texts)) for i in range(len(self.langs))], axis=1)
        right = np.maximum(0.0, (hits - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        best = right.argmax(axis=1)
        score = np.where(letters > 0, right[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
        names = [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)]
        return names, np.clip(score, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learns from a sample of at most about ``per_lang`` documents of each language that are not held out.

    The sample is the rows whose id hash is under a language's share, so no language is gathered in one task. Rows with a
    null text, language or id are not used. Without any row to learn from the model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null")
    rows = rows.where(~held_out(F.col("id")))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Model.build({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                texts, langs = part.column("text").to_pylist(), np.array(part.column("lang").to_pylist(), dtype=object)
                h, at, _ = grams_of(texts)
                for lang in dict.fromkeys(langs):
                    g, n = np.unique(h[(langs == lang)[at]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    grams = map_texts(sample.select("text", "lang"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("total", F.sum("n").over(_by_lang())).where(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * LEAST_SHARE))
    # the sample bounds the rows here, and KEEP those that the driver gets
    top = grams.withColumn("k", F.row_number().over(_by_lang().orderBy(F.desc("n"), "gram"))).where(F.col("k") <= KEEP).select("lang", "gram").toPandas()
    return Model.build({lang: g.gram.to_numpy().view(np.uint64) for lang, g in top.groupby("lang")})


def _by_lang():
    from pyspark.sql import Window

    return Window.partitionBy("lang")


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and its score to every row; all rows and other columns stay.

    A null or empty text, or one without a letter, is ``und`` with score 0. Columns named like the new ones are replaced.
    A text longer than SLICE is handled whole, by itself.
    """
    from pyspark.sql import types as T

    docs = docs.drop(*[c for c in (lang_out, score_out) if c != text_col])
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, text_col, SLICE):
                langs, scores = shared.value.predict(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, lang_out, score_out])

    return map_texts(docs, run, schema)
