"""Benchmark decontamination by template canonicalisation.

Words are canonicalised: punctuation goes, letters are lowered, and numbers, names (capitalised words inside a sentence)
and units become typed placeholders. Every window of WINDOW template words is hash-joined with the benchmark's windows;
windows with too few literal words are no evidence. Hits of one item on one diagonal (place in the text less place in the
item) form an alignment, in which each slot of the item must always be filled by the same value: such an alignment is
a copy, or a re-parameterised copy if values differ. A document is contaminated if the windows of consistent
alignments cover enough of an item.
Beside them every window of the lowered words themselves is joined, whatever its literal words, and every item that
is shorter than a window as a whole: so a verbatim copy is found also of what templates leave out. A capitalised first word
of an item is indexed both as a word and as a name, since inside a sentence it would be taken for one.

Both sides are rows (hash of the window, its place, the values of its slots). A bitmap of a fixed size, of the benchmark's hashes,
keeps from the join what cannot meet a window of the benchmark; equal texts are joined once.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import WordCodes, bitmap_of, in_bitmap, low_bits, map_texts, mix64, text_slices, written

WINDOW, LEAST_LITERAL = 8, 5
#: Part of an item's words that consistent alignments must cover, or so many words in a row.
COVER, RUN = 0.5, 13
#: Contaminated texts, and items in them, up to which they are broadcast to the documents; more are joined by a shuffle.
BROADCAST_TEXTS = 100_000
#: Parts that the texts with one window are dealt to.
PARTS = 8

EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…–—¿¡°"
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?")
QUANTITY = re.compile(r"\d[\d.,]*([a-z]{1,4})")
# fixed values: units of measure and currency
UNITS = frozenset("mm cm m km mg g kg t ml cl l s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years inch inches ft feet foot yard yards mile miles lb lbs oz usd eur gbp dollar dollars euro euros pound pounds cent cents percent mph kmh hz khz mhz kb mb gb tb kw kwh v w a k c f meter meters metre metres gram grams kilogram kilograms liter liters litre litres".split())
LITERAL, NUM, NAME, UNIT = 0, 1, 2, 3
_TITLE, _ENDS, _SKIP = 4, 8, 16
_PLACES = np.array([0, 0x1111 << 8, 0x2222 << 8, 0x3333 << 8], dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _code(word: str) -> int:
    """64 bits: a hash of the lowered word above, its kind and the marks of its context below."""
    ends = _ENDS if word[-1:] in ".!?:…" or word == "\0" else 0
    bare = word if word.isalpha() else word.strip(EDGE)
    if word == "\0" or not bare:
        return _SKIP | ends
    low = bare.lower()
    h = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~0xFF
    if low in UNITS and len(low) > 1:
        return h | UNIT | ends
    if low.isalpha():
        return h | LITERAL | (_TITLE if bare[0].isupper() and bare[1:] == low[1:] else 0) | ends
    if NUMBER.fullmatch(low):
        return h | NUM | ends
    if (m := QUANTITY.fullmatch(low)) and m[1] in UNITS:
        return h | NUM | ends
    return h | LITERAL | (_TITLE if bare[0].isupper() and bare[1:] == bare[1:].lower() and bare[0].isalpha() else 0) | ends


_CODES = WordCodes(_code, 60_000)


class Templates:
    """Template words of several texts in a row: codes, kinds, hashes of the lowered words, owners, and places among the split words."""

    def __init__(self, texts: list[str | None]) -> None:
        self.words: list[str] = []
        sizes = []
        for t in texts:
            words = t.replace("\n", " \0 ").split() if t else []
            sizes.append(len(words))
            self.words += words
        raw = np.fromiter(map(_CODES.__getitem__, self.words), dtype=np.uint64, count=len(self.words))
        flags = (raw & np.uint64(0xFF)).astype(np.uint8)
        after_end = np.ones(len(raw), bool)
        after_end[1:] = (flags[:-1] & _ENDS) > 0
        cuts = np.cumsum([0, *sizes])
        after_end[cuts[:-1][np.diff(cuts) > 0]] = True
        kinds = flags & 3
        self.title = flags & _TITLE > 0
        kinds[self.title & ~after_end] = NAME
        keep = np.flatnonzero(flags & _SKIP == 0)
        self.at = keep
        self.title = self.title[keep]
        self.kinds = kinds[keep]
        self.exact = raw[keep] & ~np.uint64(0xFF)
        self.codes = np.where(self.kinds == LITERAL, self.exact, _PLACES[self.kinds])
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
        self.starts = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def hashes(self, codes: np.ndarray, sizes: list[int], exact: bool):
        """(n, places, hashes) of the windows of each size that lie within one text."""
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(sizes, default=0) + 1):
            if len(codes) < n:
                return
            h = h[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
            if n in sizes:
                inside = np.flatnonzero(self.owner[: len(h)] == self.owner[n - 1 :]) if n > 1 else np.arange(len(h))
                yield n, inside, mix64(h[inside] + np.uint64(2 * n + exact))

    def slots(self, place: int, n: int, kinds: np.ndarray | None = None) -> list[str]:
        """Kinds and values of the slots of a window, in order."""
        kinds = self.kinds[place : place + n] if kinds is None else kinds
        return [f"{kinds[i]}{self.words[self.at[place + i]].strip(EDGE).lower()}" for i in np.flatnonzero(kinds).tolist()]


_WINDOWS = "item long, it long, words int, n int, exact boolean, place int, h long, slots array<string>, at array<int>"


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows of all items as rows; ``it`` tells items of one id apart, ``at`` says where the slots stand in the item."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").alias("text")).where("item is not null and text is not null").distinct()
    rows = rows.withColumn("it", F.xxhash64("text"))

    def run(batches):
        names = [x.split()[0] for x in _WINDOWS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
        for batch in batches:
            for part in text_slices(batch, "text"):
                out: list[tuple] = []
                for item, it, text in zip(part.column("item").to_pylist(), part.column("it").to_pylist(), part.column("text").to_pylist(), strict=True):
                    t = Templates([text])
                    words = len(t.codes)
                    n = min(WINDOW, words)
                    if not n:
                        continue
                    for _, places, h in t.hashes(t.exact, [n], True):
                        out += [(item, it, words, n, True, p, x, [], []) for p, x in zip(places.tolist(), h.view(np.int64).tolist(), strict=True)]
                    forms = [(t.codes, t.kinds, range(words))]
                    if t.title[0] and t.kinds[0] == LITERAL:
                        kinds2, codes2 = t.kinds.copy(), t.codes.copy()
                        kinds2[0], codes2[0] = NAME, _PLACES[NAME]
                        forms.append((codes2, kinds2, range(1)))
                    for codes, kind, wanted in forms:
                        literal = kind == LITERAL
                        if n < 4 or literal.sum() < 3:
                            continue
                        for _, places, h in t.hashes(codes, [n], False):
                            for p, x in zip(places.tolist(), h.view(np.int64).tolist(), strict=True):
                                if p in wanted and literal[p : p + n].sum() >= min(LEAST_LITERAL, n):
                                    at = p + np.flatnonzero(kind[p : p + n])
                                    out.append((item, it, words, n, False, p, x, t.slots(p, n, kind[p : p + n]), at.tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return map_texts(rows, run, _WINDOWS)


def _text_windows(texts: DataFrame, bitmap: np.ndarray, sizes: tuple[list[int], list[int]]) -> DataFrame:
    """(t, u, n, exact, h, p, found) of the windows of each text whose hash is in the bitmap; ``found`` has the values of its slots."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(bitmap)

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.string())]
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = Templates(part.column("text").to_pylist())
                t, u = (part.column(c).to_numpy(zero_copy_only=False) for c in ("t", "u"))
                for exact, codes in ((False, w.codes), (True, w.exact)):
                    for n, places, h in w.hashes(codes, sizes[exact], exact):
                        hit = np.flatnonzero(in_bitmap(shared.value, h))
                        if len(hit):
                            p = places[hit]
                            own = w.owner[p]
                            found = [[] if exact else w.slots(i, n) for i in p.tolist()]
                            cols = [t[own], u[own], np.full(len(p), n), np.full(len(p), exact), h[hit].view(np.int64), p - w.starts[own], found]
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["t", "u", "n", "exact", "h", "p", "found"])

    return map_texts(texts, run, "t long, u long, n int, exact boolean, h long, p int, found array<string>")


def verdict(words: int, hits: list[tuple[int, int, int, bool, list[str], list[int], list[str]]]) -> tuple[int, bool] | None:
    """(covered words, whether slots were given other values) if the hits (shift, place, n, exact, slots, at, found) cover enough of an item."""
    cover: set[int] = set()
    other = False
    by_shift = defaultdict(list)
    for shift, place, n, exact, slots, at, found in hits:
        if exact:
            cover.update(range(place, place + n))
        else:
            by_shift[shift].append((place, n, slots, at, found))
    for windows in by_shift.values():
        values: dict[str, set[str]] = defaultdict(set)
        for _, _, slots, _, found in windows:
            for a, b in zip(slots, found, strict=False):
                values[a].add(b)
        if any(len(v) > 1 for v in values.values()):  # no substitution gives this text: only its literal windows count
            windows = [w for w in windows if not w[2]]
        else:
            other |= any(v != {k} for k, v in values.items())
        for place, n, *_ in windows:
            cover.update(range(place, place + n))
    run = longest = 0
    for j in range(words):
        run = run + 1 if j in cover else 0
        longest = max(longest, run)
    return (len(cover), other) if cover and (longest >= RUN or len(cover) >= COVER * words) else None


def _verdicts(joined: DataFrame) -> DataFrame:
    """(t, u, item, covered, other) of each text and item whose windows suffice. A group is the hits of one text and one item."""
    key = ["t", "u", "item", "it"]
    rows = joined.select(*key, "words", (F.col("p") - F.col("place")).alias("shift"), "place", "n", "exact", "slots", "at", "found")
    rows = rows.repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        def result(key, words, held):
            got = verdict(words, held)
            return [(*key[:3], *got)] if got else []

        last, words, held = None, 0, []
        for batch in batches:
            out = []
            for *now, w, shift, place, n, exact, slots, at, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != last:
                    out += result(last, words, held) if held else []
                    last, words, held = now, w, []
                held.append((shift, place, n, exact, slots, at, found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if out := result(last, words, held) if held else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names, kinds = ["t", "u", "item", "covered", "other"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return map_texts(rows, run, "t long, u long, item long, covered long, other boolean")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(t, u, item_ids, covered_words, reparameterised) for each contaminated text, named by two 64-bit hashes."""
    windows = written(item_windows(benchmark, item_col, item_text), "decontam-windows")
    sizes: tuple[list[int], list[int]] = ([], [])
    for r in windows.select("exact", "n").distinct().collect():  # 2 x WINDOW rows at most
        sizes[r.exact].append(r.n)
    text = F.col(f"`{text_col}`")
    texts = docs.select(text.alias("text"), *_names(text)).where("text is not null")
    hits = _text_windows(texts, bitmap_of(windows.select(low_bits(F.col("h")).alias("bit"))), sizes).dropDuplicates(["t", "u", "n", "exact", "h", "p"])
    # a window may be frequent in both tables: the texts' side is dealt to parts, each with a copy of the benchmark's
    dealt = hits.withColumn("part", F.pmod(F.col("t"), F.lit(PARTS)).cast("int"))
    windows = windows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    found = _verdicts(dealt.join(windows, ["n", "exact", "h", "part"]))
    out = found.groupBy("t", "u").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("covered").alias("covered_words"), F.max("other").alias("reparameterised"))
    return written(out, "decontam-texts")


def _names(text):
    return F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u")


def _joined(docs: DataFrame, found: DataFrame, text_col: str, how: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    rows, items = found.agg(F.count(F.lit(1)), F.sum(F.size("item_ids"))).first()
    found = found.withColumnsRenamed({c: f"__{c}" for c in found.columns})
    if max(rows, items or 0) <= BROADCAST_TEXTS:
        found = F.broadcast(found)
    return docs.join(found, (F.xxhash64(text) == F.col("__t")) & (F.xxhash64(F.lit(1), text) == F.col("__u")), how)


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds ``contaminated``, ``item_ids`` (ascending), ``covered_words`` (of the best item) and ``reparameterised`` to every row.

    All rows and other columns stay, columns named like a new one are replaced. A null or empty text is clean, as is every
    text if the benchmark is empty. Items with a null id or text, or without a word, are left out; those with
    fewer than four words or three literal ones are found verbatim only. Equal items under several ids are all reported.
    Repeated texts get the same verdict. A very long text is handled whole, by itself, in some 60 bytes a word.
    """
    new = ["contaminated", "item_ids", "covered_words", "reparameterised"]
    docs = docs.drop(*[c for c in new if c != text_col])
    rows = _joined(docs, contaminated_texts(docs, benchmark, text_col, item_col, item_text), text_col, "left")
    hit = F.col("__t").isNotNull()
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        hit.alias("contaminated"),
        F.coalesce("__item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("__covered_words", F.lit(0)).cast("long").alias("covered_words"),
        F.coalesce("__reparameterised", F.lit(False)).alias("reparameterised"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    return _joined(docs, contaminated_texts(docs, benchmark, text_col, item_col, item_text), text_col, "left_anti")
