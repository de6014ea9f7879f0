"""Removal of long repeated byte strings, with a run-length compressed index for the partial matches.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. To find these strings
without an index of the whole corpus in one place:

1. Documents are packed into blocks, written once in the shared folder.
2. Of every window of LENGTH bytes the K-byte string with the least hash is an anchor: equal windows have equal anchors, and
   about one byte in 16 is one. Blocks send, for each bucket of anchor hashes, their distinct anchors with a hash
   of the context (all windows around the anchor) and the smallest document.
3. A bucket answers with two bits for each: whether a smaller document has the whole context (then all its windows go), and
   whether this document is the first with the context while the anchor has others (then windows may match in part).
4. First contexts are cut into the windows that reach far to the left and those that reach far to the right of the anchor,
   and meet by the hash of that longer string. Of each meeting with several documents a run-length compressed
   Burrows-Wheeler index with sampled documents is built (:mod:`rlindex`), the contexts are streamed against it, and the windows
   that a smaller document holds come back as bit masks.
5. Blocks apply the answers.

A whole context is known by 32 bits and the bucket of its anchor and 64 bits of its own hash, which holds its length and the
anchor's place: two contexts of one anchor that agree in all would be taken for one. All else is compared byte by byte in
the index.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import map_texts, mix64, powers, release, written
from tideframe.llm.rlindex import LENGTH, RunLengthIndex

K = 20
#: Anchors among the windows' places; what a window reaches beyond one on the farther side at least.
W, REACH = LENGTH - K + 1, (LENGTH - K) // 2
#: Text of a block and of a bucket; buckets of contexts for each bucket of anchors, so that an index stays small.
BLOCK_BYTES, BUCKET_BYTES, FRAGMENTS = 4_000_000, 32_000_000, 8
_ODD = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte plane by byte plane, compressed."""
    import zstandard

    out = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [np.array([len(a), a.dtype.itemsize], "<i8").tobytes(), a.dtype.str.encode().ljust(8), np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def _unzip(data: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(data)
    out, at = [], 8
    for _ in range(int(np.frombuffer(data, "<i8", 1)[0])):
        n, size = np.frombuffer(data, "<i8", 2, at).tolist()
        kind, at = data[at + 16 : at + 24].decode().strip(), at + 24
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


class Block:
    """Documents of a block by ascending id (without an id: last), their bytes in a row, and the anchors."""

    def __init__(self, payload: bytes) -> None:
        self.ids, self.null, sizes, self.data = _unzip(payload)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    @staticmethod
    def pack(ids: list[int | None], texts: list[bytes]) -> bytes:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        return _zip(np.array([ids[i] or 0 for i in order], np.int64), np.array([ids[i] is None for i in order], np.uint8), np.array([len(texts[i]) for i in order], np.int64), data)

    def find_anchors(self, buckets: int) -> Block:
        """Sets, for each anchor, its place, document and context; and the groups of equal (bucket, anchor, context)."""
        n = len(self.data)
        power, inverse = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * power[:n], out=sums[1:])
        self._sums, self._inverse = sums, inverse
        m = max(0, n - K + 1)
        # the order of anchors is that of 32 bits of their hashes
        h = sums[K : K + m] - sums[:m]
        h *= inverse[:m]
        h *= _ODD
        h = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        low = self._extreme(h, np.minimum)[: max(0, n - LENGTH + 1)].copy()
        late = np.maximum(self.ends[:, None] - np.arange(1, LENGTH), self.starts[:, None]).ravel()
        low[late[late < len(low)]] = 0  # windows that would pass the end of their document
        for d in np.flatnonzero(self.null):
            low[self.starts[d] : self.ends[d]] = 0
        # a place is an anchor if some window around it has its hash as the least
        rim = np.zeros(W - 1, np.uint32)
        top = self._extreme(np.concatenate((rim, low, rim)), np.maximum)
        self.at = at = np.flatnonzero(top[:m] == h) if len(low) else np.zeros(0, np.int64)
        self.doc = doc = np.searchsorted(self.ends, at, side="right")
        self.lo = lo = np.maximum(self.starts[doc], at - (LENGTH - K))
        self.hi = hi = np.minimum(self.ends[doc], at + LENGTH)
        anchor = self._hash(at, at + K, np.uint64(7))
        context = self._hash(lo, hi, (at - lo).astype(np.uint64) * np.uint64(256) + (hi - lo).astype(np.uint64))
        bucket = (anchor >> np.uint64(32)) % np.uint64(buckets)
        key = bucket << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))
        order = np.lexsort((context, key))  # places ascend, so documents do within a group
        key, context = key[order], context[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1]))) if len(order) else np.zeros(0, bool)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.lead = order[new]  # the anchor of the smallest document of each group
        self.key, self.context = key[new], context[new]
        self.first = self.ids[doc[self.lead]] if len(order) else np.zeros(0, np.int64)
        self.cuts = np.searchsorted(self.key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        return self

    @staticmethod
    def _extreme(x: np.ndarray, f) -> np.ndarray:
        """The least or largest of every W neighbours, by doubling spans."""
        span = 1
        while span * 2 <= W:
            x = f(x[: len(x) - span], x[span:]) if len(x) > span else x[:0]
            span *= 2
        rest = W - span
        return f(x[: len(x) - rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]

    def _hash(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
        return mix64((self._sums[b] - self._sums[a]) * self._inverse[a] + mix64(np.atleast_1d(np.asarray(salt, np.uint64)) + _ODD))

    def questions(self):
        """(bucket, its groups packed) for each bucket that the block has anchors of."""
        for b in np.flatnonzero(self.cuts[1:] > self.cuts[:-1]).tolist():
            s = slice(self.cuts[b], self.cuts[b + 1])
            step = np.diff(self.key[s] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype(np.uint32)
            c = self.context[s]
            yield b, _zip(step, c.astype(np.uint32), (c >> np.uint64(32)).astype(np.uint32), self.first[s] - self.first[s].min(), self.first[s].min(keepdims=True))

    def answers(self, notes: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(whole, first, masks) from the notes (kind, bucket, data): two bits for each group, and (group, mask) pairs."""
        whole, first = np.zeros(len(self.key), bool), np.zeros(len(self.key), bool)
        masks = []
        for kind, b, data in notes:
            if kind == 0:
                a, z = int(self.cuts[b]), int(self.cuts[b + 1])
                bits = _unzip(data)
                whole[a:z], first[a:z] = (np.unpackbits(x, count=z - a).astype(bool) for x in bits)
            else:
                masks.append(_unzip(data))
        return whole, first, masks

    def fragments(self, first: np.ndarray):
        """Of each group in ``first``: the windows reaching REACH to the left, and those reaching so far to the right."""
        g = np.flatnonzero(first)
        lead = self.lead[g]
        p, lo, hi = self.at[lead], self.lo[lead], self.hi[lead]
        out = []
        for a, b, x, y, salt in ((lo, np.minimum(hi, p + K + REACH), p - REACH, p + K, 1), (np.maximum(lo, p - REACH), hi, p, p + K + REACH, 2)):
            ok = (b - a >= LENGTH) & (x >= lo) & (y <= hi)
            out.append((self._hash(x[ok], y[ok], np.uint64(salt)), g[ok], self.first[g[ok]], (a - lo)[ok], a[ok], b[ok]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def covered(self, whole: np.ndarray, masks: list) -> np.ndarray:
        """Whether each byte goes."""
        change = np.zeros(len(self.data) + 1, np.int32)
        own = self.ids[self.doc] if len(self.at) else np.zeros(0, np.int64)
        gone = whole[self.group] | (own > self.first[self.group]) if len(self.at) else np.zeros(0, bool)
        np.add.at(change, self.lo[gone], 1)
        np.add.at(change, self.hi[gone], -1)
        if masks:
            every = np.zeros(len(self.key), np.uint32)
            for g, mask in masks:
                np.bitwise_or.at(every, g, mask)
            rest = np.flatnonzero(~gone & (every[self.group] > 0))
            m, lo = every[self.group[rest]], self.lo[rest]
            for bit in range(W):
                s = lo[(m >> np.uint32(bit)) & np.uint32(1) == 1] + bit
                np.add.at(change, s, 1)
                np.add.at(change, s + LENGTH, -1)
        return np.cumsum(change[:-1]) > 0


def _pack(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([size], pa.int64()), pa.array([Block.pack(ids, texts)], pa.binary())], ["block", "size", "payload"])

        for batch in batches:
            for i, t in zip(batch.column("id"), batch.column("text"), strict=True):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if ids and size + len(t) > BLOCK_BYTES:
                    yield out()
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(i.as_py())
                texts.append(t)
                size += len(t)
        if ids:
            yield out()

    return map_texts(docs, run, "block long, size long, payload binary")


def _ask(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                got = list(Block(payload.as_py()).find_anchors(buckets).questions())
                if got:
                    b, data = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([block] * len(b), pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "data"])

    return map_texts(blocks, run, "bucket long, block long, data binary")


def _bits(table):
    """Answers of one bucket to all blocks."""
    import pyarrow as pa

    blocks = table.column("block").to_pylist()
    parts = []
    for d in table.column("data").to_pylist():
        step, low, high, first, base = _unzip(d)
        parts.append((np.cumsum(step.astype(np.uint64)), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), first + base[0]))
    sizes = [len(p[0]) for p in parts]
    anchor, context, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((first, context, anchor))
    a, c, f = anchor[order], context[order], first[order]
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new_c = new_a | np.concatenate(([True], c[1:] != c[:-1]))
    at_c = np.flatnonzero(new_c)
    least = f[at_c]  # first document of each context
    of_c = np.cumsum(new_c) - 1
    at_a = np.flatnonzero(new_a[at_c])
    several = (np.minimum.reduceat(least, at_a) != np.maximum.reduceat(least, at_a))[np.cumsum(new_a[at_c]) - 1]
    whole, lead = np.empty(len(a), bool), np.empty(len(a), bool)
    whole[order] = least[of_c] < f
    lead[order] = (least[of_c] == f) & several[of_c]
    out, at = [], 0
    for n in sizes:
        out.append(_zip(np.packbits(whole[at : at + n]), np.packbits(lead[at : at + n])))
        at += n
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"block": pa.array(blocks, pa.int64()), "kind": pa.array([0] * len(out), pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int64()), "data": pa.array(out, pa.binary())})


_NOTE = "block long, kind int, bucket long, data binary"


def _fragments(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, data): the first contexts that may match in part, by the bucket of their longer string."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, payload, notes in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("notes").to_pylist(), strict=True):
                b = Block(payload.as_py()).find_anchors(buckets)
                key, g, first, shift, lo, hi = b.fragments(b.answers([(0, x["bucket"], x["data"]) for x in notes])[1])
                to = key % np.uint64(buckets * FRAGMENTS)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets * FRAGMENTS + 1, dtype=np.uint64))
                rows = []
                for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    s = order[cuts[k] : cuts[k + 1]]
                    n = hi[s] - lo[s]
                    text = b.data[np.repeat(lo[s] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    rows.append((k, block, _zip(key[s], g[s].astype(np.uint32), first[s], shift[s].astype(np.uint8), n.astype(np.uint8), text)))
                if rows:
                    k, block_, data = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(block_, pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "data"])

    return map_texts(blocks, run, "bucket long, block long, data binary")


def _masks(table):
    """Windows of one bucket's contexts that a smaller document holds, as bit masks for their blocks."""
    import pyarrow as pa

    blocks, parts = table.column("block").to_pylist(), []
    for k, d in enumerate(table.column("data").to_pylist()):
        key, g, first, shift, n, text = _unzip(d)
        parts.append((key, g, first, shift, n, np.full(len(key), k), text))
    key, g, first, shift, n, owner, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    end = np.cumsum(n.astype(np.int64))
    order = np.lexsort((first, key))
    k, f = key[order], first[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    sizes = np.diff(np.append(new, len(k)))
    met = np.sort(order[np.repeat(np.minimum.reduceat(f, new) != np.maximum.reduceat(f, new), sizes)])
    out = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("data", pa.binary())])
    if not len(met):
        return out.empty_table()
    met = met[np.argsort(first[met], kind="stable")]
    raw, ids = text.tobytes(), first[met]
    # equal texts are indexed once, under their smallest document
    unique: dict[bytes, int] = {}
    same = np.array([unique.setdefault(raw[e - m : e], len(unique)) for e, m in zip(end[met].tolist(), n[met].tolist(), strict=True)])
    texts = list(unique)
    lead = ids[np.unique(same, return_index=True)[1]]
    which, place, least = RunLengthIndex(texts, lead).least_documents(texts)
    # smallest document of each window of each text; then every context of that text is held against it
    held = np.full((len(texts), W), np.iinfo(np.int64).max)
    held[which, place] = least
    bits = (held[same] < ids[:, None]) @ (np.uint64(1) << np.arange(W, dtype=np.uint64))
    mask = np.zeros(len(key), np.uint32)
    mask[met] = (bits << shift[met].astype(np.uint64)).astype(np.uint32)
    rows = []
    for i in np.unique(owner[mask > 0]).tolist():
        s = np.flatnonzero((owner == i) & (mask > 0))
        rows.append({"block": blocks[i], "kind": 1, "bucket": 0, "data": _zip(g[s], mask[s])})
    return pa.Table.from_pylist(rows, schema=out)


def _noted(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    by = notes.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("notes"))
    return blocks.select("block", "payload").join(by, "block", "left").select("block", "payload", F.coalesce("notes", F.array().cast("array<struct<kind:int,bucket:bigint,data:binary>>")).alias("notes"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``; with ``kept`` also the bytes.

    A null text is empty. Rows with a null id are kept whole and take nothing from others. Of rows with equal ids none is
    smaller, so they take nothing from each other. Texts under LENGTH bytes lose nothing. Other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    blocks = written(_pack(docs), "repeats-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    bits = written(_ask(blocks, buckets).groupBy("bucket").applyInArrow(_bits, _NOTE), "repeats-bits")
    release(docs.sparkSession)
    pieces = _fragments(_noted(blocks, bits), buckets)
    masks = written(pieces.groupBy("bucket").applyInArrow(_masks, _NOTE), "repeats-masks")
    release(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for payload, notes in zip(batch.column("payload"), batch.column("notes").to_pylist(), strict=True):
                b = Block(payload.as_py()).find_anchors(buckets)
                whole, _, got = b.answers([(x["kind"], x["bucket"], x["data"]) for x in notes])
                gone = b.covered(whole, got)
                left = np.concatenate(([0], np.cumsum(~gone)))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = b.starts[b.starts < b.ends]
                begins[heads] = gone[heads]
                spans = np.concatenate(([0], np.cumsum(begins)))
                rest = b.data[~gone].tobytes()
                texts = [rest[x:y] for x, y in zip(left[b.starts].tolist(), left[b.ends].tolist(), strict=True)]
                size = b.ends - b.starts
                cols = [
                    pa.array(b.ids, mask=b.null == 1),
                    pa.array(size),
                    pa.array(size - (left[b.ends] - left[b.starts])),
                    pa.array(spans[b.ends] - spans[b.starts]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                if kept:
                    cols.append(pa.array(texts, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept)

    return map_texts(_noted(blocks, bits.unionByName(masks)), run, schema)
