"""Token ids in directly addressable binary files.

Ids are split into 8-bit chunks, one array per level; a bitmap per level says which ids go on at the next level, and a
rank directory over the bitmap gives the place there. Any token is read by one array access and a rank for each level,
without decoding a block. A file is a row of segments of SEGMENT tokens, each encoded by itself (so writing
needs the memory of one segment, however long a document is), followed by the documents' ids and starts.

File: MAGIC; segments; int64 segment offsets; int64 doc ids; uint8 doc id is null; int64 doc starts (one more than
documents); int64 x 3: segments, documents, place of the segment offsets; MAGIC. All numbers are little-endian.
Segment: int64 count of levels, then per level: int64 chunks, the chunks (padded to 8 bytes), the bitmap (uint64 words),
the rank directory (int64, one entry for each RANK bits).
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import fresh_path, map_texts, n_partitions, text_slices

MAGIC = b"TIDEDAC1"
SEGMENT, RANK = 1 << 20, 512
END_ID = 2


def encode_segment(ids: np.ndarray) -> bytes:
    """The directly addressable form of an array of uint32 ids."""
    out, level, rest = [], 0, np.ascontiguousarray(ids, dtype=np.uint32)
    while level == 0 or len(rest):
        more = rest >> 8
        go = more > 0
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        words = np.zeros((len(rest) + 63) // 64 + 1, dtype=np.uint64)
        packed = np.packbits(go, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        ranks = ones[: len(words) : RANK // 64]
        out += [np.int64(len(rest)).tobytes(), chunks, b"\0" * (-len(chunks) % 8), words.tobytes(), np.ascontiguousarray(ranks).tobytes()]
        rest, level = more[go], level + 1
    return np.int64(level).tobytes() + b"".join(out)


class Segment:
    """Reads an encoded segment; nothing is decoded until asked for."""

    def __init__(self, data: bytes) -> None:
        self.levels, at = [], 8
        for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
            n = int(np.frombuffer(data, np.int64, 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            words = np.frombuffer(data, np.uint64, (n + 63) // 64 + 1, at)
            at += words.nbytes
            ranks = np.frombuffer(data, np.int64, -(-len(words) // (RANK // 64)), at)
            at += ranks.nbytes
            self.levels.append((chunks, words, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The token at place i: a chunk and a rank for each level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunks, words, ranks in self.levels:
            value |= int(chunks[i]) << shift
            w, b = divmod(i, 64)
            if not int(words[w]) >> b & 1:
                return value
            r, first = int(ranks[i // RANK]), i // RANK * (RANK // 64)
            r += int(np.bitwise_count(words[first:w]).sum()) + (int(words[w]) & (1 << b) - 1).bit_count()
            i, shift = r, shift + 8
        return value

    def all(self) -> np.ndarray:
        value = None
        for chunks, words, _ in reversed(self.levels):
            low = chunks.astype(np.uint32)
            if value is not None and len(value):
                go = np.unpackbits(words.view(np.uint8), count=len(chunks), bitorder="little").astype(bool)
                low[go] |= value << np.uint32(8)
            value = low
        return value


class FileWriter:
    """Writes documents of ids into one file, segment by segment."""

    def __init__(self, stream) -> None:
        self.out, self.at, self.offsets, self.rest, self.held = stream, 0, [], [], 0
        self.ids, self.null, self.starts = [], [], [0]
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _segment(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self._put(encode_segment(ids))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= SEGMENT:
            whole = np.concatenate(self.rest)
            cut = len(whole) // SEGMENT * SEGMENT
            for i in range(0, cut, SEGMENT):
                self._segment(whole[i : i + SEGMENT])
            self.rest, self.held = [whole[cut:]], len(whole) - cut

    def close(self) -> tuple[int, int]:
        """(tokens, documents)"""
        if self.held:
            self._segment(np.concatenate(self.rest))
        place = self.at
        self._put(np.array(self.offsets, dtype=np.int64).tobytes() + np.array(self.ids, dtype=np.int64).tobytes() + np.array(self.null, dtype=np.uint8).tobytes() + np.array(self.starts, dtype=np.int64).tobytes())
        self._put(np.array([len(self.offsets), len(self.ids), place], dtype=np.int64).tobytes() + MAGIC)
        return self.starts[-1], len(self.ids)


class FileReader:
    """Reads a file through a stream that can seek; holds one segment at a time."""

    def __init__(self, stream) -> None:
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        tail = self._read(size - 32, 32)
        if tail[24:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        n, docs, place = np.frombuffer(tail, np.int64, 3).tolist()
        data = self._read(place, 8 * n + 9 * docs + 8 * (docs + 1))
        self.offsets = [*np.frombuffer(data, np.int64, n).tolist(), place]
        self.ids = np.frombuffer(data, np.int64, docs, 8 * n)
        self.null = np.frombuffer(data, np.uint8, docs, 8 * n + 8 * docs)
        self.starts = np.frombuffer(data, np.int64, docs + 1, 8 * n + 9 * docs)
        self.held: tuple[int, Segment | None] = (-1, None)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def segment(self, k: int) -> Segment:
        if self.held[0] != k:
            self.held = (k, Segment(self._read(self.offsets[k], self.offsets[k + 1] - self.offsets[k])))
        return self.held[1]

    def token(self, i: int) -> int:
        return self.segment(i // SEGMENT)[i % SEGMENT]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc id, start in the file, tokens, crc32 of the ids) of each document, from one pass over the segments."""
        k, ids = -1, np.zeros(0, dtype="<u4")
        for d in range(len(self.ids)):
            at, end, crc = int(self.starts[d]), int(self.starts[d + 1]), 0
            while at < end:
                if at // SEGMENT != k:
                    k = at // SEGMENT
                    ids = self.segment(k).all().astype("<u4")
                upto = min(end, (k + 1) * SEGMENT)
                crc = zlib.crc32(ids[at - k * SEGMENT : upto - k * SEGMENT].tobytes(), crc)
                at = upto
            yield (None if self.null[d] else int(self.ids[d])), int(self.starts[d]), end - int(self.starts[d]), crc


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct piece once.

    Byte-level pre-tokenisation always cuts between a space and the characters around it when neither is white space,
    around a line end between such characters, and between a letter and a run of marks that no apostrophe begins; so
    a text's ids are those of its pieces in a row. A piece has the space before it, or BARE where there is none. Words of
    plain letters go straight to the library's model, other pieces through the whole tokenizer; they are remembered, up to
    ``most``. Where white space meets white space, the pieces around it are joined and encoded as one. A text that holds
    BARE or a special token's string, and any text for a tokenizer of another kind, is encoded whole.
    """

    BARE = "\x01"
    LINE = BARE + "\n"
    MARKS = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)(?=[ \n])")
    _held: dict[str, Encoder] = {}

    def __init__(self, path: str, most: int = 400_000) -> None:
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made["pre_tokenizer"] or {}
        self.byte_level = made["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex") and made["model"]["type"] == "BPE"
        self.letters = "".join(c for _, c in sorted(_byte_letters().items()))
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for all tasks of a worker process."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, p: str) -> bytes | None:
        """Ids of a piece, or None if it is empty or begins or ends with white space other than a line end alone."""
        core, text = (p[1:], p[1:]) if p[:1] == self.BARE else (p, " " + p)
        if core.isalpha() and (core.isascii() or max(core) < "\u0530"):
            ids = array("I", [t.id for t in self.model.tokenize(charmap_decode(text.encode(), "strict", self.letters)[0])]).tobytes()
        elif not core or p != self.LINE and (core[0].isspace() or core[-1].isspace()):
            return None
        else:
            ids = self._whole(text)
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[p] = ids
        return ids

    def _one(self, text: str) -> bytes:
        if not self.byte_level or self.BARE in text or any(s in text for s in self.special):
            return self._whole(text)
        pieces = (self.BARE + self.MARKS.sub(" \x01\\1", text)).replace("\n", " \x01\n \x01").split(" ")
        got = list(map(self.known.get, pieces))
        if None in got:
            learn, known = self._learn, self.known
            got = [(known.get(p) or learn(p)) if g is None else g for p, g in zip(pieces, got, strict=True)]
            if None in got:
                return self._joined(pieces, got)
        return b"".join(got)

    def _joined(self, pieces: list[str], got: list[bytes | None]) -> bytes:
        """The ids if some pieces are white space: each run of such and its neighbours on both sides are one text."""
        blank = [g is None or p == self.LINE for p, g in zip(pieces, got, strict=True)]
        out, i, n = [], 0, len(pieces)
        lone = lambda k: blank[k] and got[k] is not None and not (k and blank[k - 1]) and not (k + 1 < n and blank[k + 1])
        solid = [not b or lone(k) for k, b in enumerate(blank)]
        while i < n:
            if solid[i] and (i + 1 == n or solid[i + 1]):
                out.append(got[i])
                i += 1
                continue
            k = i + 1
            while k < n and not (solid[k] and solid[k - 1]):
                k += 1
            text = "".join(p[1:] if p[:1] == self.BARE else " " + p for p in pieces[i:k])
            out.append(self._whole(text))
            i = k
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        return list(map(self._one, texts))


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> list[tuple[str, int, int]]:
    """Writes all documents in ascending id order (nulls first) as token files; returns (file, tokens, documents) in order.

    The files are one for each range of ids, so ids ascend within a file and from file to file. A task writes its file
    under a name of its own and then moves it into place: a task that is run again replaces it by the same. The
    driver gets one row for each file. A null text counts as empty: its document is the end id alone. Rows with equal
    ids are all written, ordered by a hash of the text. An empty table gives no files.
    """
    from pyspark.sql import types as T

    n = files or n_partitions(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("docs", T.LongType())])

    def write(batches):
        import pyarrow as pa

        task = TaskContext.get()
        system, root = _filesystem(folder)
        name = f"part-{task.partitionId():06d}.dac"
        writer = stream = encoder = None
        for batch in batches:
            for part in text_slices(batch, "text"):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    own = f"{root}/_{name}.{task.taskAttemptId()}"
                    stream = system.open_output_stream(own)
                    writer, encoder = FileWriter(stream), Encoder.of(tokenizer)
                for i, ids in zip(part.column("id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    writer.add(i, np.frombuffer(ids + end, dtype="<u4"))
        if writer is not None:
            encoder.known.clear()  # a worker that is used again does not hold what this task's words took
            tokens, count = writer.close()
            stream.close()
            system.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([tokens], pa.int64()), pa.array([count], pa.int64())], schema.names)

    return [(r.file, r.tokens, r.docs) for r in sorted(map_texts(rows, write, schema).collect())]


def read_files(spark, written: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document from the files alone: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    from pyspark.sql import types as T

    start, rows = 0, []
    for file, tokens, _ in written:
        rows.append((file, start))
        start += tokens
    names = spark.createDataFrame(rows, "file string, first long").repartition(max(1, len(rows)))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for file, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = _filesystem(file)
                with system.open_input_file(path) as stream:
                    held = []
                    for d, at, n, crc in FileReader(stream).documents():
                        held.append((d, first + at, n, crc))
                        if len(held) == 10_000:
                            yield _batch(pa, held)
                            held = []
                    if held:
                        yield _batch(pa, held)

    return names.mapInArrow(read, schema)


def _batch(pa, rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def tokenise(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the token files (in the shared folder, if none is given) and returns what :func:`read_files` reads from them."""
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, tokenizer, folder or fresh_path(spark, "tokens"), **options))
