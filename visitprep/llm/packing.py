"""Best-fit packing: documents into sequences of a fixed number of tokens.

Bounded-space online best fit.  A packing task keeps at most ``open_bins`` sequences open, filed by
free space; a bitset over the free-space values finds the tightest fit in a few integer operations.
When the number of open sequences would pass the bound, the fullest one closes first.  Tokenising and
packing happen in the scan tasks, so no text is shuffled and a lost task is simply run again.

Every task ends with part-filled sequences.  In a second step sequences are items themselves: dealt by
hash into groups of a bounded number, the largest first, best fit joins them.  Only numbers travel.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
OPEN_BINS = 2048
#: Sequences that one task of the second step joins, about.
JOINED = 1 << 16
#: Added after every document.
SEPARATOR_ID = 1
#: Entries of the caches of one Python worker; when they are full, further words are encoded anew.
CACHE_WORDS, CACHE_CHUNKS = 900_000, 400_000

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Bounded-space online best fit of items up to ``capacity`` into bins."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, first_id: int = 0):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.n_open = 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset of an item."""
        fitting = self.bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = self._take(room)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            at, room = self.next_id, self.capacity
            self.next_id += 1
        if room > size:
            self.free[room - size].append(at)
            self.bits |= 1 << (room - size)
            self.n_open += 1
        return at, self.capacity - room

    def _take(self, room: int) -> int:
        stack = self.free[room]
        at = stack.pop()
        self.n_open -= 1
        if not stack:
            self.bits ^= 1 << room
        return at


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The tokenizer's normaliser works character by character and its splitter never crosses white
    space, so the ids of a text are those of its white-space pieces in turn; pieces recur, and their
    ids are kept.  Texts that hold a special token's string, or characters that could compose or
    count as white space outside ASCII, go to the tokenizer whole.
    """

    _WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[!-/:-@\[-`{-~]+")
    _SIMPLE = re.compile(r"[!-~À-ÖØ-öø-įĲ-ž]+\Z")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a piece without ASCII white space."""
        if self._SIMPLE.match(chunk):
            parts, words = [], self.words
            for word in self._WORD.findall(chunk.lower()):
                ids = self.chunks.get(word) or words.get(word)  # a piece that is one such word is kept as a piece only
                if ids is None:
                    ids = self.direct(word)
                    if (word != chunk or len(self.chunks) >= CACHE_CHUNKS) and len(words) < CACHE_WORDS and len(word) <= 64:
                        words[word] = ids
                parts.append(ids)
            ids = b"".join(parts)
        else:
            ids = self.direct(chunk)
        if len(self.chunks) < CACHE_CHUNKS and len(chunk) <= 64:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text or not self._composed(text):
            return self.direct(text)
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.chunks.get
        return b"".join([known(c) or (self._chunk(c) if c else b"") for c in chunks])

    _RISKY = re.compile("[^\x00-ž‐-‧‰-⁞₠-₿一-鿿]")

    def _composed(self, text: str) -> bool:
        """No character whose normal form could depend on its neighbours."""
        return text.isascii() or not self._RISKY.search(text)


def encoder(path: str) -> WordEncoder:
    return common.hold(f"encoder {path}", lambda: WordEncoder(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _joining(capacity: int, open_bins: int):
    def join(table: pa.Table) -> pa.Table:
        """Sequences that go behind another one, with their new place."""
        ids, used = table.column("sequence_id").to_numpy(), table.column("used").to_numpy()
        order = np.lexsort((ids, -used))
        bins, first, out = BestFit(capacity, open_bins), {}, ([], [], [])
        for one, size in zip(ids[order].tolist(), used[order].tolist(), strict=True):
            at, base = bins.place(size)
            if base:
                for to, value in zip(out, (one, first[at], base), strict=True):
                    to.append(value)
            else:
                first[at] = one
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["old_id", "new_id", "base"])

    return join


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Places of every document's pieces.

    Ids are the tokenizer's without special tokens, then id 1.  Only documents longer than
    ``capacity`` are cut, into pieces of ``capacity`` ids.  Null and empty texts have the single id 1;
    null ids of documents and repeated rows are packed like any other row; an empty table gives no
    rows; further columns are ignored.  Equal sizes go to the most recently used of the tightest bins.
    Places of the first step are written to the shared folder, so the second sees one packing even when
    a task is run again.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 36)
        end = np.array([SEPARATOR_ID], dtype="<u4").tobytes()
        for batch in (part for whole in batches for part in common.pieces(whole, "text")):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, text in zip(common.column(batch, "doc_id").to_pylist(), common.strings(batch, "text"), strict=True):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    row = (doc_id, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), *bins.place(size))
                    for to, value in zip(out, row, strict=True):
                        to.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    placed = common.written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.trimmed_task(run), SCHEMA), "placed")
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).filter(F.col("used") < capacity)
    groups = used.count() // JOINED + 1
    moved = used.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("part")).applyInArrow(_joining(capacity, open_bins), "old_id long, new_id long, base long")
    joined = placed.join(moved, F.col("sequence_id") == F.col("old_id"), "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("new_id", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
