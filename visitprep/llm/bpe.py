"""BPE as a streaming transducer: ids leave as soon as no later character can change them.

A merge list fixes how far a change can reach back.  Take two texts that agree up to some place.  Merging
rule by rule, in order of rank, their tokens agree up to a border that moves only when a rule joins the
last common token with what follows it in one of the texts.  Of the next rule that crosses the moved
border, the right half begins with the left half of the one before, grown by merges that are not older
than it.  ``MergeList.lookahead`` is the longest such chain, in symbols: a token that ends so far
before the end of what was read is final.

Decoding is the other direction: bytes of tokens go through a state machine that lets whole
characters out and holds back at most three bytes.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a text that are taken at a time.
BLOCK = 1 << 16
#: Entries of a worker's caches; when they are full, further words are encoded anew.
CACHE_WORDS, CACHE_CHUNKS, CACHE_LENGTH = 300_000, 300_000, 64
#: Bytes of results in one Arrow batch, but for one longer row.
OUT_BYTES = 16 << 20
#: Ids decoded at a time.
DECODED = 1 << 16


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies show for each byte: itself if visible, else one from 256 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


class MergeList:
    """Merge rules over ids, in order of rank.

    Raises if a rule uses a token that a later rule, or none, makes, or if two rules make one token:
    then merging rule by rule and always merging the lowest rank can differ.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.parts: dict[int, tuple[int, int, int]] = {}
        shown = byte_characters()
        try:
            self.inner = [vocabulary[c] for c in shown]
            self.last = [vocabulary[c + suffix] for c in shown]
        except KeyError as e:
            raise ValueError(f"the vocabulary has no symbol {e}") from None
        self.size = dict.fromkeys([*self.inner, *self.last], 1)
        for rank, (left, right) in enumerate(merges):
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if a not in self.size or b not in self.size or whole in self.size:
                raise ValueError(f"rule {rank} ({left!r}, {right!r}) is out of order")
            self.rank[a, b] = rank
            self.made.append(whole)
            self.parts[whole] = (rank, a, b)
            self.size[whole] = self.size[a] + self.size[b]
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Symbols after a token that settle it: the longest chain of rules that cross one border after another."""
        longest, reach = 0, {}  # left half: (ranks, longest chain up to that rank)
        for rank, whole in enumerate(self.made):
            _, left, token = self.parts[whole]
            before, newest = 0, rank - 1
            while True:  # what the right half began as, and the rank at which that grew
                if token in reach:
                    ranks, lengths = reach[token]
                    n = bisect_right(ranks, newest)
                    before = max(before, lengths[n - 1] if n else 0)
                if token not in self.parts:
                    break
                grew, token, _ = self.parts[token]
                newest = min(grew, rank - 1)
            length = self.size[left] + before
            ranks, lengths = reach.setdefault(left, ([], []))
            ranks.append(rank)
            lengths.append(max(length, lengths[-1] if lengths else 0))
            longest = max(longest, length)
        return longest

    def merge(self, ids: list[int]) -> list[int]:
        """``ids`` with all rules applied, the lowest rank first, from the left."""
        none, rank = len(self.made), self.rank.get
        ids = ids[:]
        pairs = [rank(p, none) for p in zip(ids, ids[1:])]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            ids[at : at + 2] = [self.made[low]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank((ids[at - 1], ids[at]), none)
            if at < len(pairs):
                pairs[at] = rank((ids[at], ids[at + 1]), none)
        return ids


class Transducer:
    """Symbols of one word in, tokens out; holds at most ``limit`` symbols."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.limit = 2 * merges.lookahead + 64
        self.waiting: list[int] = []

    def feed(self, data: bytes) -> list[int]:
        """Tokens that are settled once ``data`` was read.  The last symbol stays open: it may end the word."""
        out, inner = [], self.merges.inner
        for at in range(0, len(data), self.limit):
            self.waiting += [inner[b] for b in data[at : at + self.limit]]
            while len(self.waiting) > self.limit:
                seen = self.waiting[: self.limit]
                final, end = self.limit - self.merges.lookahead, 0
                for token in self.merges.merge(seen):
                    if end + self.merges.size[token] > final:
                        break
                    end += self.merges.size[token]
                    out.append(token)
                del self.waiting[:end]
        return out

    def close(self) -> list[int]:
        """The rest of the word's tokens."""
        if not self.waiting:
            return []
        last = self.merges.last[self.merges.inner.index(self.waiting[-1])]
        out, self.waiting = self.merges.merge([*self.waiting[:-1], last]), []
        return out


class _Kinds(dict):
    """The kind of a character, as the tokenizer's own splitter sees it, found when first met.

    L letter, N digit, O other, S none of a word's; an apostrophe and the letters of contractions stand
    for themselves.
    """

    def __init__(self, split):
        self.split = split

    def __missing__(self, code: int) -> str:
        c = chr(code)
        beside = [ends for _, ends in self.split("a" + c)]
        if c in "'stredvml":
            kind = c
        elif (0, 2) in beside:
            kind = "L"
        elif (1, 2) not in beside:
            kind = "S"
        else:
            kind = "O" if len(self.split(c + c)) == 1 else "N"
        self[code] = kind
        return kind


class Encoder:
    """Ids of texts for a tokenizer file of the word-piece layout: composed, lower-cased words, each split
    from white space, contractions, digits and signs, as bytes with a mark on the last.

    A text is read in blocks, cut behind white space or, where there is none, between two characters that
    cannot compose; a word may go on from block to block.  Strings of special tokens are taken out
    first.  Words and white-space pieces recur, so their ids are kept.
    """

    _WHITE = re.compile(r"[ \t\n\r]")
    _PLAIN = re.compile(r"[!-~]+\Z")
    _PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
    _WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[Lstredvml]+|N|[O']+")
    _OPEN = {"L": re.compile("[Lstredvml]*"), "O": re.compile("[O']*")}
    _LAYOUT = (("NFC", "Replace", "Lowercase"), ("Split", "ByteLevel"), r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        normal, splits, model = (told["normalizer"] or {}).get("normalizers", []), (told["pre_tokenizer"] or {}).get("pretokenizers", []), told["model"]
        layout = (tuple(x["type"] for x in normal), tuple(x["type"] for x in splits), splits[0].get("pattern", {}).get("Regex") if splits else None)
        if layout != self._LAYOUT or model["type"] != "BPE" or not model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a tokenizer of composed lower-case words with marked ends")
        self.merges = MergeList(model["vocab"], (m.split(" ") if isinstance(m, str) else m for m in model["merges"]), model["end_of_word_suffix"])
        self.transducer = Transducer(self.merges)
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.kinds = tokenizer.normalizer.normalize_str, _Kinds(tokenizer.pre_tokenizer.pre_tokenize_str)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"\b\B")
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}
        self.open = ""
        self._second: frozenset[int] | None = None

    def encode(self, text: str) -> bytes:
        """All ids, little-endian unsigned 32-bit."""
        return b"".join(self.stream(text))

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of ``text``, part by part."""
        at = 0
        for m in self.specials.finditer(text):
            yield from self._segment(text, at, m.start())
            yield _packed([self.special[m[0]]])
            at = m.end()
        yield from self._segment(text, at, len(text))

    def _segment(self, text: str, at: int, end: int) -> Iterator[bytes]:
        while at < end:
            to = self._cut(text, at, end)
            part, ends = text[at:to], to == end or self._WHITE.match(text, to - 1)
            if ends and not self.open:
                known, chunk = self.chunks.get, self._chunk
                yield b"".join([known(c) or chunk(c) for c in part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")])
            else:
                yield from self._continued(part, bool(ends))
            at = to

    def _cut(self, text: str, at: int, end: int) -> int:
        """Where the block from ``at`` ends: behind white space if it has any."""
        to = at + BLOCK
        if to >= end:
            return end
        if (white := max(text.rfind(c, at, to) for c in " \n\t\r")) >= 0:
            return white + 1
        places = itertools.chain(range(to, at + 2, -1), range(to + 1, end))
        # Not behind an apostrophe, which could begin a contraction.
        return next((p for p in places if "'" not in text[p - 2 : p] and self._starts(text[p])), end)

    def _starts(self, c: str) -> bool:
        """Whether nothing before ``c`` can compose with it."""
        if c < "\x80":
            return True
        if self._second is None:
            pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x80, 0x110000))
            self._second = frozenset([int(p[1], 16) for p in pairs if len(p) == 2 and p[0][0] != "<"] + [*range(0x1160, 0x1200)])
        return not unicodedata.combining(c) and unicodedata.category(c) != "Cn" and ord(c) not in self._second

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a piece without ASCII white space, which no open word precedes."""
        if self._PLAIN.match(chunk):
            ids = b"".join([self.words.get(w) or self._word(w) for w in self._PLAIN_WORD.findall(chunk.lower())])
        else:
            text = self.normalise(chunk)
            found = self._WORD.finditer(text.translate(self.kinds))
            ids = b"".join([self.words.get(w) or self._word(w) for w in (text[m.start() : m.end()] for m in found)])
        if len(self.chunks) < CACHE_CHUNKS and len(chunk) <= CACHE_LENGTH:
            self.chunks[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = _packed(self.transducer.feed(word.encode()) + self.transducer.close())
        if len(self.words) < CACHE_WORDS and len(word) <= CACHE_LENGTH:
            self.words[word] = ids
        return ids

    def _continued(self, part: str, ends: bool) -> Iterator[bytes]:
        """Ids of a part that begins in an open word, or whose last word may go on."""
        text, at = self.normalise(part), 0
        kinds = text.translate(self.kinds)
        if self.open:
            at = self._OPEN[self.open].match(kinds).end()
            yield _packed(self.transducer.feed(text[:at].encode()))
            if at == len(text) and not ends:
                return
            yield _packed(self.transducer.close())
            self.open = ""
        for m in self._WORD.finditer(kinds, at):
            word = text[m.start() : m.end()]
            if m.end() < len(text) or ends or m[0] == "N" or (m[0][0] == "'" and m[0][-1] not in "O'"):  # a digit and a contraction are whole
                yield self._word(word)
            else:
                self.open = "O" if m[0][0] in "O'" else "L"
                yield _packed(self.transducer.feed(word.encode()))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Decoder:
    """Ids in, text out, of a tokenizer file with a byte-level decoder or with none, which puts a space
    between tokens.  Unknown ids are left out; malformed bytes become U+FFFD, as the library has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind = (told["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"{path} has a decoder of type {kind}")
        tokens = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        as_byte = {c: b for b, c in enumerate(byte_characters())}
        self.tokens: list[bytes | None] = [None] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.tokens[i] = bytes(as_byte[c] for c in token) if kind and all(c in as_byte for c in token) else token.encode()
        self.joint = b"" if kind else b" "
        self.reset()

    def reset(self) -> None:
        self.begun, self.machine = False, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        """The characters that are whole once ``ids`` were read."""
        n, tokens = len(self.tokens), self.tokens
        try:
            found = [tokens[i] for i in ids]
        except IndexError:
            found = [tokens[i] for i in ids if i < n]
        if None in found:
            found = [t for t in found if t is not None]
        if not found:
            return ""
        data = self.joint.join(found)
        if self.begun:
            data = self.joint + data
        self.begun = True
        return self.machine.decode(data)

    def close(self) -> str:
        """What bytes that are still held back stand for."""
        out = self.machine.decode(b"", True)
        self.reset()
        return out

    def decode(self, ids: bytes) -> str:
        flat = np.frombuffer(ids, "<u4")
        return "".join([*(self.feed(flat[i : i + DECODED].tolist()) for i in range(0, len(flat), DECODED)), self.close()])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Both directions for one file, each made when first needed."""

    def __init__(self, path: str):
        self.path = path

    @functools.cached_property
    def encoder(self) -> Encoder:
        return Encoder(self.path)

    @functools.cached_property
    def decoder(self) -> Decoder:
        return Decoder(self.path)


def codec(path: str) -> Codec:
    # One holding for both, since a worker may do either from task to task.
    return common.hold(f"bpe {path}", lambda: Codec(path))


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema, kept: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size: kept columns beside the values computed for each row."""
    first, values, total, n = 0, [], 0, kept.num_columns

    def batch() -> pa.RecordBatch:
        made = [pa.array(v, f.type) for v, f in zip(zip(*values, strict=True), list(schema)[n:], strict=True)]
        return pa.RecordBatch.from_arrays([*kept.slice(first, len(values)).columns, *made], schema=schema)

    for size, value in rows:
        if values and total + size > OUT_BYTES:
            yield batch()
            first, values, total = first + len(values), [], 0
        values.append(value)
        total += size
    if values:
        yield batch()


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _mapped(df: DataFrame, keep: list[str], source: str, targets: dict[str, str], make) -> DataFrame:
    """``keep`` columns and columns ``targets`` (name to type) computed from ``source`` by what ``make()`` returns."""
    if set(targets) & set(keep) or len(set(keep)) < len(keep):
        raise ValueError(f"kept columns have to be distinct and not called {' or '.join(map(repr, targets))}: {', '.join(keep)}")
    fields = {c: df.schema[c].dataType.simpleString() for c in keep} | targets
    kinds = {"binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            at = batch.num_columns - 1
            kept = batch.select(range(at))
            out = pa.schema([*kept.schema, *((t, kinds[k]) for t, k in targets.items())])
            values = (one(x.as_py()) for x in batch.column(at))
            yield from _batches(((sum(map(len, v)), v) for v in values), out, kept)

    schema = ", ".join(f"{_name(c)} {kind}" for c, kind in fields.items())
    return df.select(*[F.col(_name(c)) for c in keep], F.col(source).alias("__in")).mapInArrow(run, schema)


def encode(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """The columns ``keep`` (by default ``doc_id``) and ``ids``, binary: each id as a little-endian unsigned
    32-bit integer, as token files hold them.

    Equal to the library's ids without special tokens around the text; strings of special tokens within
    it are those tokens.  A null text reads as an empty one, which has no ids.  Every row is encoded
    for itself, so null and repeated keys, ties and empty tables need no rule; other columns are
    ignored, and a kept column called ``ids`` is refused.  Scan tasks only, no shuffle.
    """
    path = tokenizer_path or default_tokenizer()

    def make():
        encoder = codec(path).encoder
        return lambda text: (encoder.encode(text or ""),)

    return _mapped(docs, ["doc_id"] if keep is None else keep, text_col, {"ids": "binary"}, make)


def decode(tokens: DataFrame, *, ids_col: str = "ids", keep: list[str] | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """The columns ``keep`` (by default ``doc_id``) and ``decoded``, the text of the ids.

    Special tokens are shown.  Null ids read as none; ids that the file does not have are left out; a
    length that is not a multiple of four bytes raises.  A kept column called ``decoded`` is refused.
    """
    path = tokenizer_path or default_tokenizer()

    def make():
        decoder = codec(path).decoder
        return lambda ids: (decoder.decode(ids or b""),)

    return _mapped(tokens, ["doc_id"] if keep is None else keep, ids_col, {"decoded": "string"}, make)


def round_trip(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """``encode`` and then ``decode`` its ids, in one worker: the columns ``keep``, ``ids`` and ``decoded``."""
    path = tokenizer_path or default_tokenizer()

    def make():
        both = codec(path)
        return lambda text: (ids := both.encoder.encode(text or ""), both.decoder.decode(ids))

    return _mapped(docs, ["doc_id"] if keep is None else keep, text_col, {"ids": "binary", "decoded": "string"}, make)
