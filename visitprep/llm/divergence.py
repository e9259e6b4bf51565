"""How the sources of a language differ in their words: a two-pass vocabulary automaton.

The first pass counts, exactly, in how many documents of a language each term occurs.  The second runs
texts through an Aho-Corasick automaton of the kept terms, each between two delimiters, so that only
whole terms match, and counts occurrences for each source.  These sparse postings give shares of terms,
distances of sources and the terms that set a source apart, in whole numbers.

A vocabulary of a checked size is sent to every worker.  Beyond that, texts are dealt into parts of
a bounded size and each part gets the kept terms that occur in it.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCUMENTS, TOP_TERMS, UNIT, SMOOTHING = 30, 50, 1_000_000_000, 5
#: A vocabulary of at most so many bytes goes to every worker.
SENT_BYTES = 4 << 20
#: Text of one part beyond that, about.
PART_BYTES = 16 << 20
#: Entries that a task counts before it sends them on.
COUNTED = 400_000
#: Postings of one group that is paired, at least, and sources of one block of them, about.
PAIRED, SOURCES = 4_000, 1024

#: Letters in lower case, beyond ASCII as they are, and spaces for all that separates terms.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def padded(text: bytes) -> bytes:
    """The terms of a text with at least one space on either side of each."""
    return b" " + text.translate(_TERMS) + b" "


def _documents(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()])


def _rows(batch: pa.RecordBatch, *names: str) -> Iterable[tuple]:
    """Keys as text, then the text as padded bytes."""
    keys = [common.column(batch, n).to_pylist() for n in names]
    return zip(*keys, map(padded, common.utf8(batch, "text")), strict=True)


def _counted(counts: dict[tuple, Counter], fields: list[str], name: Callable[[tuple, list], list]) -> pa.RecordBatch:
    """Counts by key as rows; ``fields`` names the key's parts, the term and the count."""
    keys = [(k, len(c)) for k, c in counts.items()]
    columns = [pa.array([k[i] for k, n in keys for _ in range(n)], pa.string()) for i in range(len(fields) - 2)]
    terms = pa.array([t for k, c in counts.items() for t in name(k, list(c))], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*columns, terms, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=fields)


def _flushed(items: Iterable[tuple[tuple, Iterable]], fields: list[str], name: Callable[[tuple, list], list] = lambda key, terms: terms) -> Iterator[pa.RecordBatch]:
    """Counts of what ``items`` have by key, sent on when there are many; ``name`` gives terms for what was counted."""
    counts, size = defaultdict(Counter), 0
    for key, found in items:
        held = counts[key]
        before = len(held)
        held.update(found)
        size += len(held) - before
        if size >= COUNTED:
            yield _counted(counts, fields, name)
            counts, size = defaultdict(Counter), 0
    yield _counted(counts, fields, name)


def vocabulary(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, n_documents) of the terms in at least ``min_documents`` documents of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (((lang,), set(text.split())) for b in batches for lang, text in _rows(b, "lang"))
        yield from _flushed(found, ["lang", "term", "n"])

    partial = docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n_documents")).filter(F.col("n_documents") >= min_documents)


class Automaton:
    """Kept terms of one language between delimiters; whole terms of padded texts are what it finds."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.terms = terms
        self.machine = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.machine.add_word(f" {term} ", i)
        if terms:
            self.machine.make_automaton()

    def find(self, text: bytes) -> Iterable[int]:
        """The number of the term at each of its occurrences.  Matches overlap: neighbours share a delimiter."""
        return map(itemgetter(1), self.machine.iter(text.decode())) if self.terms else ()


def _found(machines: dict[str, Automaton], rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (language, source, padded text)."""
    none = Automaton([])
    found = (((lang, source), machines.get(lang, none).find(text)) for lang, source, text in rows)

    def name(key: tuple, numbers: list) -> list:
        return [machines[key[0]].terms[i].encode() for i in numbers]

    return _flushed(found, _POSTINGS, name)


_POSTINGS = ["lang", "source", "term", "n"]
_SCHEMA = "lang string, source string, term string, n long"


def _sent(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Postings by automata that every worker holds."""
    terms = kept.select("lang", "term").toArrow()  # at most SENT_BYTES
    by_lang = {lang: terms.filter(pc.equal(terms.column("lang"), lang)).column("term").combine_chunks().sort() for lang in terms.column("lang").unique().to_pylist()}
    sent, name = docs.sparkSession.sparkContext.broadcast(by_lang), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = common.hold(f"automata {name}", lambda: {lang: Automaton(found.to_pylist()) for lang, found in sent.value.items()})
        yield from _found(machines, (row for b in batches for row in _rows(b, "lang", "source")))

    return docs.mapInArrow(run, _SCHEMA)


def _dealt(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Postings by an automaton for each part of the texts, of the kept terms that occur there."""
    parts = common.input_bytes(docs) // PART_BYTES + 1
    # Written, so that a row is in the same part whenever it is read.
    placed = common.written(docs.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("string")), "placed")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (((part, lang), set(text.split())) for b in batches for part, lang, text in _rows(b, "part", "lang"))
        yield from _flushed(found, ["part", "lang", "term", "n"])

    local = placed.select("part", "lang", "text").mapInArrow(terms, "part string, lang string, term string, n long").select("part", "lang", "term").distinct().join(kept.select("lang", "term"), ["lang", "term"], "left_semi")

    def scan(texts: pa.Table, words: pa.Table) -> pa.Table:
        by_lang = defaultdict(list)
        for lang, term in zip(words.column("lang").to_pylist(), words.column("term").to_pylist(), strict=True):
            by_lang[lang].append(term)
        machines = {lang: Automaton(sorted(found)) for lang, found in by_lang.items()}
        return pa.Table.from_batches(_found(machines, (row for b in texts.to_batches() for row in _rows(b, "lang", "source"))))

    return placed.groupBy("part").cogroup(local.groupBy("part")).applyInArrow(scan, _SCHEMA)


def postings(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of kept terms in each source, where there are any."""
    size = kept.agg(F.coalesce(F.sum(F.octet_length("term") + 2), F.lit(0)).alias("size")).first().size
    if size <= SENT_BYTES:
        found = _sent(docs, kept)
    else:
        found = _dealt(docs, kept)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count: str, total: str, size: str) -> Column:
    """The smoothed share of a term in units, rounded down, plus one; exact."""
    whole = "cast({} as decimal(20,0))".format
    return F.expr(f"(({whole(count)} + {SMOOTHING}) * {UNIT}) div ({whole(total)} + {SMOOTHING} * {whole(size)}) + 1")


def _corrections(table: pa.Table) -> pa.Table:
    """For two sources that have the same term: what their distance there differs by from the sum of what
    either alone would add."""
    names, at = np.unique(table.column("source").to_numpy(zero_copy_only=False), return_inverse=True)
    _, term = np.unique(table.column("term").to_numpy(zero_copy_only=False), return_inverse=True)
    own = table.column("own").to_numpy()
    p, zero = table.column("p").to_numpy(), table.column("z").to_numpy()
    order = np.lexsort((at, term))
    at, term, own, p, zero = at[order], term[order], own[order], p[order], zero[order]
    sums, seen = np.zeros((len(names),) * 2, np.int64), np.zeros((len(names),) * 2, bool)
    step = 1
    while step < len(term) and (same := np.flatnonzero(term[step:] == term[:-step])).size:
        i, j = same, same + step
        # Of two blocks of sources only pairs across them; within one block all.
        fits = (own[i] != own[j]) | (own[i] == 2)
        i, j = i[fits], j[fits]
        value = np.abs(p[i] - p[j]) - np.abs(p[i] - zero[j]) - np.abs(zero[i] - p[j]) + np.abs(zero[i] - zero[j])
        np.add.at(sums, (at[i], at[j]), value)
        seen[at[i], at[j]] = True
        step += 1
    a, b = np.nonzero(seen)
    lang = table.column("lang")[0].as_py() if len(term) else ""
    value = sums[a, b]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(names[a].tolist(), pa.string()), pa.array(names[b].tolist(), pa.string()), pa.array(np.concatenate([value, value]))], names=["lang", "source", "item", "value"])


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): distances of every two sources of a language over all kept terms.

    Two sources that both lack a term are as far apart there as their shares of nothing, ``z``.  So a distance is
    that, for all terms, plus what each source's own terms change against the other's ``z``, which
    needs only how often each share occurs, plus a correction for terms that both have.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other"))
    apart = F.col("source") != F.col("item")
    nothing = groups.join(other, "lang").filter(apart).select("lang", "source", "item", (F.col("size") * F.abs(F.col("z") - F.col("other"))).alias("value"))
    occurring = counts.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("n"))
    changed = F.col("n") * (F.abs(F.col("p") - F.col("other")) - F.abs(F.col("z") - F.col("other")))
    alone = occurring.join(other, "lang").filter(apart).groupBy("lang", "source", "item").agg(F.sum(changed).alias("value"))
    dealt = counts.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.col("buckets")), "block": F.pmod(F.xxhash64("source"), F.col("blocks"))})
    # Blocks of sources meet in pairs, so that a group has two of them at most.
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    own = F.when(F.col("low") == F.col("high"), 2).when(F.col("block") == F.col("low"), 0).otherwise(1)
    both = dealt.select("lang", "bucket", "low", "high", "source", "term", "p", "z", own.alias("own")).groupBy("lang", "bucket", "low", "high").applyInArrow(_corrections, "lang string, source string, item string, value long")
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return nothing.unionByName(alone).unionByName(turned).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Distances of sources and terms that set them apart: lang, source, part, item, value, rank.

    Part ``pair`` has a row for each other source of the language, the farthest first; part ``term`` the
    ``top_terms`` kept terms whose share in the source most exceeds that in the language.  Ranks start
    from 1, ties by item.  Null texts, languages and sources read as empty ones; each row is a
    document, repeated or not; a source without terms, and one of a language without kept terms, has
    its pairs all the same.  An empty table gives no rows; other columns are ignored, whatever their
    names.  The result is a written table; those in between are removed.
    """
    docs = _documents(docs, text_col, lang_col, source_col)
    with common.scratch():
        kept = common.written(vocabulary(docs, min_documents), "vocabulary")
        found = common.written(postings(docs, kept), "postings")
        sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
        totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_postings"))
        zero = F.when(F.col("size") > 0, share("0", "total", "size")).otherwise(F.lit(0).cast("long"))
        named = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "size", "n_postings"])
        groups = common.written(named.withColumn("z", zero), "groups")
        of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("n_sources"), F.sum("n_postings").alias("n_lang"))
        # A group of postings gives as many pairs as it may have; groups are no smaller than that.
        of_lang = of_lang.withColumns({"buckets": F.expr(f"n_lang div greatest({PAIRED}, least(n_sources, {SOURCES}) * least(n_sources, {SOURCES}) div 2) + 1"), "blocks": F.expr(f"n_sources div {SOURCES} + 1")})
        in_lang = F.sum("n").over(Window.partitionBy("lang", "term"))
        shares = found.withColumn("lang_n", in_lang).join(groups, ["lang", "source"]).join(of_lang.drop("n_lang", "n_sources"), "lang")
        counts = common.written(shares.select("lang", "source", "term", share("n", "total", "size").alias("p"), share("lang_n", "lang_total", "size").alias("q"), "z", "buckets", "blocks"), "shares")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())))
        terms = ranked(counts.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).filter(F.col("rank") <= top_terms)
        pairs = ranked(_pairs(counts, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
        return common.written(pairs.unionByName(terms), "audit", keep=True)
