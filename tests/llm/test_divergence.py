"""The audit of sources against a plain count over all kept terms."""

import glob
import os
import re
from collections import Counter, defaultdict

import pytest

from visitprep.llm import common, divergence


def plain(rows, min_documents, top):
    """Rows of (lang, source, part, item, value, rank) by brute force over (text, lang, source)."""
    found, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        found[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in found[lang].items() if n >= min_documents)
        sources = sorted(s for g, s in groups if g == lang)
        size = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * size) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, n in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i) for i, x in enumerate(items[:n], 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


WORDS = ["alpha", "Beta", "gamma", "ÄRGER", "ärger", "漢字", "don't", "x", "delta-epsilon", "zeta9eta", "\U0001f600", "of"]


@pytest.fixture(scope="module")
def rows():
    import random

    rng, out = random.Random(3), []
    for i in range(400):
        some = WORDS[: 3 + i % 10]
        sep = rng.choice([" ", "  ", "\n", "1", ". "])
        text = sep.join(rng.choice(some) for _ in range(rng.randrange(30)))
        out.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "ß", None, f"t{i % 7}"])))
    return out + [("only one", "xx", "solo"), (None, "en", "silent"), ("alpha " * 3000, "en", "s1"), ("alpha Alpha ALPHA\x00alpha", "de", "long")]


@pytest.mark.parametrize("sent", [1 << 20, 0])
@pytest.mark.parametrize("least, sources, paired", [(1, 1024, 20_000), (8, 3, 20), (30, 1, 1), (10_000, 1024, 10)])
def test_same_as_plain_count(spark, monkeypatch, rows, sent, least, sources, paired):
    monkeypatch.setattr(divergence, "SENT_BYTES", sent)
    monkeypatch.setattr(divergence, "PART_BYTES", 2000)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "PAIRED", paired)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert got(df, min_documents=least, top_terms=4) == plain(rows, least, 4)


def test_small_counts_are_sent_on(spark, monkeypatch, rows):
    monkeypatch.setattr(divergence, "COUNTED", 3)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(df, min_documents=5) == plain(rows, 5, 50)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    odd = awkward.selectExpr("text as body", "lang as l", "source as s", "doc_id as text", "spans as term", "size as lang", "bucket as part", "score as n")
    assert got(odd, text_col="body", lang_col="l", source_col="s", min_documents=2) == plain(rows, 2, 50)
    assert got(empty) == []


def test_counts_beyond_a_long_times_the_unit(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, 4 * 10**15, 10**6)], "n long, total long, size long").select(divergence.share("n", "total", "size").alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (big + 5) // (4 * 10**15 + 5 * 10**6)


def test_whole_terms_only():
    machine = divergence.Automaton(["a", "ab", "b", "é"])
    assert Counter(machine.find(divergence.padded("A a ab,abc b-b é aé".encode()))) == {0: 2, 1: 1, 2: 2, 3: 1}
    assert list(divergence.Automaton([]).find(b" a ")) == []


def test_only_the_result_stays(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    folder = f"{common.shared_folder(spark).removeprefix('file:')}/tables"
    before = set(glob.glob(f"{folder}/*"))
    out = divergence.audit(df)
    left = set(glob.glob(f"{folder}/*")) - before
    assert len(left) == 1 and os.path.basename(left.pop()).startswith("audit-") and out.count() > 0
