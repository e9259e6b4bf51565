"""Operators that compare documents, against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from visitprep.llm import embeddings, graph, jaccard, mixing, repeats, suffix_array, suffix_tree


class Links:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def texts_of(frame):
    return [(r.doc_id, r.text or "") for r in frame.collect()]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 460)] + [(i, i + 1) for i in range(500, 540)]
    links = Links({n for e in edges for n in e})
    for a, b in edges:
        links.link(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {n: links.root(n) for n in links.up if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(docs):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def check_jaccard(frame):
    sets = {k: v for k, v in shingle_sets(texts_of(frame)).items() if k is not None}
    links, ids = Links(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                links.link(a, b)
    rows = jaccard.components(frame).collect()
    assert len(rows) == frame.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), links.root(r.doc_id))


@pytest.mark.parametrize("crowded", [False, True])
def test_jaccard(spark, awkward, empty, crowded, monkeypatch):
    if crowded:  # every group as if it were a large one, families and groups in many blocks
        monkeypatch.setattr(jaccard, "PAIRED", 1)
        monkeypatch.setattr(jaccard, "BLOCK", 3)
        monkeypatch.setattr(jaccard, "SHARED", 3)
        monkeypatch.setattr(jaccard, "COUNTED", 9)
    check_jaccard(awkward)
    assert jaccard.components(empty).count() == 0
    rng = random.Random(8)
    rows = []
    for family in range(16):
        base = [f"w{rng.randrange(50 if family % 2 else 5000)}" for _ in range(rng.choice([3, 8, 12, 19, 30, 63, 64, 120, 260]))]
        for _ in range(8):
            words = base[:]
            for _ in range(rng.randrange(max(1, len(words) // 25) + 1)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            cut = rng.randrange(len(words) // 6 + 1)
            rows.append((len(rows) + 1, " ".join(words[cut:]).title()))
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_jaccard_of_a_crowded_family_in_two_bands(spark, monkeypatch):
    """Of a family on both sides of a band's end only middle sizes link the others."""
    monkeypatch.setattr(jaccard, "PAIRED", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SHARED", 4)
    monkeypatch.setattr(jaccard, "COUNTED", 8)
    rng = random.Random(21)
    base = [f"w{rng.randrange(90_000)}" for _ in range(2404)]
    rows = []
    for n in [1600] + [2000] * 20 + [2400] * 20:
        words = base[: n + 4]
        words[50 * len(rows) % n] = f"x{len(rows)}"
        rows.append((len(rows) + 1, " ".join(words)))
    assert jaccard.band(2000) < jaccard.band(2400) and len(rows) - 21 > jaccard.PAIRED
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_jaccard_sends_a_text_of_a_cluster_to_one_cell(spark, monkeypatch):
    """Families of alike sets, of which some are similar: each fits one cell, though all are more than a block."""
    for name, value in {"PAIRED": 1, "BLOCK": 16, "SHARED": 4, "COUNTED": 64}.items():
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "_one_partner", lambda led, of=jaccard._one_partner: of(led).filter("false"))
    cells = []
    monkeypatch.setattr(jaccard, "_verified", lambda texts, of, run=jaccard._verified: cells.append(of.collect()) or run(texts, of))
    rng = random.Random(3)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(90_000)}" for _ in range(200)]
        for _ in range(12):
            words = base[:]
            for _ in range(rng.randrange(2, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(90_000)}"
            rows.append((len(rows) + 1, " ".join(words)))
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    places = [r.doc_id for r in cells[1]]
    assert len(places) > 16 and len(places) == len(set(places))


def test_documents_without_a_partner_leave_large_groups(spark):
    """A set that needs few stays with those that share them; one far from what it and its neighbours need goes."""
    pack = lambda sigs: [np.array(sigs, "<u8").tobytes()]
    rows = [(1, 100, 2, 2, pack([1, 2])), (2, 100, 2, 9, pack([1, 2])), (3, 100, 1, 9, pack([1])), (4, 100, 2, 9, pack([3, 4])), (5, 93, 2, 9, pack([1, 2])), (6, 92, 2, 9, pack([1, 2])), (7, 101, 2, 9, pack([1, 2]))]
    members = spark.createDataFrame(rows, "ref long, class long, c long, need long, sigs array<binary>")
    assert sorted(r.ref for r in jaccard._partnered(members).collect()) == [1, 2, 5]


def test_packed_signatures_take_little_memory():
    """Packed signatures are read from any slice, and no object is made of a single one."""
    values = [[b"a" * 8, b"b" * 16], [], None, [b"c" * 8], [b"d" * 24, b"e" * 8]]
    for kind in (pa.binary(), pa.large_binary()):
        lists = pa.array(values, pa.list_(kind))
        for given in (lists, lists[1:], lists[3:], lists[1:3], pa.chunked_array([lists[3:], lists[:0], lists[:4]]), pa.chunked_array([], pa.list_(kind))):
            sigs, rows = jaccard._unpacked(given)
            each = [(i, x[j : j + 8]) for i, own in enumerate(given.to_pylist()) for x in own or [] for j in range(0, len(x), 8)]
            assert list(zip(rows.tolist(), [x.tobytes() for x in sigs], strict=True)) == each
    many = pa.array([[bytes(8)] * 500] * 400, pa.list_(pa.binary()))
    tracemalloc.start()
    jaccard._unpacked(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * 8 * 500 * 400  # 66 bytes for each of eight before


def test_counts_of_sets_among_themselves():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    apart = ~np.eye(9, dtype=bool)
    assert np.array_equal(jaccard.shared_counts(sets, sets, 7)[apart], both[apart])
    assert np.array_equal(jaccard.shared_counts(sets[:4], sets[4:], 7), both[:4, 4:])


def test_jaccard_looks_up_lacking_sets(spark, monkeypatch):
    """With every set as a lacking one, and no signatures, all links are found by single shingles."""
    monkeypatch.setattr(jaccard, "_reduce", lambda table, paired, of=jaccard._reduce: of(table, paired).set_column(7, "lacking", [[True] * of(table, paired).num_rows]))
    monkeypatch.setattr(jaccard, "signatures", lambda sets: (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(sets), np.int64)))
    rng = random.Random(5)
    rows = []
    for _ in range(10):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([8, 11, 30, 90]))]
        rows += [(len(rows) + i, " ".join([*base[: len(base) - i], "end" * (i % 2)])) for i in range(5)]
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_words_of_regular_structure_do_not_collide(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    check_jaccard(spark.createDataFrame([(1, one), (2, other), (3, " ".join(one)), (4, " ".join(other)), (5, f"a b {one}"), (6, f"b a {one}")], "doc_id long, text string"))


def test_signatures_miss_no_similar_sets():
    rng = np.random.default_rng(2)
    for _ in range(600):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 8, 15, 16, 20, 47, 48, 63, 64, 90, 127, 128, 200, 600]))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        # As far apart as similarity of 3/4 allows: some replaced, or some left out.
        swap = int(rng.integers(0, n // 7 + 1))
        b = np.concatenate([a[swap:], rng.integers(0, 1 << 63, swap).astype(np.uint64)]) if rng.random() < 0.5 else a[: max(1, -(-3 * n // 4))]
        a, b = np.unique(a), np.unique(b)
        if jaccard.similar(a, b) and not np.array_equal(a, b):  # equal sets meet by their keys
            sigs, of, good = jaccard.signatures([a, b])
            sizes = np.array([len(a), len(b)])
            both = len(np.intersect1d(sigs[of == 0], sigs[of == 1]))
            large = int(len(b) > len(a))
            k = int(sizes.sum()) // 7
            least = 1 if sizes[large] < 16 else good[large] - k if sizes[large] < 64 else 3 * good[large] - 2 * k if k <= good[large] else 2 * good[large] - k
            assert jaccard.lacking(sizes, good)[large] or both >= max(1, least)


def check_repeats(frame, operator, cut, join, window, removed):
    docs = sorted({d for d in texts_of(frame) if d[0] is not None})
    seen, want = set(), {}
    for i, text in docs:
        units = cut(text)
        gone, own = [False] * len(units), []
        for k in range(len(units) - window + 1):
            key = tuple(units[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            own.append(key)
        seen.update(own)
        want[i] = (sum(gone), hashlib.sha256(join([u for u, g in zip(units, gone, strict=True) if not g])).hexdigest())
    rows = operator(frame).collect()
    assert len(rows) == frame.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert sum(n for n, _ in want.values()) > removed


def passages(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    shared = [say(n) for n in (12, 55, 80, 140)]
    rows = []
    for i in range(60):
        parts = [say(rng.randrange(60)), rng.choice(shared), say(rng.randrange(40)), rng.choice(shared)[rng.randrange(30) :]]
        rows.append((i * 3, " ".join(parts) if i % 9 else rows[i // 2][1] if rows else "x"))
    rows.append((500, "ab" * 400))
    rows.append((501, "ab" * 300 + "c"))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_suffix_array_dedup(spark, awkward, empty):
    for frame in (awkward, passages(spark)):
        check_repeats(frame, suffix_array.dedup, str.encode, bytes, 50, 300)
    assert suffix_array.dedup(empty).count() == 0


def test_suffix_tree_dedup(spark, awkward, empty):
    for frame in (awkward, passages(spark)):
        check_repeats(frame, suffix_tree.dedup, lambda t: t.encode().split(), b" ".join, 50, 50)
    assert suffix_tree.dedup(empty).count() == 0


def check_edges(spark, module, operator, cut, join):
    """A passage in different contexts: right results, and no shard gets a piece of every document."""
    rng = random.Random(17)
    say = lambda n: "".join(f"w{rng.randrange(9000)}{rng.choice([' ', '  '])}" for _ in range(n))
    passage = say(90)
    ends = [say(3) for _ in range(4)]  # some contexts are shared for a few words
    frame = spark.createDataFrame([(i, say(40) + rng.choice(ends) + passage + rng.choice(ends) + say(40)) for i in range(120)], "doc_id long, text string").repartition(3)
    check_repeats(frame, operator, cut, join, 50, 1000)

    def index(pieces, least):
        assert len(pieces) <= 15
        return module.index(pieces, least)

    repeats.repeated_spans(frame, module.UNIT, index).collect()


@pytest.mark.parametrize("module", [suffix_array, suffix_tree])
def test_passage_in_many_contexts(spark, module, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 10, raising=False)
    if module is suffix_array:
        check_edges(spark, module, module.dedup, str.encode, bytes)
    else:
        check_edges(spark, module, module.dedup, lambda t: t.encode().split(), b" ".join)


@pytest.mark.parametrize(("direct", "limit"), [(1 << 20, 1 << 20), (2, 1 << 20), (2, 5)])
def test_induced_sorting(direct, limit):
    """In memory, by recursion, and with the queues on disk."""
    rng = random.Random(3)
    for _ in range(150):
        n, k, depth = rng.randint(1, 80), rng.choice([1, 2, 3, 20]), rng.choice([3, 7, 60])
        text = [rng.randint(1, k) for _ in range(n)] + [0]
        order, prefix = suffix_array.suffix_array(np.array(text, np.int16), depth, direct=direct, limit=limit)
        assert sorted(order.tolist()) == list(range(n + 1))
        for i in range(1, n + 1):
            a, b = text[order[i - 1] :], text[order[i] :]
            assert a[:depth] <= b[:depth]
            same = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert min(same, depth) == min(prefix[i], depth)


@pytest.mark.parametrize("limit", [2, 5, 1000])
def test_trees(limit):
    rng = random.Random(5)
    for _ in range(100):
        pieces = list({b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))) for _ in range(6)})
        least = np.array([rng.randint(0, 5) for _ in pieces])
        low = {}
        for q, d in zip(pieces, least, strict=True):
            w = q.split()
            for i in range(len(w) - 3):
                low[tuple(w[i : i + 4])] = min(low.get(tuple(w[i : i + 4]), 99), d)
        want = {(k, j) for k, (q, d) in enumerate(zip(pieces, least, strict=True)) for i in range(len(q.split()) - 3) if low[tuple(q.split()[i : i + 4])] < d for j in range(i, i + 4)}
        assert {(k, j) for k, a, b in suffix_tree.index(pieces, least, window=4, limit=limit) for j in range(a, b)} == want


def test_tree_nodes():
    words = np.array([1, 2, 1, 2, 3, 1, 2])
    tree = suffix_tree.build(words, np.array([0, 2, 5 - 1]), 0, 2)
    assert tree.suffixes.tolist() == [0, 2, 4] and tree.common.tolist() == [0, 2, 0]
    assert tree.nodes() == [(0, 0, 3), (2, 0, 2)]


def test_mixing_takes_the_first_by_finish_time(spark, monkeypatch):
    """Few, crowded ranges and many fine ones end the mix at the same copy."""
    rng = random.Random(21)
    frame = spark.createDataFrame([(i, "w " * rng.randint(0, 20), rng.choice("aab")) for i in range(400)], "doc_id long, text string, source string").repartition(3)
    fine = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    monkeypatch.setattr(mixing, "RANGES", 2)
    assert {r.doc_id: r.copies for r in mixing.mix(frame).collect()} == fine
    assert 0 < sum(fine.values()) < 800


def test_mixing(spark, awkward, empty):
    assert mixing.mix(empty).count() == 0
    frames = [awkward]
    rng = random.Random(12)
    frames.append(spark.createDataFrame([(i, " ".join("w" * rng.randint(1, 30)), rng.choice("aaaaab") if rng.random() < 0.9 else rng.choice([None, "c", "d", "zz"])) for i in range(1500)], "doc_id long, text string, source string").repartition(3))
    for frame in frames:
        rows = mixing.mix(frame).collect()
        assert len(rows) == frame.count()
        source = {r.doc_id: r.source for r in frame.collect()}
        sizes, goal, taken = {}, {}, {}
        for r in rows:
            s = source[r.doc_id]
            sizes[s] = sizes.get(s, 0) + r.size
            goal[s], taken[s] = r.target, taken.get(s, 0) + r.taken
            assert r.taken in (0, r.size, 2 * r.size)
        assert all(r.source_size == sizes[source[r.doc_id]] for r in rows)
        # The rule as it is told: share by weight, cap, deal the excess again.
        order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        want, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
        while open_ and left > 1e-9:
            total = sum(weight[s] for s in open_)
            for s in open_:
                want[s] += left * weight[s] / total
            left = sum(max(0, want[s] - 2 * sizes[s]) for s in open_)
            for s in list(open_):
                if want[s] >= 2 * sizes[s]:
                    want[s] = 2 * sizes[s]
                    open_.discard(s)
        for s in order:
            assert goal[s] == pytest.approx(want[s])
        if frame is not awkward:
            assert all(abs(taken[s] - goal[s]) <= 70 for s in order)
        again = {r.doc_id: r.taken for r in mixing.mix(frame.repartition(7)).collect()}
        assert again == {r.doc_id: r.taken for r in rows}


@pytest.mark.parametrize(("block", "turn"), [(embeddings.BLOCK, embeddings.TURN), (7, 11)])
def test_embeddings(spark, monkeypatch, block, turn):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "TURN", turn)
    rng = np.random.default_rng(4)
    rows = []
    centres = rng.standard_normal((5, 64))
    for i in range(300):
        v = centres[i % 5] + rng.standard_normal(64) * rng.choice([0.02, 0.08, 0.12]) if i % 3 else rng.standard_normal(64)
        rows.append((i, [float(x) for x in v * rng.choice([1.0, 1e-9, 1e9])], i % 2 if i % 11 else None))
    rows += [(300 + i, rows[1][1], 1) for i in range(4)]
    bad = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64, [1.0, 2.0]]
    rows += [(400 + i, v, 1) for i, v in enumerate(bad)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node long, n long").repartition(4)
    good = [(i, np.array(v) / np.linalg.norm(np.array(v)), x) for i, v, x in rows if x is not None and i < 400]
    links, count = Links([r[0] for r in rows]), dict.fromkeys([r[0] for r in rows], 0)
    for n, (a, u, x) in enumerate(good):
        for b, v, y in good[n + 1 :]:
            if x == y and u @ v >= 0.98:
                links.link(a, b)
                count[a] += 1
                count[b] += 1
    got = embeddings.near_duplicates(frame).collect()
    assert len(got) == len(rows) and sum(count.values()) > 1000
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], links.root(r.vec_id), links.root(r.vec_id) == r.vec_id)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)) * 2
    p = suffix = embeddings.e8(x) / 2
    assert suffix is p
    for row, point in zip(x, p, strict=True):
        assert (point * 2 % 2 == (point * 2 % 2)[0]).all() and point.sum() % 2 == 0
        # No shortest lattice vector leads closer.
        steps = [s for s in np.stack(np.meshgrid(*[[-0.5, 0.5]] * 8), -1).reshape(-1, 8) if s.sum() % 2 == 0]
        for i in range(8):
            for j in range(i):
                for a in (-1, 1):
                    for b in (-1, 1):
                        s = np.zeros(8)
                        s[i], s[j] = a, b
                        steps.append(s)
        far = ((row - point) ** 2).sum()
        assert min(((row - point - s) ** 2).sum() for s in steps) >= far - 1e-9
