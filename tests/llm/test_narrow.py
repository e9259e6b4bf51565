"""Operators that look at one document at a time, and packing."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from visitprep.llm import licenses, media, packing, pii, quality


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), m.end(), k) for k, (p, ok) in patterns.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_as_the_patterns_say():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("ab1.2 3-+@()9_é") for _ in range(40))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("4" * 20_000 + "@" + "a" * 20_000) == []


def test_tagger_on_new_windows():
    tagger = pii.trained()
    x, y = pii.generated(np.random.default_rng(77), 200)
    tags = tagger.decode(x)
    assert (tags == y).mean() > 0.95
    assert pii.redacted("call (555) 123-4567 now", pii.tagged_spans(tagger, ["call (555) 123-4567 now"])[0]) == "call [PHONE] now"
    assert pii.tagged_spans(tagger, ["", "no trigger here", "x" * 500]) == [[], [], []]


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.fresh(rng)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    x, y = pii.generated(rng, 2)
    x, y = x[:, :12], y[:, :12]

    def loss():
        e, _ = tagger.emissions(x)
        alpha = tagger.w["first"] + e[:, 0]
        gold = alpha[np.arange(2), y[:, 0]]
        for t in range(1, 12):
            alpha = np.log(np.exp(alpha[:, :, None] + tagger.w["move"]).sum(axis=1)) + e[:, t]
            gold = gold + tagger.w["move"][y[:, t - 1], y[:, t]] + e[np.arange(2), t, y[:, t]]
        return (np.log(np.exp(alpha).sum(axis=1)) - gold).mean()

    grads = tagger.gradients(x, y)
    for name in ("move", "out", "rec_f", "in_b", "bias_f"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept, step = tagger.w[name][at], 1e-3
        tagger.w[name][at] = kept + step
        up = loss()
        tagger.w[name][at] = kept - step
        down = loss()
        tagger.w[name][at] = kept
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


def test_long_names_at_window_edges():
    """A name whose head stands in a window without a digit or at sign is redacted whole."""

    class Exact:
        def decode(self, x):
            tags = np.zeros(x.shape, np.int8)
            for row, out in zip(x, tags, strict=True):
                if m := re.search(r"[a-z]+ @ host\.com", "".join(chr(c + 30) for c in row)):
                    out[m.start() : m.end()] = 2
                    out[m.start()] = 1
            return tags

    for k in range(64):
        lead = "Z " * 40 + "Z" * k + " "
        text = f"{lead}{'abcdefghij' * 3} @ host.com end"
        (base, spans), = pii.find(Exact(), [text])
        assert not base and pii.redacted(text, spans) == f"{lead}[EMAIL] end"


def test_pii_columns(awkward, empty):
    rows = pii.scan(awkward).collect()
    assert len(rows) == awkward.count() and all(r.n_email == 0 for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.scan(empty).count() == 0
    kept = pii.redact(awkward.select("doc_id", "text"), keep=["doc_id", "text"]).collect()
    assert sum(r.text is None for r in kept) == 1


def test_word_encoder_is_the_tokenizer():
    enc = packing.WordEncoder(packing.default_tokenizer())
    odd = ["It's we'll <|endoftext|> x", "áb c", "İstanbul Σας ΣΑΣ", "x\x1cy z\x85w", "naïve “quoted” text’s 123 4a5", "漢字 text'S DON'T", "", "\n\n", "ab\x0bcd\x0cef", "Straße ẞ 12ß3", "á ́b"]
    odd += [f"a{chr(c)}b {chr(c)}{chr(c)}'s" for c in range(1, 0x600)]
    for text in odd + odd:
        assert enc.encode(text) == enc.direct(text), text


def test_best_fit():
    rng = random.Random(2)
    for open_bins in (1, 3, 50):
        bins, fill = packing.BestFit(100, open_bins), {}
        for _ in range(3000):
            size = rng.randint(1, 100)
            at, offset = bins.place(size)
            assert fill.get(at, 0) == offset and offset + size <= 100
            fill[at] = offset + size
            assert bins.n_open <= open_bins
    assert len(fill) < 1.04 * sum(fill.values()) / 100 + 1


def test_pack(awkward, empty):
    rows = packing.pack(awkward, capacity=512).collect()
    assert packing.pack(empty).count() == 0
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 512
    enc = packing.WordEncoder(packing.default_tokenizer())
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    for r in rows:
        ids = (enc.direct(texts[r.doc_id]) + b"\1\0\0\0")[4 * r.start : 4 * (r.start + r.length)]
        assert zlib.crc32(ids) == r.ids_crc32 and r.start == r.piece * 512


def test_pack_many_partitions(spark):
    """Sequences of many small tasks are joined to nearly as few as the tokens need."""
    rng = random.Random(8)
    frame = spark.createDataFrame([(i, "word " * rng.randint(1, 150)) for i in range(600)], "doc_id long, text string")
    rows = packing.pack(frame.repartition(48), capacity=512).collect()
    assert len(rows) == 600
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 512
    least = -(-sum(r.length for r in rows) // 512)
    assert len(places) <= 1.05 * least + 1


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_media_round_trip(n, monkeypatch):
    payload = media.pad(os.urandom(n))
    assert len(payload) % media.GRANULE == 0 and len(payload) > 0
    image = media.read(data := media.encode_payload(payload))
    assert media.payload_of(image) == payload
    # The general decoder, symbol by symbol, agrees with the array forms.
    monkeypatch.setattr(media, "_uniform_first", lambda *a: None)
    monkeypatch.setattr(media, "_uniform_refine", lambda *a: None)
    slow = media.read(data)
    assert media.payload_of(slow) == payload and (media.rgb(slow) == media.rgb(image)).all()


def test_inverse_transform_and_upsampling():
    block = np.zeros((1, 64))
    block[0, 0], block[0, 2] = 40, -25
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(1 / 8), 0.5)
    f = np.zeros((8, 8))
    f[0, 0], f[1, 0] = 40, -25
    want = np.array([[sum(c[v] * c[w] * f[v, w] * np.cos((2 * y + 1) * v * np.pi / 16) * np.cos((2 * x + 1) * w * np.pi / 16) for v in range(8) for w in range(8)) for x in range(8)] for y in range(8)])
    assert np.allclose((block @ media.BASIS).reshape(8, 8), want, atol=1e-4)
    tensor = media.decode(media.encode_payload(b"\x80" * 576))
    assert tensor.shape[2] == 3 and tensor.dtype == np.uint8
    with pytest.raises(ValueError, match="JPEG"):
        media.decode(b"text")


def test_general_scans():
    """A one-block grey image by hand: DC refinement, runs of zeros, new values while refining."""
    bits = lambda s: int(s + "1" * (-len(s) % 8), 2).to_bytes((len(s) + 7) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC2, b"\x08\0\x08\0\x08\1\1\x11\0")
    tables = seg(0xC4, bytes([0x00, 0, 1, 0, *[0] * 13, 3]) + bytes([0x10, 0, 3, *[0] * 14, 0x00, 0x11, 0x01]))
    scan = lambda ss, se, hl, s: seg(0xDA, bytes([1, 1, 0, ss, se, hl])) + bits(s)
    # DC 5 << 1, then its low bit; AC: skip one, value +1 << 1 at place 2, end; refine: new -1 at 1, old bit 1, end.
    data = head + tables + scan(0, 0, 0x01, "00" + "101") + scan(0, 0, 0x10, "1") + scan(1, 63, 0x01, "01" + "1" + "00") + scan(1, 63, 0x10, "10" + "0" + "00" + "1") + b"\xff\xd9"
    block = media.read(data).components[0].coefficients[0, 0]
    assert block[0] == 11 and block[1] == -1 and block[2] == 3 and not block[3:].any()


def test_media_columns(awkward, empty):
    rows = media.store(awkward, with_media=True).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in awkward.collect()}
    for r in rows:
        payload = media.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.tensor.rgb) == 3 * r.tensor.height * r.tensor.width
    same = {r.media_sha256 for r in rows if r.doc_id in (7, 10)}
    assert len(same) == 1 and media.store(empty).count() == 0


def test_templates():
    a = licenses.compile_template("x", "<<one:released|licensed>> under the <<optional>>terms of the<<end>> mit license <<any:2>> done")
    for text, ok in (("released under the MIT-License, done", True), ("Licensed under the terms of the MIT license now or done", True), ("licensed under the terms of mit license done", False), ("released under the mit license a b c done", False)):
        assert (max(a.match(w, i) for i in range(len(w))) >= 0 if (w := licenses.words_of(text.encode())) else False) == ok
    auto = [licenses.compile_template(k, v) for k, v in licenses.TEMPLATES.items()]
    text = "Licensed under CC BY-NC 4.0. All rights reserved; cc by cc by"
    n, base, spans = licenses.scan_text(text.encode(), auto)
    assert n == 14 and base == [(2, "cc-by"), (7, "reserved"), (10, "cc-by"), (12, "cc-by")] and (0, 7, "cc-by-nc-4.0") in spans


def filled(markup):
    """A text that a template accepts: optional regions kept, the first choice taken, holders named."""
    markup = re.sub(r"<<one:([^|>]*)[^>]*>>", r"\1", markup.replace("<<optional>>", "").replace("<<end>>", ""))
    return re.sub(r"<<any:[0-9]+>>", "x", markup)


@pytest.mark.parametrize("label", licenses.BODIES)
def test_license_bodies(label):
    auto = licenses.compile_template(label, licenses.BODIES[label])
    words = filled(licenses.BODIES[label]).split()
    text = "Before. " + ", ".join(w.upper() for w in words) + " after"
    assert licenses.scan_text(text.encode(), [auto])[2] == [(1, 1 + len(words), label)]
    # Every word counts but those inside regions: a changed one in the first or last phrase is refused.
    for at in (0, len(words) - 1):
        changed = [*words[:at], "other", *words[at + 1 :]]
        assert licenses.scan_text(" ".join(changed).encode(), [auto])[2] == []


def test_license_markup():
    auto = licenses.compile_template("t", "one two three <<optional>>four <<optional>>five<<end>> six<<end>> seven eight")
    accepted = ["one two three seven eight", "one two three four six seven eight", "one two three four five six seven eight"]
    refused = ["one two three five seven eight", "one two three four seven eight", "one two three six seven eight"]
    assert [len(licenses.scan_text(t.encode(), [auto])[2]) for t in accepted + refused] == [1, 1, 1, 0, 0, 0]
    for bad in ("<<optional>>a<<end>>", "a <<optional>>b"):
        with pytest.raises(ValueError, match="mandatory"):
            licenses.compile_template("t", bad)


def test_license_base_by_brute_force(awkward, empty):
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["cc", "BY", " ", "-", "all", "Rights", "reserved", "é", "general public license", "\x1f", " "]) for _ in range(12))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        n, base, _ = licenses.scan_text(text.encode(), [])
        assert n == len(words) and base == want
    rows = licenses.scan(awkward).collect()
    assert all(0 <= r.score <= 1 and r.first_word is None for r in rows) and licenses.scan(empty).count() == 0


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 80))]
        label = rng.random() < 0.8
        if not label:
            words = rng.choice([[w.upper() + "!!" for w in words], [words[0]] * len(words), [x for w in words for x in (w, "|")]])
        docs.append((i, " ".join(words), int(label)))
    return docs


def test_quality_held_out():
    docs = corpus(random.Random(5), 900)
    model = quality.fit([(t.encode().split(), y) for _, t, y in docs[:600]])
    scorer = quality.Scorer(model.weights(), float(model.prior[1] - model.prior[0]))
    scores = scorer.score([t.encode() for _, t, _ in docs[600:]])
    right = np.mean([(s >= quality.THRESHOLD) == y for s, (_, _, y) in zip(scores, docs[600:], strict=True)])
    assert right > 0.97
    assert (scorer.score([b"", b" "]) == scorer.score([b""])[0]).all()


def test_quality_columns(spark, awkward, empty):
    docs = corpus(random.Random(6), 120)
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(None, 1), (3, None)], "doc_id long, quality int")
    sample = quality.training_rows(frame, labels)
    assert sample.filter(quality.held_out(sample.doc_id)).count() == 0
    model = quality.train(sample)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert quality.score(empty, model).count() == 0


def test_numbers_of_thousands_of_digits(spark):
    zeros = "0" * 5000
    texts = [f"{zeros}1.1.1.1 x", f"1.{zeros}.3.{zeros}9", f"{zeros}256.1.1.1", f"+{zeros} 12", f"card {zeros}", f"a {'9' * 6000}.1.1.1"]
    assert [[k for _, _, k in pii.base_spans(t)] for t in texts] == [["ip"], ["ip"], [], [], [], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.n_ip for r in pii.scan(docs).collect()) == [0, 0, 0, 0, 1, 1]
    assert pii.redact(docs, keep=["doc_id", "text"]).count() == len(texts)
