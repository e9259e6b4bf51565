"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The patterns give the base spans.  The tagger reads overlapping windows of characters, forwards and
backwards; a CRF scores the tag sequence of each window and Viterbi decodes it.  Windows are
reconciled over the whole text: each character takes its tag from the window in whose middle it
stands, and spans are read off the joined sequence.  Every span of the tagger's kinds holds a digit or
an at sign, so a window without either is not decoded; the name of an e-mail that starts in such a window
is taken whole from the span's start leftwards.  The tagger is trained in
numpy from labelled spans, which a seeded generator writes in many formats, near misses included.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 16, 12
TRAIN_STEPS, TRAIN_BATCH, RATE, SEED = 260, 48, 0.02, 11
#: Characters: 0 line end, 1 anything else, then printable ASCII.
N_CHARS = 2 + 95
N_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Windows decoded in one numpy step.
BATCH_WINDOWS = 2048

Span = tuple[int, int, str]

# ---- fixed patterns ----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only start where a run of digits starts; so started, the scan is linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[Span]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            at = done = m.end()
        else:
            at += 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; leftmost and non-overlapping in each kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split(".")))]
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# ---- labelled spans ----------------------------------------------------------------------------


def generated(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows of character codes and tags, with labelled spans and near misses in filler."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda a=2, b=10: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))
    foreign = lambda: word().replace("e", "é").replace("u", "ü")

    def filler() -> str:
        w = foreign() if rng.random() < 0.2 else word()
        w = w.upper() if rng.random() < 0.15 else w.capitalize() if rng.random() < 0.2 else w
        return w + pick("", "", "", "", ",", ".", "!!", "###", "$$$", ".\n")

    def positive() -> tuple[str, str]:
        kind = pick(*KINDS)
        if kind == "email":
            domain = ".".join([word(3, 9) + pick("", digits(1)), *pick(("example", "com"), ("com",), ("org",), ("co", "uk"))])
            return kind, pick(word() + "." + digits(2), word() + pick(".", "_", "-", "+") + word(), word() + digits(2), word()) + pick("@", "@", "@", " @ ", "(@)") + domain
        if kind == "ip":
            return kind, ".".join(str(x) for x in rng.integers(0, 256, 4)) + pick("", "", ":" + digits(4))[:0]
        if kind == "card":
            k = pick(14, 15, 16, 16, 16, 16, 19)
            d = pick("4", "5", "3", "9") + digits(k - 1)
            return kind, pick(d, " ".join(d[i : i + 4] for i in range(0, k, 4)), "-".join(d[i : i + 4] for i in range(0, k, 4)))
        a, b, c = digits(3), digits(3), digits(4)
        return kind, pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {c} {c}", f"+1 {a} {b} {c}")

    def negative() -> str:
        hexa = "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, 40))
        return pick(f'token = "{hexa}"', f"version {digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", digits(2), digits(4), f"${digits(3)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"@{word()}", f"BY 4.{digits(1)}.", hexa.upper())

    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text, tags = "", []
        while len(text) < 3 * WINDOW:
            roll, kind = rng.random(), None
            if roll < 0.17:
                kind, piece = positive()
            else:
                piece = negative() if roll < 0.27 else filler()
            piece += "" if kind else " "
            text += piece
            at = 1 + 2 * KINDS.index(kind) if kind else 0
            tags += [at] + [at + 1] * (len(piece) - 1) if kind else [0] * len(piece)
            if kind:
                after = pick(" ", " ", " ", ". ", ", ", "!! ", "$$$ ", "\n")
                text, tags = text + after, tags + [0] * len(after)
        start = rng.integers(0, len(text) - WINDOW)
        x[row], y[row] = codes(text[start : start + WINDOW]), tags[start : start + WINDOW]
    return x, y


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 32) & (c < 127), c.astype(np.int64) - 30, np.where(c == 10, 0, 1))


# ---- the tagger --------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Weights: embeddings, two LSTMs (input, recurrent, bias; gates i, f, o, g), output, CRF."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Tagger:
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"embed": draw(N_CHARS, EMBED) * np.float32(np.sqrt(N_CHARS) / 2), "out": draw(2 * HIDDEN, N_TAGS), "out_b": np.zeros(N_TAGS, np.float32)}
        for d in "fb":
            w |= {f"in_{d}": draw(EMBED, 4 * HIDDEN), f"rec_{d}": draw(HIDDEN, 4 * HIDDEN), f"bias_{d}": np.zeros(4 * HIDDEN, np.float32)}
            w[f"bias_{d}"][HIDDEN : 2 * HIDDEN] = 1
        return Tagger(w | {"move": np.zeros((N_TAGS, N_TAGS), np.float32), "first": np.zeros(N_TAGS, np.float32)})

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states by time (n, window, hidden) of direction ``d``; what backpropagation needs."""
        n, steps = x.shape
        table = self.w["embed"] @ self.w[f"in_{d}"] + self.w[f"bias_{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape, rec = np.empty((n, steps, HIDDEN), np.float32), [], self.w[f"rec_{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + h @ rec
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                tape.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[:, t] = h
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, tf = self._lstm(x, "f", keep)
        hb, tb = self._lstm(x, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.w["out"] + self.w["out_b"], (h, tf, tb)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags of windows."""
        e, _ = self.emissions(x)
        n, steps, _ = e.shape
        score, back = self.w["first"] + e[:, 0], np.empty((steps, n, N_TAGS), np.int8)
        for t in range(1, steps):
            both = score[:, :, None] + self.w["move"]
            back[t] = both.argmax(axis=1)
            score = both.max(axis=1) + e[:, t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the tag sequences."""
        n, steps = x.shape
        e, (h, tf, tb) = self.emissions(x, keep=True)
        move, first = self.w["move"], self.w["first"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = first + e[:, 0]
        log_sum = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        for t in range(1, steps):
            alpha[:, t] = log_sum(alpha[:, t - 1][:, :, None] + move, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = log_sum(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = log_sum(alpha[:, -1], 1)
        de = np.exp(alpha + beta - total[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + move + (e + beta)[:, 1:, None, :] - total[:, None, None, None])
        grads = {"move": pair.sum(axis=(0, 1)) / n}
        np.subtract.at(grads["move"], (y[:, :-1], y[:, 1:]), np.float32(1 / n))
        np.subtract.at(de, (np.arange(n)[:, None], np.arange(steps), y), 1)
        de /= n
        grads |= {"first": de[:, 0].sum(axis=0), "out": np.einsum("nth,ntk->hk", h, de), "out_b": de.sum(axis=(0, 1)), "embed": np.zeros_like(self.w["embed"])}
        dh_all = de @ self.w["out"].T
        for d, tape in (("f", tf), ("b", tb)):
            own = dh_all[:, :, :HIDDEN] if d == "f" else dh_all[:, :, HIDDEN:]
            dz_all = np.empty((n, steps, 4 * HIDDEN), np.float32)
            grads[f"rec_{d}"] = np.zeros_like(self.w[f"rec_{d}"])
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, before_h, before_c, i, f, o, g, tc in reversed(tape):
                dh = dh + own[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                grads[f"rec_{d}"] += before_h.T @ dz
                dh, dc = dz @ self.w[f"rec_{d}"].T, dc * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            per_char = np.zeros((N_CHARS, 4 * HIDDEN), np.float32)
            np.add.at(per_char, x.reshape(-1), flat)
            grads[f"bias_{d}"] = flat.sum(axis=0)
            grads[f"in_{d}"] = self.w["embed"].T @ per_char
            grads["embed"] += per_char @ self.w[f"in_{d}"].T
        return grads


@functools.lru_cache(maxsize=4)
def trained(steps: int = TRAIN_STEPS, batch: int = TRAIN_BATCH, seed: int = SEED) -> Tagger:
    """A tagger fitted with Adam on generated windows; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    tagger = Tagger.fresh(rng)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    v = {k: np.zeros_like(x) for k, x in tagger.w.items()}
    x, y = generated(rng, 40 * batch)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), batch)
        grads = tagger.gradients(x[rows], y[rows])
        rate = RATE * min(1.0, 1.6 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            tagger.w[k] = (tagger.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


_PLAUSIBLE = {
    "email": re.compile(r"\S+\s?\(?@\)?\s?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}"),
    "phone": re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,14}"),
}


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans of the tagger in whole texts: windows decoded in batches, then reconciled."""
    starts, owners, windows, lengths = [], [], [], []
    for number, text in enumerate(texts):
        x = codes(text)
        n = max(1, -(-max(0, len(x) - WINDOW) // STRIDE) + 1)
        padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
        padded[: len(x)] = x
        trigger = ((padded >= 48 - 30) & (padded <= 57 - 30)) | (padded == 64 - 30)
        cover = np.concatenate([[0], np.cumsum(trigger)])
        at = np.arange(n) * STRIDE
        at = at[cover[at + WINDOW] > cover[at]]
        starts += at.tolist()
        owners += [number] * len(at)
        windows.append(padded[at[:, None] + np.arange(WINDOW)])
        lengths.append(len(x))
    out: list[list[Span]] = [[] for _ in texts]
    if not starts:
        return out
    x = np.concatenate(windows)
    tags = np.concatenate([tagger.decode(x[i : i + BATCH_WINDOWS]) for i in range(0, len(x), BATCH_WINDOWS)])
    edge, i = (WINDOW - STRIDE) // 2, 0
    while i < len(starts):
        number, last = owners[i], i
        whole = np.zeros(lengths[number] + WINDOW, np.int8)
        while last < len(starts) and owners[last] == number:
            s = starts[last]
            a, b = 0 if s == 0 else edge, WINDOW if s + WINDOW >= lengths[number] else WINDOW - edge
            whole[s + a : s + b] = tags[last, a:b]
            last += 1
        out[number] = _read_off(whole[: lengths[number]], texts[number])
        i = last
    return out


def _read_off(tags: np.ndarray, text: str) -> list[Span]:
    spans, kind = [], (tags + 1) // 2
    cuts = np.flatnonzero((np.diff(kind, prepend=0) != 0) | ((tags > 0) & (tags % 2 == 1)))
    for a, b in zip(cuts, np.append(cuts, len(tags))[1:], strict=True):
        if kind[a]:
            name = KINDS[kind[a] - 1]
            m = _PLAUSIBLE[name].fullmatch(text[a:b].strip())
            if m and (name != "card" or luhn(re.sub("[^0-9]", "", m[0]))):
                lead = len(text[a:b]) - len(text[a:b].lstrip())
                spans.append((int(a) + lead, int(a) + lead + m.end(), name))
    return spans


def find(tagger: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans: the tagger adds those that no base span overlaps."""
    triggered = [i for i, t in enumerate(texts) if "@" in t or _DIGIT.search(t)]
    extra = dict(zip(triggered, tagged_spans(tagger, [texts[i] for i in triggered]), strict=True))
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text)
        added: list[Span] = []
        for a, b, kind in extra.get(i, []):
            if all(b <= s[0] or a >= s[1] for s in base):
                # The head of a long name may stand in a window that is not decoded.
                floor = max([s[1] for s in base + added if s[1] <= a], default=0)
                while kind == "email" and a > floor and text[a - 1] in _LOCAL:
                    a -= 1
                added.append((a, b, kind))
        out.append((base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    parts, done, shown = [], 0, 0
    for a, b, kind in spans:
        if a >= done:
            parts += [text[shown:a], f"[{kind.upper()}]"]
        done = shown = max(done, b)
    return "".join([*parts, text[shown:]])


# ---- columns -----------------------------------------------------------------------------------


def _mapped(docs: DataFrame, columns: list[str], made: list[str], types: list[str], kinds: list[pa.DataType], row) -> DataFrame:
    """``columns`` and columns ``made`` from each text."""
    hidden = common.free_name("__text", [*columns, *docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(trained().w)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts, own = common.strings(batch, hidden), []
            for a, b in common.steps([len(t) for t in texts], 4 * common.STEP_BYTES):
                own += [row(t, *s) for t, s in zip(texts[a:b], find(tagger, texts[a:b]), strict=True)]
            values = list(zip(*own, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x, k) for x, k in zip(values, kinds, strict=True)]], names=[*batch.schema.names[:-1], *made])

    given = docs.select(*[F.col(c) for c in columns], F.col("text").alias(hidden))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop(hidden).schema]
    return given.mapInArrow(run, ", ".join([*fields, *[f"`{n}` {t}" for n, t in zip(made, types, strict=True)]]))


def scan(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans, and all spans of every document.

    Null and empty texts have no spans; repeated rows give equal rows; an empty table gives no rows;
    further columns are ignored.  Offsets are code points, ends exclusive.
    """

    def row(text: str, base: list[Span], spans: list[Span]) -> tuple:
        return (*[sum(s[2] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    return _mapped(docs, ["doc_id"], [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"], ["long"] * 4 + ["string"] * 2, kinds, row)


def redact(docs: DataFrame, *, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with every span in ``text`` replaced; a null text stays null.

    Repeated rows are replaced each; an empty table gives no rows.  ``keep`` has ``text`` and no name
    twice, or it raises; other names are free."""
    if "text" not in common.kept_columns(keep, ()):
        raise ValueError("keep has to have the column text, which is what is replaced")
    new = common.free_name("__new", [*keep, *docs.columns])
    out = _mapped(docs, keep, [new], ["string"], [pa.string()], lambda text, base, spans: (redacted(text, spans),))
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.col(new))).drop(new)
