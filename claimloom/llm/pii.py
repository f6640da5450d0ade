"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Four base kinds (email, ip, card, phone) are matched by fixed rules and always
kept. Looser generators propose further, possibly overlapping spans (access
keys and passwords with a cue or without, national ids, bank accounts with spaces
or without, mail addresses spelled out in four languages);
gradient-boosted trees score each from its format and context, a threshold for
each kind is calibrated on held-out examples to ``TARGET_PRECISION``, and of
overlapping proposals the likeliest stays. The trees are fitted once on the
driver on ``TRAIN_EXAMPLES`` generated examples, so no corpus data is gathered.

All scans are linear in the text, also for very long digit or letter runs.

Defined cases: a null text is an empty one and has no span; offsets are code
points, ends exclusive; proposals that touch a base span are dropped; repeated
rows are treated alike.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import releasing

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "national_id", "account", "spelled_email")
KINDS = BASE_KINDS + MORE_KINDS
TRAIN_EXAMPLES = 9000
TARGET_PRECISION = 0.97

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at  # what lies before a failed sign can't start a later match
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base kinds, by start and then kind."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                    out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_CUES = r"pass(?:word|wd|code|phrase|wort)?|pwd|token|secret|api[ _-]?key|access[ _-]?key|auth|bearer|credentials?|contraseña|clave|mot de passe|kennwort|schlüssel"
_KEYISH = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{10,}+(?![A-Za-z0-9_/+-])")
_CUED = re.compile(rf"(?<![A-Za-z])(?:{_CUES})[\"']? ?[:=] ?[\"']?(?P<value>[^\s\"']{{6,}}+)", re.I)
_NATIONAL = [
    re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"),
    re.compile(r"(?<![0-9A-Za-z])[0-9]{8}-?[A-Z](?![0-9A-Za-z])"),
    re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])"),
    re.compile(r"(?<![0-9A-Za-z])[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D](?![0-9A-Za-z])"),
]
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AT, _DOT = r"(?:at|arroba|arobase|ät|\(a\)|\[a\])", r"(?:dot|punto|point|punkt)"
_DOT_WORD = re.compile(rf"(?<![^\W_]){_DOT}(?![^\W_])", re.I)
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]? ?{_AT} ?[\])]? ?[A-Za-z0-9-]++(?: ?[\[(]? ?{_DOT} ?[\])]? ?[A-Za-z0-9-]++)++", re.I)
_CUE = re.compile(_CUES, re.I)
_ID_CUE = re.compile(r"ssn|social|national|insurance|tax|passport|identity|dni|nif|sécu|steuer|ausweis|seguridad", re.I)
_BANK_CUE = re.compile(r"iban|account|bank|konto|compte|cuenta", re.I)
_MAIL_CUE = re.compile(r"mail|contact|write|reach|écri|schreib|escrib|correo|courriel", re.I)
_OTHER_CUE = re.compile(r"commit|build|checksum|sha|md5|etag|version|file|figure|page|section|chapter|isbn|doi|see|part|rev|model|image|datei|fichier", re.I)
_KNOWN_KEY = re.compile(r"AKIA|ASIA|gh[pousr]_|sk_|pk_|xox[abp]-|AIza|glpat-|eyJ|ya29")
_TLD = frozenset("com org net edu gov info io de fr es eu uk ch at nl it example".split())


def proposals(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals beyond the base kinds; they may overlap."""
    out = [("secret", m.start("value"), m.end("value")) for m in _CUED.finditer(text)]
    if _DIGIT.search(text):
        out += [("secret", m.start(), m.end()) for m in _KEYISH.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
        out += [("national_id", m.start(), m.end()) for pattern in _NATIONAL for m in pattern.finditer(text)]
        out += [("account", m.start(), m.end()) for m in _ACCOUNT.finditer(text)]
    if _DOT_WORD.search(text):
        out += [("spelled_email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    return list(dict.fromkeys(out))


def _checked_id(s: str) -> float:
    """1 or -1 as the check letter or number of an id is right or wrong, 0 if it has none."""
    plain = re.sub("[ -]", "", s)
    if len(plain) == 9 and plain[:8].isdigit() and plain[8].isalpha():
        return 1.0 if _DNI_LETTERS[int(plain[:8]) % 23] == plain[8] else -1.0
    if len(plain) == 15 and plain.isdigit():
        return 1.0 if 97 - int(plain[:13]) % 97 == int(plain[13:]) else -1.0
    return 0.0


#: Check letters by remainder.
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and cues in the 32 characters around it."""
    s, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    n = len(s)
    digits = sum(c.isdigit() for c in s)
    counts = Counter(s)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    tail = before.rstrip()[-1:]
    letters = [len(x) for x in re.findall(r"[A-Za-z]+", s)]
    return [
        float(KINDS.index(kind)),
        float(n),
        digits / n,
        sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        sum(c.isupper() for c in s) / n,
        entropy,
        switches / n,
        float(sum(c in "-_/+ ." for c in s)),
        float(bool(_CUE.search(before))),
        float(bool(_ID_CUE.search(before))),
        float(bool(_BANK_CUE.search(before))),
        float(bool(_MAIL_CUE.search(before))),
        float(tail in ("=", ":", '"', "'")),
        float(after[:1] in ('"', "'")),
        float(kind == "account" and _iban_ok(s)),
        float("dot" in s and any(c in s for c in "[(")),
        float(bool(_OTHER_CUE.search(before[-16:]))),
        float(bool(_KNOWN_KEY.match(s))),
        float(any(c.isupper() for c in s)) + float(any(c.islower() for c in s)) + float(digits > 0),
        max(letters, default=0) / n,
        float(s.rsplit(" ", 1)[-1].strip("[]()").rsplit("]", 1)[-1].rsplit(")", 1)[-1].lower() in _TLD),
        float(len(s.split())),
        _checked_id(s) if kind == "national_id" else 0.0,
    ]


class Trees:
    """Gradient boosting of small regression trees on the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.prior, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(c, np.linspace(0.03, 0.97, 32))) for c in x.T]
        raw = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            raw += self.rate * self._apply(tree, x)
            self.trees.append(tree)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-9, None, None)
        if depth and len(rows) >= 20:
            for f, edges in enumerate(cuts):
                bins = np.searchsorted(edges, x[rows, f])
                sg = np.cumsum(np.bincount(bins, g[rows], len(edges) + 1))[:-1]
                sh = np.cumsum(np.bincount(bins, h[rows], len(edges) + 1))[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, edges[int(gain.argmax())])
        if best[1] is None:
            return total_g / (total_h + 1)
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, cuts, rows[left], depth - 1), self._grow(x, g, h, cuts, rows[~left], depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        return np.where(left, self._apply(tree[2], x), self._apply(tree[3], x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.prior)
        for tree in self.trees:
            raw += self.rate * self._apply(tree, x)
        return 1 / (1 + np.exp(-raw))


def _examples(n: int, seed: int) -> list[tuple[str, int]]:
    """Generated texts with one marked span each, and whether it is personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    some = lambda a, b: int(rng.integers(a, b))
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: chars(lower, some(2, 12))
    cues = ["password", "token", "secret", "api_key", "api key", "auth token", "access key", "passwd", "client_secret", "bearer", "Passwort", "contraseña", "mot de passe", "clave", "credentials"]

    def cued() -> tuple[str, int]:
        quote = pick(['"', "'", "", ""])
        value = pick([chars(hexa, some(12, 65)), chars(lower + upper + digit, some(12, 48))]) + pick(digit) + pick(lower)
        return f"{pick(cues)}{pick(['=', ' = ', ': ', '=', ' '])}{quote}\x00{value}\x01{quote}", 1

    def short_password() -> tuple[str, int]:
        value = pick([word() + chars(digit, some(1, 4)) + pick("!#$%&*?"), chars(lower + upper + digit + "!#$%&*?", some(7, 16)), word().title() + word() + chars(digit, 2)])
        return f"{pick(cues)}{pick(['=', ' = ', ': '])}\x00{value}\x01", 1

    def key() -> tuple[str, int]:
        value = pick(["AKIA" + chars(upper + digit, 15) + pick(digit), "ghp_" + chars(lower + upper + digit, 35) + pick(digit), "sk_live_" + chars(lower + upper + digit, 23) + pick(digit), "AIza" + chars(lower + upper + digit + "-_", 34) + pick(digit), "xoxb-" + chars(digit, 11) + "-" + chars(lower + upper + digit, 24), chars(lower + upper + digit + "+/", some(30, 60)) + pick(digit)])
        return f"{pick(['', '', word() + ' ', 'key ', 'uses '])}\x00{value}\x01", 1

    def ssn() -> tuple[str, int]:
        return f"{pick(['SSN', 'social security', 'national id', 'tax id', 'no.', ''])} \x00{chars(digit, 3)}-{chars(digit, 2)}-{chars(digit, 4)}\x01", 1

    def checked_id() -> tuple[str, int]:
        hit = int(rng.random() < 0.6)
        if pick([0, 1]):
            number = chars(digit, 8)
            letter = _DNI_LETTERS[int(number) % 23]
            letter = letter if hit else pick([x for x in _DNI_LETTERS if x != letter])
            return f"{pick(['DNI', 'NIF', '', 'ref'])} \x00{number}{pick(['', '-'])}{letter}\x01", hit
        body = pick("12") + chars(digit, 12)
        check = 97 - int(body) % 97
        check = check if hit else check % 97 + 1
        return f"{pick(['sécu', 'NIR', '', 'ref'])} \x00{body[0]} {body[1:3]} {body[3:5]} {body[5:7]} {body[7:10]} {body[10:]} {check:02d}\x01", hit

    def insurance() -> tuple[str, int]:
        hit = int(rng.random() < 0.6)
        return f"{pick(['insurance', 'national insurance no']) if hit else pick(['part', 'model', 'file'])} \x00{chars(upper, 2)} {chars(digit, 2)} {chars(digit, 2)} {chars(digit, 2)} {pick('ABCD')}\x01", hit

    def iban() -> tuple[str, int]:
        body = pick(["DE", "FR", "ES", "GB", "NL"]) + "00" + chars(digit, some(14, 24))
        number = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        body = f"{body[:2]}{number:02d}{body[4:]}"
        if pick([0, 1]):
            body = " ".join(body[i : i + 4] for i in range(0, len(body), 4))
        return f"{pick(['IBAN', 'account', 'bank', 'Konto', 'cuenta', ''])} \x00{body}\x01", 1

    def not_iban() -> tuple[str, int]:
        body = pick(upper) + pick(upper) + chars(digit, 2) + chars(digit + upper, 4 * some(2, 6))
        return f"{pick(['', 'model', 'see', 'part'])} \x00{body}\x01", int(_iban_ok(body))

    def spelled() -> tuple[str, int]:
        at, dot = pick([" at ", " [at] ", " (at) ", " arroba ", " arobase "]), pick([" dot ", " [dot] ", " (dot) ", " punto ", " point ", " punkt "])
        labels = dot.join([word() for _ in range(some(1, 3))] + [pick(["com", "org", "net", "de", "fr", "es", "example"])])
        return f"{pick(['mail', 'contact', 'write to', '', ''])} \x00{word()}{at}{labels}\x01", 1

    def not_spelled() -> tuple[str, int]:
        return f"{word()} \x00{pick(['look', 'stand', word()])} at {pick(['the', 'a', word()])} {pick(['dot', 'point'])} {pick(['by', 'of', 'in', word(), word()])}\x01", 0

    def name() -> tuple[str, int]:
        value = pick([word() + "-" + word() + chars(digit, 2), word() + chars(digit, some(1, 4)) + word(), "part" + chars(digit, 3) + "-" + word(), chars(digit, 4) + "-" + word() + "-" + word(), word() + "_" + word() + "_" + pick(digit), word() + "/" + word() + "/" + word() + pick(digit), word().title() + word().title() + pick(digit)])
        return f"{pick(['see', 'section', 'chapter', 'page', 'version', 'file', ''])} \x00{value}\x01", 0

    def digest() -> tuple[str, int]:
        value = pick([chars(hexa, pick([12, 32, 40, 64])) + pick(["", "a1"]), chars(digit, 3) + "-" + chars(lower, 8) + "-" + chars(digit, 4), chars(digit, 10) + word(), f"{chars(hexa, 8)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 12)}"])
        return f"{pick(['commit', 'build', 'figure', 'isbn', 'doi', 'checksum', 'sha', 'md5', 'etag'])} \x00{value}\x01", 0

    kinds = [cued, cued, short_password, key, ssn, checked_id, insurance, iban, not_iban, spelled, not_spelled, name, name, digest]
    out = []
    while len(out) < n:
        text, hit = pick(kinds)()
        out.append((f"{word()} {word()} {text}{pick([' ', '. ', ', '])}{word()} {word()}.", hit))
    return out


class Taken:
    """Places of a text that spans cover: a new span goes in if it meets none of them.

    Spans are kept merged in order, so a look-up is a bisection; spans of the
    base kinds may meet one another and are joined.
    """

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            elif a < b:
                self.starts.append(a)
                self.ends.append(b)

    def put(self, a: int, b: int) -> bool:
        at = bisect.bisect_right(self.ends, a)
        if at < len(self.starts) and self.starts[at] < b:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


class Selector:
    """Trees with one calibrated threshold for each kind of proposal."""

    def __init__(self, examples: int = TRAIN_EXAMPLES, seed: int = 11):
        rows, labels = [], []
        for marked, hit in _examples(examples, seed):
            a = marked.index("\x00")
            b = marked.index("\x01") - 1
            text = marked.replace("\x00", "").replace("\x01", "")
            kinds = {k for k, s, e in proposals(text) if s < b and e > a}
            for kind in kinds:
                rows.append(features(text, kind, a, b))
                labels.append(hit)
        x, y = np.array(rows), np.array(labels, float)
        fit = np.arange(len(y)) % 3 != 0
        self.trees = Trees().fit(x[fit], y[fit])
        p, held = self.trees.probability(x[~fit]), y[~fit]
        self.threshold = {}
        for kind in MORE_KINDS:
            own = x[~fit][:, 0] == KINDS.index(kind)
            order = np.argsort(-p[own])
            precision = np.cumsum(held[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(precision >= TARGET_PRECISION)
            self.threshold[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1

    def spans(self, text: str) -> list[tuple[str, int, int, float]]:
        """All spans, base ones with score 1, by start and then kind."""
        base = base_spans(text)
        found = proposals(text)
        chosen: list[tuple[str, int, int, float]] = []
        if found:
            p = self.trees.probability(np.array([features(text, *c) for c in found]))
            ranked = sorted(zip(found, p.tolist(), strict=True), key=lambda x: (-x[1], x[0][1], -x[0][2]))
            taken = Taken((a, b) for _, a, b in base)
            for (kind, a, b), q in ranked:
                if q >= self.threshold[kind] and taken.put(a, b):
                    chosen.append((kind, a, b, q))
        return sorted([*((*x, 1.0) for x in base), *chosen], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def digest(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def detect(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """``docs`` with the column ``spans``: array<struct<kind, start, end, score>>."""
    sent = docs.sparkSession.sparkContext.broadcast(selector or Selector())
    keep = [c for c in docs.columns if c != "spans"]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    where = keep.index("text")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value.spans
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            got = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t or "")] for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*keep, "spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("spans", _SPAN)]))


def redact_text(text: str, spans: list[tuple]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind."""
    out, at, done = [], 0, 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[at:a], f"[{kind.upper()}]"]
        done = at = max(done, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced; null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(selector or Selector())
    where = docs.columns.index("text")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value.spans
        for batch in batches:
            texts = [t if not t or not (s := find(t)) else redact_text(t, s) for t in batch.column(where).to_pylist()]
            columns = list(batch.columns)
            columns[where] = pa.array(texts, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def summary(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """Counts and digests of the spans of every row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(selector or Selector())

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value.spans
        for batch in batches:
            counts, sha, all_spans, n_spans = [], [], [], []
            for t in batch.column(1).to_pylist():
                spans = find(t or "")
                base = [s for s in spans if s[0] in BASE_KINDS]
                counts.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
                sha.append(hashlib.sha256(digest(base).encode()).hexdigest())
                all_spans.append(digest(spans))
                n_spans.append(len(spans))
            table = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(4)), pa.array(sha, pa.string()), pa.array(all_spans, pa.string()), pa.array(n_spans, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]))
