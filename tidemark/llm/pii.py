"""Personal data: candidate generators, boosted trees over format and context, redaction.

Four base kinds are exact patterns and always stay. For the other kinds generators propose
spans with high recall, which may overlap; boosted trees score each one by its format and the
words around it, and those over a calibrated threshold are taken; those that overlap become
one span, of the kind of the best. A secret within a value that is assigned to a word for
credentials (token=...) takes all of that value, so that no tail is left; a private key takes all
its lines. Base spans are never changed; a learned span may overlap one, unless it lies within.
The trees learn from seeded made-up sentences (SAMPLES of them), never from the corpus.

Defined cases: a null text is empty and holds nothing; offsets are code points, ends exclusive;
rows with equal ids are judged one by one; of equal scores the longer span names the kind, then
the first; every scan is linear in the text, however long its runs of digits, letters or signs are.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, calibrate, fit, threshold
from .common import map_arrow, process_memory, read

BASE = ("email", "ip", "card", "phone")
LEARNED = ("email_spelled", "phone_local", "ip6", "iban", "national_id", "secret")
#: Made-up sentences that the trees and their calibration are fitted on, and the precision asked for.
SAMPLES, PRECISION, SEED = 6000, 0.99, 20240501

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@host.host, found from each @ outwards, so in linear time."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > floor and text[left - 1] in _LOCAL_CHARS:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        found["email"] = _emails(text)
    if re.search("[0-9]", text):
        if "." in text:
            found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


# --- candidates -----------------------------------------------------------------------------

#: A run of letters, digits and signs of base64; single dots join parts, as in signed tokens.
_RUN = re.compile(r"(?<![A-Za-z0-9_/+=.-])[A-Za-z0-9_/+-]++(?:\.[A-Za-z0-9_-]{8,}+)*+")
_GENERATORS = (
    ("phone_local", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
)
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]++(?![0-9A-Za-z:])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{2,}+)++", re.I)
_KEY_OPENS = re.compile(r"-----BEGIN [A-Z0-9 ]*+(?<=PRIVATE KEY)-----")
_KEY_CLOSES = re.compile(r"-----END [A-Z0-9 ]*+(?<=PRIVATE KEY)-----")
#: What follows an opening line that is never closed: lines of base64.
_KEY_LINES = re.compile(r"(?:\s{0,3}+[A-Za-z0-9+/=]{16,}+)*+")


def _is_ip6(s: str) -> bool:
    if not 2 <= s.count(":") <= 7 or len(s) > 39:
        return False
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return sum(c != ":" for c in s) > 1


def private_keys(text: str) -> list[tuple[int, int]]:
    """Blocks from BEGIN to the next END PRIVATE KEY line, or else as far as lines of base64 go; disjoint."""
    out, upto, closes = [], 0, None
    if "PRIVATE KEY-----" in text:
        for m in _KEY_OPENS.finditer(text):
            if m.start() < upto:
                continue
            if closes is None or closes.start() < m.end():
                closes = _KEY_CLOSES.search(text, m.end())
                if closes is None:
                    closes = _Nowhere
            upto = closes.end() if closes is not _Nowhere else _KEY_LINES.match(text, m.end()).end()
            out.append((m.start(), upto))
    return out


class _Nowhere:
    """The place of a closing line that isn't there: after everything."""

    start = end = staticmethod(lambda: math.inf)


_ASSIGNED = re.compile(r"[=:](?=\s{0,3}[\"']?[^\s\"']{6})")
_VALUE = re.compile(r"\s{0,3}[\"']?([^\s\"']{6,}+)")
_CREDENTIAL = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"' ]{0,3}$", re.I)


def assigned(text: str) -> list[tuple[int, int]]:
    """The values given to words for credentials, each to its end, however long; disjoint."""
    out, upto = [], 0
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if m.start() >= upto and _CREDENTIAL.search(text, max(0, m.start() - 24), m.start()):
                out.append(_VALUE.match(text, m.end()).span(1))
                upto = out[-1][1]
    return out


def whole(values: list[tuple[int, int]], start: int, end: int) -> tuple[int, int]:
    """The assigned value that holds the span, or else the span."""
    i = bisect_right(values, start, key=lambda v: v[0]) - 1
    return values[i] if i >= 0 and end <= values[i][1] else (start, end)


def candidates(text: str, values: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    if re.search("[0-9]", text):
        for kind, pattern in _GENERATORS:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
        out += [("secret", *m.span()) for m in _RUN.finditer(text) if m.end() - m.start() >= 16 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    if "::" in text or text.count(":") >= 7:
        out += [("ip6", *m.span()) for m in _IP6.finditer(text) if _is_ip6(m[0])]
    out += [("secret", *v) for v in values]
    out += [("secret", *k) for k in private_keys(text)]
    if "[" in text or "(" in text or "{" in text:
        out += [("email_spelled", *m.span()) for m in _SPELLED.finditer(text)]
    return list(dict.fromkeys(out))


_CONTEXT = tuple(
    re.compile(p, re.I)
    for p in (
        r"password|passwd|pwd|secret|token|api.?key|access|credential|login|auth",
        r"phone|tel|call|mobile|fax|cell|contact",
        r"ssn|social|national|passport|tax|identity",
        r"iban|account|bank|transfer",
        r"mail|write|reach",
        r"commit|sha|md5|hash|checksum|revision|build|digest",
        r"order|invoice|isbn|part|serial|item|ref|ticket|article|model|page|version",
        r"http|www|url|path|file|uuid|doi",
    )
)
_HEX = frozenset("0123456789abcdefABCDEF")


def _mod97(s: str) -> bool:
    s = re.sub("[^A-Z0-9]", "", s.upper())
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]) or "0") % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, left, right = text[start:end], text[max(0, start - 40) : start], text[end : end + 12]
    n = len(s)
    digits, uppers = sum(c.isdigit() for c in s), sum(c.isupper() for c in s)
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s).values()
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    return [
        n, digits / n, letters / n, uppers / n, sum(c in _HEX for c in s) / n, len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts), switches / n, digits,
        s.count("-"), s.count("/"), s.count("_"), s.count("."), n in (32, 40, 64), s[:4] == "AKIA" or s[:3] in ("sk_", "pk_", "ghp", "xox"), s[:3] == "eyJ", s[:11] == "-----BEGIN ",
        left.rstrip(" \"'")[-1:] in ("=", ":") and len(left) > 0, left[-1:] in ("\"", "'"), right[:1] in ("\"", "'"), left[-1:] in ("/", "#", "@"),
        *(p.search(left) is not None for p in _CONTEXT), kind == "iban" and _mod97(s), kind == "national_id" and s[:3] not in ("000", "666") and s[0] != "9",
        *(kind == k for k in LEARNED),
    ]


# --- training -------------------------------------------------------------------------------


def _made_up(rng: random.Random) -> tuple[str, str, str, int]:
    """A sentence's left side, span, right side and label."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: pick("abcdefghilmnoprstu", rng.randint(2, 9))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa = "0123456789abcdef"
    shape = rng.randrange(27)
    cue, value, y, quote = "", "", 1, ""
    if shape == 0:
        value, cue = "AKIA" + pick(up + "234567", 16), rng.choice(["", "", "key ", "access key: "])
    elif shape in (1, 2):
        cue, value = rng.choice(["token = ", "secret = ", "api_key=", "password: ", "auth token: "]), pick(hexa, rng.choice([24, 32, 40, 64]))
        quote = rng.choice(["", '"', '"'])
    elif shape == 3:
        cue, value = rng.choice(["password=", "pwd=", "passwd: ", "password = "]), pick(low + up + dig + "!#", rng.randint(8, 20))
    elif shape == 4:
        cue, value = rng.choice(["", "key "]), rng.choice(["sk_live_", "ghp_", "pk_test_"]) + pick(low + up + dig, rng.randint(20, 36))
    elif shape == 5:
        cue, value = rng.choice(["call ", "phone ", "tel. ", "mobile: ", "", "fax "]), rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(pick(dig, 3), pick(dig, 3), pick(dig, 4))
    elif shape == 6:
        cue, value = rng.choice(["SSN ", "social security ", "tax ", "ssn: "]), f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    elif shape == 7:
        body = "".join(rng.choice(dig) for _ in range(rng.choice([16, 18, 20])))
        land = rng.choice(["DE", "FR", "GB", "ES"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        cue, value = rng.choice(["IBAN ", "account ", ""]), f"{land}{check:02d}{body}"
    elif shape == 8:
        cue, value = rng.choice(["mail ", "write to ", ""]), f"{word()} [at] {word()} [dot] {rng.choice(['com', 'org', 'net'])}"
    elif shape == 9:
        cue, value = rng.choice(["ip ", "host ", ""]), ":".join(pick(hexa, 4) for _ in range(8))
    elif shape in (10, 11):
        cue, value, y = rng.choice(["commit ", "sha1 ", "md5 ", "checksum: ", "revision ", "build ", ""]), pick(hexa, rng.choice([16, 32, 40, 64])), 0
    elif shape == 12:
        cue, value, y = rng.choice(["", "see ", "the ", "from "]), "-".join(word() for _ in range(4)) + "-" + pick(dig, 4), 0
    elif shape == 13:
        cue, value, y = rng.choice(["order ", "invoice ", "part ", "serial ", "ref "]), pick(up + dig, rng.randint(16, 24)), 0
    elif shape == 14:
        cue, value, y = rng.choice(["order ", "isbn ", "part ", "item "]), f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}", 0
    elif shape == 15:
        cue, value, y = rng.choice(["order ", "article ", "part ", "model "]), f"{pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}", 0
    elif shape == 16:
        cue, value, y = rng.choice(["http://", "path ", "file "]), "/".join(word() for _ in range(4)) + "/" + pick(dig, 3), 0
    elif shape == 17:
        cue, value, y = rng.choice(["serial ", "part ", ""]), pick(up, 2) + pick(dig, 2) + pick(up + dig, 16), 0
    elif shape == 18:
        cue, value, y = rng.choice(["", "the "]), f"{word()} (at) {word()}. {word()}", 0
    elif shape == 19:
        cue, value, y = rng.choice(["", "uuid "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), 0
    elif shape in (20, 21):
        cue = rng.choice(["token=", "token = ", "secret = ", "api_key=", "access_key: ", "password: "])
        quote = rng.choice(["", '"'])
        if shape == 20:
            value = pick(low + up + dig + rng.choice(["", "+/", "_-", "!#"]), rng.randint(65, 1500))
        else:
            value = ".".join("eyJ" * (i < 2) + pick(low + up + dig + "_-", n) for i, n in enumerate((rng.randint(17, 60), rng.randint(40, 900), rng.choice([43, 86, 342]))))
    elif shape == 22:  # a signed token by itself
        cue = rng.choice(["", "", "bearer ", "header ", "cookie ", "see "])
        value = ".".join("eyJ" * (i < 2) + pick(low + up + dig + "_-", n) for i, n in enumerate((rng.randint(17, 60), rng.randint(40, 900), rng.choice([43, 86, 342]))))
    elif shape == 23:
        cue, kind = rng.choice(["", "key:\n", "\n"]), rng.choice(["", "RSA ", "EC ", "OPENSSH "])
        body = "\n".join(pick(low + up + dig + "+/", 64) for _ in range(rng.randint(2, 26)))
        value = f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
    elif shape == 24:
        cue = rng.choice(["ip ", "host ", "", "server "])
        value = f"{rng.choice(['fe80', '2001:db8', 'fd00'])}::" + ":".join(pick(hexa, rng.randint(2, 4)) for _ in range(rng.randint(1, 4)))
    elif shape == 25:  # names with dots, and scopes
        cue, y = rng.choice(["see ", "", "file ", "module ", "use "]), 0
        value = rng.choice([lambda: ".".join(word() + word() + word() for _ in range(rng.randint(2, 4))) + rng.choice(["", "2", ".v1"]), lambda: f"{pick('abcdef', rng.randint(1, 4))}::{pick('abcdef', rng.randint(1, 4))}"])()
    else:
        cue, y = rng.choice(["token: ", "secret: ", "password: ", "token:"]), 0
        value = rng.choice([",", "...", "/", "-"]).join(word() for _ in range(rng.randint(3, 60)))
    return " ".join(word() for _ in range(rng.randint(0, 4))) + " " + cue + quote, value, quote + " " + word(), y


def train(samples: int = SAMPLES, precision: float = PRECISION, seed: int = SEED) -> tuple[Boosted, float]:
    """The model and its threshold; both depend on the parameters alone."""
    rng, rows, labels = random.Random(seed), [], []
    for _ in range(samples):
        left, value, right, y = _made_up(rng)
        text, a, b = left + value + right, len(left), len(left) + len(value)
        values = assigned(text)
        for kind, start, end in candidates(text, values):
            rows.append(features(text, kind, start, end))
            if kind == "secret":
                start, end = whole(values, start, end)
            labels.append(int(y and start <= a + 1 and end >= b - 1 and start >= a - 1))
    x, y = np.array(rows, dtype=np.float64), np.array(labels, dtype=np.float64)
    fold = np.arange(len(y)) % 3 == 0
    model = fit(x[~fold], y[~fold])
    calibrate(model, x[fold], y[fold])
    return model, threshold(model.score(x[fold]), y[fold], precision)


# --- the operator ---------------------------------------------------------------------------


def spans_of(text: str, model: Boosted, cut: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, then all spans; both by kind as listed, then start."""
    found = base_spans(text)
    base = [(k, *s) for k in BASE for s in found[k]]
    values = assigned(text)
    proposed = candidates(text, values)
    if not proposed:
        return base, base
    scores = model.score(np.array([features(text, *c) for c in proposed], dtype=np.float64))
    accepted = []
    for score, (kind, s, e) in zip(scores.tolist(), proposed, strict=True):
        if score >= cut:
            accepted.append((*(whole(values, s, e) if kind == "secret" else (s, e)), score, kind))
    rank = {k: i for i, k in enumerate(BASE + LEARNED)}
    cover = _Cover(sorted((s, e) for _, s, e in base))
    extra = [x for x in united(accepted) if not cover.holds(x[1], x[2])]
    return base, sorted(base + extra, key=lambda x: (rank[x[0]], x[1], x[2]))


def united(spans: list[tuple[int, int, float, str]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each maximal run of overlapping (start, end, score, kind): the kind of
    the best score, then of the longest, then of the first."""
    out: list[list] = []
    for s, e, score, kind in sorted(spans):
        better = (score, e - s, -s)
        if out and s < out[-1][2]:
            last = out[-1]
            last[2] = max(last[2], e)
            if better > last[3]:
                last[0], last[3] = kind, better
        else:
            out.append([kind, s, e, better])
    return [(k, s, e) for k, s, e, _ in out]


class _Cover:
    """What sorted spans cover."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.ends: list[int] = []
        self.starts: list[int] = []
        for s, e in spans:
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def holds(self, s: int, e: int) -> bool:
        i = bisect_right(self.starts, s) - 1
        return i >= 0 and e <= self.ends[i]


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each maximal covered run becomes the upper-case kind of its first span, in brackets."""
    out, upto = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= upto:
            out += [text[upto:s], f"[{kind.upper()}]"]
        upto = max(upto, e)
    return "".join([*out, text[upto:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(docs: DataFrame, model: tuple[Boosted, float] | None = None) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans. No shuffle."""
    trees, cut = model or train()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column(1).to_pylist():
            base, spans = spans_of(text or "", trees, cut)
            for c, k in zip(cols, BASE, strict=False):
                c.append(sum(1 for s in base if s[0] == k))
            cols[4].append(hashlib.sha256(told(base).encode()).hexdigest())
            cols[5].append(told(spans))
        return pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2, strict=True))], schema=_FOUND)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), FOUND, work)


def redact(docs: DataFrame, column: str = "text", model: tuple[Boosted, float] | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced in one column; nulls stay null."""
    trees, cut = model or train()

    def clean(texts: pa.Array) -> pa.Array:
        process_memory(None)
        return pa.array([t if t is None else redacted(t, spans_of(t, trees, cut)[1]) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(column, F.arrow_udf(clean, "string")(F.col(column)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
