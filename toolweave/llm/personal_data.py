"""Personal data: spans found by patterns, judged by weak supervision.

Patterns give candidate spans of nine kinds. Six labelers vote yes, no or nothing on each: its format, a gazetteer, the
words before it, the words after it, its characters, and the other candidates near it. No vote is trusted by itself: how
often each labeler is right is estimated from how the votes agree over all documents (expectation-maximisation of a latent
true class, kind by kind), and the resulting class probabilities train a logistic span classifier, which also sees what no
labeler uses (length, digits, neighbouring characters). A span is reported if the classifier believes it, or if it is one
of the base spans, which are fixed rules on email, ip, card and phone; the classifier only adds.

A candidate is written as a number of 24 bits: kind, votes, features. Training needs how often each number occurs, a
grouped count whose size is bounded by the bits (9 * 3**6 * 4**4 numbers at most, a few hundred in practice) however many
documents there are. Finding and deciding are narrow. Every search is linear in the text. Offsets are code points, ends
exclusive. A null or empty text has no spans; repeated rows are judged alike and count in training as often as they occur;
an input column named like an output is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import small_batches, table, without, written

BASE = ["email", "ip", "card", "phone"]
KINDS = BASE + ["secret", "national_id", "iban", "local_phone", "person"]
NUMBER = {k: i for i, k in enumerate(KINDS)}
LABELERS = ["format", "gazetteer", "before", "after", "characters", "company"]
NO, YES = 1, 2  # a vote; 0 is none
SHAPE = ["length", "digits", "left", "right"]
#: Where each field lies in a candidate's number, and its bits.
PLACE = {"kind": (0, 4)} | {name: (4 + 2 * i, 2) for i, name in enumerate(LABELERS + SHAPE)}

# Patterns. Possessive repeats and look-behinds keep each linear.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_NEXT, EMAIL_FREE = re.compile(EMAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:api|access|secret|private|auth|token|passwd|password|pwd|bearer)(?:[_ -]?(?:key|token|secret|id))?[\"']?\s{0,3}[:=]>?\s{0,3}[\"']?([A-Za-z0-9_./+=-]{8,}+)",
    re.IGNORECASE,
)
KNOWN_KEY = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
PERSON = re.compile(r"(?<![A-Za-z])(?:Mrs?\.|Ms\.|Dr\.|Prof\.|Herr|Frau|Mme|M\.|Sr\.|Sra\.|[Nn]ame:|Dear) ([A-ZÀ-Þ][a-zß-ÿ]+(?:[ -][A-ZÀ-Þ][a-zß-ÿ]+){0,2})")

# Gazetteers: short public lists; each can be replaced through `gazetteer` of candidates().
GAZETTEER = {
    "mail_endings": {"com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "nl", "uk", "us", "ca", "ch", "at", "be", "pl", "se", "eu", "br", "jp", "cn", "in", "au"},
    "calling_codes": {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98", "351", "352", "353", "358", "380", "420"},
    "reserved_nets": ("0.", "127.", "255.", "192.0.2.", "198.51.100.", "203.0.113."),
    "no_secrets": {"password", "changeme", "placeholder", "undefined", "required", "optional", "anonymous", "username"},
    "invalid_ids": {"078-05-1120", "219-09-9999", "123-45-6789"},
    "iban_lengths": {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24},
    "given_names": {"anna", "anne", "antonio", "carlos", "carmen", "charles", "claire", "daniel", "david", "elena", "elizabeth", "emma", "eva", "francois", "george", "hans", "heinrich", "ines", "isabel", "jack", "james", "jane", "jean", "john", "jose", "juan", "julia", "karl", "klaus", "laura", "louis", "lucia", "luis", "manuel", "maria", "marie", "mark", "martin", "mary", "michael", "miguel", "paul", "pedro", "peter", "pierre", "richard", "robert", "sara", "sophie", "susan", "thomas", "ursula", "william", "wolfgang"},
}
#: Words before or after a span that speak for a kind, and words that speak against any.
CUES = {
    "email": {"mail", "email", "contact", "write", "address", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "client", "login", "from", "addr"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "pay", "payment", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "contact"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "bearer", "auth", "api"},
    "national_id": {"ssn", "social", "security", "id", "number"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "local_phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "contact"},
    "person": {"name", "mr", "mrs", "ms", "dr", "prof", "dear", "herr", "frau", "mme", "sr", "sra"},
}
AGAINST = {"isbn", "issn", "doi", "version", "v", "build", "release", "page", "figure", "table", "section", "order", "invoice", "item", "part", "chapter"}
UNITS = {"px", "kg", "mm", "cm", "km", "ms", "mb", "gb", "bytes", "percent", "eur", "usd", "euro", "dollars"}
WORD = re.compile(r"[^\W\d_]+")
BRANDS = [("4", (13, 16, 19)), ("51", (16,)), ("52", (16,)), ("53", (16,)), ("54", (16,)), ("55", (16,)), ("2", (16,)), ("34", (15,)), ("37", (15,)), ("6", (16, 19)), ("3", (14, 16))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def only_digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches one after another. A match starts where a run of its characters starts, or where the last match ended."""
    at = 0
    while True:
        m = (EMAIL_NEXT.match(text, at) if at else None) or EMAIL_FREE.search(text, at)
        if m is None:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], NUMBER[s[0]], s[2]))


def all_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all candidates in order; one that lies within a base span isn't one."""
    base = base_spans(text)
    more = [("secret", *m.span(1)) for m in SECRET.finditer(text)]
    more += [("secret", *m.span()) for m in KNOWN_KEY.finditer(text)]
    more += [("national_id", *m.span()) for m in NATIONAL_ID.finditer(text)]
    more += [("iban", *m.span()) for m in IBAN.finditer(text)]
    more += [("local_phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    more += [("person", *m.span(1)) for m in PERSON.finditer(text)]
    out, covered = [(*s, True) for s in base], -1
    ends = sorted((a, b) for _, a, b in base)
    k = 0
    for kind, a, b in sorted(set(more), key=lambda s: (s[1], -s[2])):
        while k < len(ends) and ends[k][0] <= a:
            covered = max(covered, ends[k][1])
            k += 1
        if b > covered:
            out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (s[1], NUMBER[s[0]], s[2]))


def _vote(yes: bool, no: bool = True) -> int:
    return YES if yes else NO if no else 0


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def _format(kind: str, s: str) -> int:
    if kind == "email":
        local, _, domain = s.partition("@")
        return _vote(len(local) <= 64 and ".." not in local and local[0] not in ".-" and domain.rpartition(".")[2].isalpha())
    if kind == "ip":
        return _vote(all(x == "0" or x[0] != "0" for x in s.split(".")))
    if kind == "card":
        return _vote(bool(re.fullmatch(r"[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", s)))
    if kind == "phone":
        return _vote(s.count("(") == s.count(")") and "  " not in s and "--" not in s)
    if kind == "secret":
        return _vote(len(s) >= 16 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s))
    if kind == "national_id":
        return _vote(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    if kind == "iban":
        code = s.replace(" ", "")
        return _vote(int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1)
    if kind == "local_phone":
        d = only_digits(s)[-10:]
        return _vote(d[0] not in "01" and d[3] not in "01")
    return _vote(" " in s, no=False)


def _gazetteer(kind: str, s: str, known: dict) -> int:
    if kind == "email":
        return _vote(s.rpartition(".")[2].lower() in known["mail_endings"])
    if kind == "ip":
        return _vote(not s.startswith(known["reserved_nets"]))
    if kind == "card":
        d = only_digits(s)
        return _vote(any(d.startswith(p) and len(d) in n for p, n in BRANDS))
    if kind == "phone":
        d = only_digits(s)
        return _vote(any(d[:n] in known["calling_codes"] for n in (1, 2, 3)))
    if kind == "secret":
        return NO if s.lower().strip("._-") in known["no_secrets"] else _vote(bool(KNOWN_KEY.match(s)), no=False)
    if kind == "national_id":
        return NO if s in known["invalid_ids"] else 0
    if kind == "iban":
        return _vote(known["iban_lengths"].get(s[:2]) == len(s.replace(" ", "")))
    if kind == "person":
        return _vote(re.split("[ -]", s)[0].lower() in known["given_names"], no=False)
    return 0


def _words(kind: str, words: list[str], against: set[str]) -> int:
    if against & set(words):
        return NO
    return _vote(bool(CUES[kind] & set(words)), no=False)


def _characters(kind: str, s: str) -> int:
    d = only_digits(s)
    if kind == "secret":
        h = _entropy(s)
        return YES if h >= 3 else NO if h < 2.5 else 0
    if kind in ("email", "person"):
        return _vote(len(set(s.lower())) >= 4)
    return _vote(len(set(d)) >= (3 if kind == "ip" else 4) or (kind == "ip" and len(set(s.split("."))) >= 2))


def _side(text: str, i: int) -> int:
    """Class of a neighbouring character: none or white space, letter or digit, quote or bracket, other."""
    if not 0 <= i < len(text) or text[i].isspace():
        return 0
    return 1 if text[i].isalnum() else 2 if text[i] in "\"'`()[]{}<>" else 3


def numbered(text: str, known: dict = GAZETTEER) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, number) of all candidates of a text; the number holds kind, votes and features."""
    spans = all_spans(text)
    per_kind = Counter(s[0] for s in spans)
    out = []
    for i, (kind, a, b, base) in enumerate(spans):
        s = text[a:b]
        near = [spans[j] for j in (i - 1, i + 1) if 0 <= j < len(spans)]
        other = any(n[0] != kind and n[1] - b < 300 and a - n[2] < 300 for n in near)
        digits = len(only_digits(s))
        fields = {
            "kind": NUMBER[kind],
            "format": _format(kind, s),
            "gazetteer": _gazetteer(kind, s, known),
            "before": _words(kind, [w.lower() for w in WORD.findall(text[max(0, a - 40) : a])], AGAINST),
            "after": _words(kind, [w.lower() for w in WORD.findall(text[b : b + 24])][:2], UNITS),
            "characters": _characters(kind, s),
            "company": NO if per_kind[kind] > 50 else _vote(other, no=False),
            "length": min(3, (b - a).bit_length() // 2),
            "digits": min(3, 4 * digits // (b - a)),
            "left": _side(text, a - 1),
            "right": _side(text, b),
        }
        out.append((NUMBER[kind], a, b, base, sum(v << PLACE[f][0] for f, v in fields.items())))
    return out


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    T.StructField("base", T.BooleanType()), T.StructField("number", T.IntegerType()),
]))


def candidates(docs: DataFrame, text_col: str = "text", gazetteer: dict | None = None) -> DataFrame:
    """docs with __spans: the numbered candidates of each text."""
    small_batches(docs.sparkSession)
    known = GAZETTEER | (gazetteer or {})

    @F.arrow_udf(SPANS)
    def find(text):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("number", pa.int32())]))
        names = ("kind", "start", "stop", "base", "number")
        return pa.array([[dict(zip(names, x)) for x in numbered(t.as_py() or "", known)] for t in text], kind)

    return docs.withColumn("__spans", find(F.col(text_col)))


def _field(numbers: np.ndarray, name: str) -> np.ndarray:
    at, bits = PLACE[name]
    return (numbers >> at) & ((1 << bits) - 1)


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of each pattern, share of true ones, P(vote | class) as classes x labelers x 3) of one kind.

    votes: patterns x labelers of 0 (none), 1 (no), 2 (yes); n: how often each occurs. Starts from the majority.
    """
    signed = np.where(votes == YES, 1.0, np.where(votes == NO, -1.0, 0.0))
    p = 1 / (1 + np.exp(-signed.sum(1)))
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        table = np.stack([np.stack([(weight * (votes == v).T[j]).sum(1) + 1 for v in range(3)], 1) for j in range(votes.shape[1])], 1)
        table /= table.sum(2, keepdims=True)
        log = np.log([1 - share, share])[:, None] + sum(np.log(table[:, j, votes[:, j]]) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
    return p, float(share), table


class Model:
    """Weights of the span classifier: kind, votes by kind, and shape; and the estimated reliabilities by kind."""

    def __init__(self, numbers: np.ndarray, n: np.ndarray):
        order = np.argsort(numbers)
        numbers, n = numbers[order], n[order].astype(np.float64)
        self.reliability: dict[str, tuple[float, np.ndarray]] = {}
        target = np.zeros(len(numbers))
        weight = np.zeros(len(numbers))
        for k, kind in enumerate(KINDS):
            mine = np.flatnonzero(_field(numbers, "kind") == k)
            if len(mine):
                votes = np.stack([_field(numbers[mine], x) for x in LABELERS], 1)
                target[mine], share, table = reliabilities(votes, n[mine])
                self.reliability[kind] = (share, table)
                weight[mine] = n[mine] / n[mine].sum() * 1000  # kinds count alike, however rare
        self.weights = self._fit(numbers, target, weight)

    SIZES = [len(KINDS)] + [3 * len(KINDS)] * len(LABELERS) + [4] * len(SHAPE)

    @classmethod
    def _features(cls, numbers: np.ndarray) -> np.ndarray:
        """Indexes of the features that are one, a column for each field."""
        kind = _field(numbers, "kind")
        columns = [kind] + [3 * kind + _field(numbers, x) for x in LABELERS] + [_field(numbers, x) for x in SHAPE]
        return np.stack(columns, 1) + np.cumsum([0] + cls.SIZES[:-1])

    @classmethod
    def _fit(cls, numbers, target, weight, ridge: float = 1.0, rounds: int = 30, rows: int = 1 << 14) -> np.ndarray:
        """Ridge logistic regression on soft targets by Newton steps; rows patterns are spread out at once."""
        size = sum(cls.SIZES)
        w = np.zeros(size)
        for _ in range(rounds if len(numbers) else 0):
            slope, bend = -ridge * w, ridge * np.eye(size)
            for a in range(0, len(numbers), rows):
                x = np.zeros((len(numbers[a : a + rows]), size))
                np.put_along_axis(x, cls._features(numbers[a : a + rows]), 1.0, 1)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                c = weight[a : a + rows]
                slope += x.T @ (c * (target[a : a + rows] - p))
                bend += (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
            step = np.linalg.solve(bend, slope)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        return np.round(w, 9)

    def probability(self, numbers: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.weights[self._features(np.asarray(numbers))].sum(1)))

    def score(self, number: Column) -> Column:
        """The log odds that a numbered candidate is personal data."""
        at = lambda name: F.shiftright(number, PLACE[name][0]).bitwiseAND(F.lit((1 << PLACE[name][1]) - 1))
        weights = F.lit([float(x) for x in self.weights])
        first = np.cumsum([0] + self.SIZES[:-1])
        total = F.get(weights, at("kind"))
        for i, x in enumerate(LABELERS + SHAPE):
            index = 3 * at("kind") + at(x) if x in LABELERS else at(x)
            total = total + F.get(weights, index + F.lit(int(first[i + 1])))
        return total


def train(found: DataFrame) -> Model:
    """The model of all candidates in found (candidates(), written). Its grouped counts are bounded by the bits."""
    counts = found.select(F.explode("__spans.number").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()
    return Model(np.array([r.number for r in counts], np.int64), np.array([r.n for r in counts], np.int64))


OUT = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "all_spans"]


def decide(found: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """found with counts of the base kinds, base_spans and all_spans (arrays of kind, start, stop, score) instead of __spans."""
    cut = math.log(threshold / (1 - threshold))
    kept = without(found, *OUT)
    name = lambda c: F.get(F.lit(KINDS), c)
    scored = F.transform("__spans", lambda c: F.struct(name(c["kind"]).alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["base"].alias("base"), model.score(c["number"]).alias("score")))
    slim = lambda spans: F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["score"].alias("score")))
    judged = kept.withColumn("__judged", scored)
    counts = [F.size(F.filter("__judged", (lambda k: lambda c: c["base"] & (c["kind"] == k))(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = slim(F.filter("__judged", lambda c: c["base"])).alias("base_spans")
    both = slim(F.filter("__judged", lambda c: c["base"] | (c["score"] > cut))).alias("all_spans")
    return judged.select(*[F.col(f"`{c}`") for c in kept.columns if c != "__spans"], *counts, base, both)


def find(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, gazetteer: dict | None = None) -> DataFrame:
    """docs without the text column, with the columns of decide(), trained on these documents."""
    names = [c for c in docs.columns if c != text_col]
    found = written(candidates(docs, text_col, gazetteer).select(*[F.col(f"`{c}`") for c in names], "__spans"), "candidates")
    return decide(found, train(found), threshold)


def redact(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, gazetteer: dict | None = None) -> DataFrame:
    """docs with every reported span of the text replaced by its kind, as [EMAIL]; narrow. Overlapping spans are one."""

    @F.arrow_udf(T.StringType())
    def mask(text, spans):
        import pyarrow as pa

        out = []
        for t, found in zip(text.to_pylist(), spans.to_pylist()):
            parts, at = [], 0
            for s in found:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["stop"])
            out.append(None if t is None else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    judged = decide(candidates(docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text")), "__text", gazetteer), model, threshold)
    return judged.select(*[mask(F.col("__text"), F.col("all_spans")).alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"n_{k}") for k in BASE]
    return made.select("doc_id", *counts, F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))
