"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the votes, a classifier decides.

Base spans of the four ``KINDS`` follow fixed patterns and always stay. The method looks at more candidates, which those patterns
miss or swallow (a phone number with a card number behind it is one run of digits), and adds those that it accepts:

1. Tasks read whole texts once, find base spans and candidates, and note for each the votes of six labelers (regular pattern, check
   digits and ranges, gazetteer, words before it, neighbouring characters, variety) and a mask of ``FEATURES``. Rows of a document stay
   one row, without its text, so nothing is shuffled but counts.
2. Spark counts how often each combination of votes occurs (at most 4 * 3**6). Expectation-maximisation over these counts estimates, by
   kind, how often each labeler says for, nothing or against given that a span is personal data or not (Dawid and Skene 1979), with prior counts that
   say a labeler is rather right than wrong.
3. Spark adds up the posteriors by feature mask (at most 4 * 2**12 rows); a logistic regression by kind is fitted to these soft labels.
4. Candidates of at least ``ACCEPT`` are added, the most likely first, where they overlap no other span of their kind.

All candidates of all documents count for the estimates. What the driver sees is bounded by the numbers above.

Base patterns are found in time linear in the text: addresses from each @ to both sides, numbers by their longest runs.

Cases: a null or empty text has no spans; repeated rows are rows of their own and count in the estimates; a null doc_id is passed on; without
candidates of a kind nothing is added; ties in likelihood go to the earlier, then the longer span; an empty table gives an empty result; other columns
are ignored, whatever their names. Places are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaytrail.llm.common import slices, stored

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
#: Probability from which a candidate is added.
ACCEPT = 0.5
#: Characters before a span in which words count.
BEFORE = 40
ROUNDS = 200

# Votes
AGAINST, NOTHING, FOR = range(3)
LABELERS = ["pattern", "check", "gazetteer", "context", "border", "variety"]
#: Prior counts of against, nothing, for: of spans that are no personal data, and of those that are.
PRIOR = np.array([[6.0, 6.0, 2.0], [2.0, 6.0, 6.0]])
FEATURES = ["border_left", "border_right", "plus", "brackets", "separators", "check", "short", "long", "words_for", "words_against", "plain", "dull"]


# Base spans

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IS_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _IS_LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def _octets(s: str) -> bool:
    return all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in s.split(".")))


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _NUMBERS.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k:k + 4])) + 3
            if _octets(".".join(parts[k:k + 4])):
                out.append((at, at + size))
            at += size + 1
    return out


def _cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns."""
    out = [(EMAIL, *s) for s in _emails(text)]
    if _DIGIT.search(text):
        for kind, find in ((IP, _ips), (CARD, _cards), (PHONE, _phones)):
            out += [(kind, *s) for s in find(text)]
    return out


# Candidates

_MORE = [
    (PHONE, re.compile(r"(?<![0-9A-Za-z+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9A-Za-z+])\+[2-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)|[ .-][0-9]{1,4})(?:[ .-][0-9]{2,4}){2,3}(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")),
    (CARD, re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{13,19}(?![0-9A-Za-z])")),
    (CARD, re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])")),
    (CARD, re.compile(r"(?<![0-9A-Za-z.+-])3[47][0-9]{2}([ -])[0-9]{6}\1[0-9]{5}(?![0-9A-Za-z])")),
    (IP, re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}|\(\.\)[0-9]{1,3}){3}(?![0-9A-Za-z])")),
    (IP, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
]
_AT = re.compile(r" ?(?:\[(?:at|@)\]|\((?:at|@)\)|\{(?:at|@)\}) ?", re.IGNORECASE)
_NAME = r"[A-Za-z0-9-]+"
_DOT = r"(?:\.| ?(?:\[(?:dot|\.)\]|\((?:dot|\.)\)|\{(?:dot|\.)\}) ?)"
_HIDDEN_DOMAIN = re.compile(f"{_NAME}(?:{_DOT}{_NAME})+", re.IGNORECASE)


def _hidden_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with a bracketed @."""
    out = []
    for at in _AT.finditer(text):
        start = at.start()
        while start > 0 and text[start - 1] in _IS_LOCAL:
            start -= 1
        found = _HIDDEN_DOMAIN.match(text, at.end()) if start < at.start() else None
        if found:
            out.append((start, found.end()))
    return out


def more_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates besides the base spans."""
    out = []
    if "[" in text or "(" in text or "{" in text:
        out += [(EMAIL, *s) for s in _hidden_emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in _MORE:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


# Labelers

# Gazetteers of top-level domains, country calling codes, leading digits of card issuers, and words that stand before such data or
# before other numbers, in four languages.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai app dev eu uk us de fr es it nl be ch at pt pl se no dk fi ie cz gr ru cn jp kr in br mx ar ca au nz za tr il".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 359 370 371 372 380 381 385 386 420 421 852 886 966 971 972".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|64|65|35|62|50|5[6-9]|6[0-9]")
WORDS_FOR = {
    EMAIL: ["mail", "contact", "write", "reach", "kontakt", "schreib", "correo", "contacto", "courriel", "adresse"],
    IP: ["ip", "host", "server", "address", "client", "adresse", "login", "from", "servidor", "serveur", "dirección"],
    CARD: ["card", "visa", "mastercard", "credit", "debit", "karte", "tarjeta", "carte", "payment", "zahlung", "pago", "paiement"],
    PHONE: ["phone", "call", "tel", "mobile", "cell", "fax", "sms", "telefon", "anruf", "teléfono", "llame", "móvil", "téléphone", "appel"],
}
WORDS_AGAINST = ["token", "password", "passwort", "key", "secret", "version", "isbn", "issn", "sha", "md5", "hash", "uuid", "serial", "order", "invoice", "id"]

_WORD = re.compile(r"[^\W0-9_]+")
_STRICT_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_IPV6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
_OPENERS, _CLOSERS = frozenset(" \t\n\r\x0b\x0c([{<\"'|,;:="), frozenset(" \t\n\r\x0b\x0c)]}>\"'|,;:.!?*%&$#")


def _octet_list(s: str) -> list[str]:
    return re.split(r"\[\.\]|\(\.\)|\.", s)


def judge(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """(votes as a number to the base 3, mask of features) of one span."""
    s = text[start:end]
    left, right = text[start - 1:start], text[end:end + 1]
    before = set(_WORD.findall(text[max(0, start - BEFORE):start].lower()))
    words_for, words_against = bool(before.intersection(WORDS_FOR[kind])), bool(before.intersection(WORDS_AGAINST))
    digits = _digits(s)
    open_left, open_right = not left or left in _OPENERS, not right or right in _CLOSERS
    glued = (left.isalnum() if left else False) or (right.isalnum() if right else False)
    plain, check, gazetteer, dull = NOTHING, NOTHING, NOTHING, False
    if kind == EMAIL:
        host = re.split(r"[^A-Za-z0-9-]+", s.rstrip("])} "))[-1].lower()
        plain = FOR if _STRICT_EMAIL.fullmatch(s) else NOTHING
        check = AGAINST if ".." in s or s[0] == "." or not host or host.isdigit() else NOTHING
        gazetteer = FOR if host in TOP_LEVEL else NOTHING
    elif kind == IP:
        if _IPV6.fullmatch(s):
            plain, check, gazetteer = FOR, FOR, AGAINST if len(set(s.lower())) < 4 else NOTHING
        else:
            parts = _octet_list(s)
            plain = AGAINST if any(len(x) > 1 and x[0] == "0" for x in parts) else FOR if "[" not in s and "(" not in s else NOTHING
            parts = [x.lstrip("0") or "0" for x in parts]
            valid = len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
            check = FOR if valid else AGAINST
            first = int(parts[0]) if valid else 0
            gazetteer = AGAINST if first in (0, 127) or first > 223 else FOR if valid and first not in (10, 172, 192) else NOTHING
            dull = valid and all(int(x) < 10 for x in parts)
    elif kind == CARD:
        plain = FOR if len(digits) in (15, 16) else NOTHING if 13 <= len(digits) <= 19 else AGAINST
        check = FOR if luhn(digits) else AGAINST
        gazetteer = FOR if ISSUERS.match(digits) else NOTHING
        dull = len(set(digits)) < 4
    else:
        abroad = s[0] == "+"
        plain = AGAINST if not (10 if not abroad else 9) <= len(digits) <= 15 else FOR if abroad else NOTHING
        known = any(digits.startswith(c) for c in (digits[:k] for k in (1, 2, 3)) if c in CALLING_CODES)
        check = (FOR if known else AGAINST) if abroad else NOTHING
        gazetteer = FOR if abroad and known and len(digits) >= 10 else NOTHING
        dull = len(set(digits)) < 3
    context = AGAINST if words_against and not words_for else FOR if words_for else NOTHING
    border = AGAINST if glued else FOR if open_left and open_right else NOTHING
    variety = AGAINST if dull else NOTHING
    code = 0
    for vote in (plain, check, gazetteer, context, border, variety):
        code = 3 * code + vote
    flags = (open_left, open_right, "+" in s, any(c in s for c in "()[]{}"), any(c in s for c in " -"), check == FOR, len(digits) <= 12,
             len(digits) > 16, words_for, words_against, plain == FOR, dull)
    return code, sum(1 << k for k, f in enumerate(flags) if f)


class Taken:
    """Spans that do not overlap."""

    def __init__(self, spans=()):
        self.spans = sorted(spans)

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.spans, (end, -1))                               # the last one that begins before the end
        return at == 0 or self.spans[at - 1][1] <= start

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))


def candidates(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, start, end, base?, votes, features) of all base spans and of the other candidates that overlap none of their kind."""
    base = base_spans(text)
    taken = [Taken((s, e) for k, s, e in base if k == kind) for kind in range(len(KINDS))]
    more = [(k, s, e) for k, s, e in sorted(set(more_spans(text))) if taken[k].free(s, e)]
    return [(*span, True, *judge(text, *span)) for span in base] + [(*span, False, *judge(text, *span)) for span in more]


_NAMES = ["kind", "start", "end", "base", "votes", "bits"]
_SPANS = "_spans array<struct<kind:int,start:int,end:int,base:boolean,votes:int,bits:int>>"
_SPAN_TYPE = pa.list_(pa.struct([(n, pa.bool_() if n == "base" else pa.int32()) for n in _NAMES]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [[dict(zip(_NAMES, c)) for c in candidates(text)] if text else [] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPAN_TYPE)], ["doc_id", "_spans"])


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id and _spans: every base span and candidate with its votes and features."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {kind}, {_SPANS}")


# Reliabilities

def vote_table() -> np.ndarray:
    """The votes of each code."""
    return np.array(list(product(range(3), repeat=len(LABELERS))))


def reliabilities(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of personal data, [labeler, class, vote] probabilities, posterior of each code) from how often each code of votes occurs."""
    votes = vote_table()
    balance = (votes == FOR).sum(1) - (votes == AGAINST).sum(1)
    posterior = 1 / (1 + np.exp(-balance.astype(float)))
    for _ in range(rounds):
        share = (counts @ posterior + 1) / (counts.sum() + 2)
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        theta = np.stack([[[w[votes[:, k] == v].sum() for v in range(3)] for w in weight] for k in range(len(LABELERS))]) + PRIOR
        theta /= theta.sum(2, keepdims=True)
        odds = np.log(share) - np.log1p(-share) + sum(np.log(theta[k, 1, votes[:, k]] / theta[k, 0, votes[:, k]]) for k in range(len(LABELERS)))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - posterior).max() < 1e-10
        posterior = new
        if done:
            break
    return float(share), theta, posterior


# Classifier

def fit_classifier(bits: np.ndarray, n: np.ndarray, positive: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (bias first) of a logistic regression on feature masks with ``n`` spans, of which ``positive`` are expected to be personal data."""
    x = np.concatenate([np.ones((len(bits), 1)), (bits[:, None] >> np.arange(len(FEATURES))) & 1], 1).astype(float)
    w = np.zeros(x.shape[1])
    pull = np.r_[0.01, np.full(len(FEATURES), ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(pull), x.T @ (n * p - positive) + pull * w)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(found: DataFrame) -> tuple[np.ndarray, dict[int, tuple[float, np.ndarray, np.ndarray]]]:
    """(weights of each kind, what :func:`reliabilities` gives for each kind) from rows of :func:`find_candidates`."""
    spark = found.sparkSession
    spans = found.select(F.explode("_spans").alias("s")).select("s.kind", "s.votes", "s.bits")
    counts = np.zeros((len(KINDS), 3 ** len(LABELERS)))
    for r in spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.kind, r.votes] = r.n
    learned = {k: reliabilities(counts[k]) for k in range(len(KINDS)) if counts[k].any()}
    rows = [(k, int(v), float(learned[k][2][v])) for k in learned for v in np.flatnonzero(counts[k])]
    weights = np.zeros((len(KINDS), len(FEATURES) + 1))
    weights[:, 0] = -30
    if rows:
        soft = spark.createDataFrame(rows, "kind int, votes int, p double")   # at most 4 * 3**6 rows
        sums = spans.join(F.broadcast(soft), ["kind", "votes"]).groupBy("kind", "bits").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).collect()
        for k in learned:
            mine = sorted((r.bits, r.n, r.p) for r in sums if r.kind == k)
            weights[k] = fit_classifier(*(np.array(x, d) for x, d in zip(zip(*mine), (np.int64, float, float))))
    return weights, learned


def likelihood(weights: np.ndarray, kind: np.ndarray, bits: np.ndarray) -> np.ndarray:
    w = weights[kind]
    odds = w[:, 0] + (((bits[:, None] >> np.arange(len(FEATURES))) & 1) * w[:, 1:]).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def choose(spans: list[tuple[int, int, int, bool, int]], weights: np.ndarray, accept: float = ACCEPT) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base?) of base spans and accepted candidates, in order; ``spans`` are (kind, start, end, base?, features)."""
    out = [(s, k, e, True) for k, s, e, base, _ in spans if base]
    more = [x for x in spans if not x[3]]
    if more:
        p = likelihood(weights, np.array([x[0] for x in more]), np.array([x[4] for x in more]))
        taken = [Taken() for _ in KINDS]
        for prob, (k, s, e, _, _) in sorted(zip(p.tolist(), more), key=lambda x: (-x[0], x[1][1], -x[1][2])):
            if prob >= accept and taken[k].free(s, e):
                taken[k].add(s, e)
                out.append((s, k, e, False))
    return sorted(out)


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id and _found (kind, start, end, base) of every document, ordered by start, then kind."""
    found = stored(find_candidates(docs), "personal-candidates")
    weights, _ = train(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("_spans").to_pylist():
                chosen = choose([(x["kind"], x["start"], x["end"], x["base"], x["bits"]) for x in spans], weights, accept) if spans else []
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": base} for s, k, e, base in chosen])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "_found"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("_found array<struct<kind:string,start:int,end:int,base:boolean>>").fields])
    return found.mapInArrow(run, schema)
