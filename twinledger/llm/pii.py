"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier is trained."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.common import map_batches, pick
from twinledger.llm.linear import Rows, fit, sigmoid
from twinledger.session import materialise

# Kinds in their order, word lists of the gazetteer and context labelers.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "iban", "secret")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "example")
CARD_STARTS = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65")
RESERVED_IP = ("0.", "127.", "255.", "169.254.")
CUES = {
    "email": ("email", "e-mail", "mail", "correo", "courriel", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "secret": ("token", "secret", "key", "api-key", "apikey", "password", "passwd", "auth", "bearer", "credential"),
}
AGAINST = (
    "version", "order", "invoice", "isbn", "serial", "token", "password", "id", "sku", "ref", "total", "page",
)
AGAINST_SECRET = ("commit", "sha", "hash", "checksum", "digest", "revision", "uuid", "path", "url", "http", "https")
SECRET_STARTS = ("AKIA", "ghp_", "gho_", "github_pat_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}"
)
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")

CONTEXT = 48
"""Characters before a span in which the context labeler looks for cue words."""


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, in time linear in the text: each ``@`` is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        run = len(text[free:at]) - len(text[free:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if run else None
        if found:
            yield at - run, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def valid_iban(text: str) -> bool:
    """Whether the check digits of an account number of 15 to 34 characters hold."""
    body = text.replace(" ", "")
    return 15 <= len(body) <= 34 and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def _secretive(text: str) -> bool:
    """A run of 20 to 128 characters with letters and digits, at least eight different ones."""
    return (
        len(text) <= 128 and len(set(text)) >= 8
        and any(c.isdigit() for c in text) and any(c.isalpha() for c in text)
    )


def _loose(text: str) -> list[tuple[Span, bool]]:
    """The base spans, and beside them everything else in the shape of a kind whose own checks hold."""
    base, other = [], []
    for start, end in _emails(text) if "@" in text else ():
        base.append(Span(0, start, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [x.lstrip("0") for x in m[0].split(".")]
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in parts):
                base.append(Span(1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                (base if len(digits) >= 14 else other).append(Span(2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = len(_digits(m[0]))
                if 8 <= n <= 15:
                    (base if n >= 10 else other).append(Span(3, *m.span()))
        other.extend(Span(3, *m.span()) for m in _LOCAL_PHONE.finditer(text))
        if text.count(":") >= 7:
            other.extend(Span(1, *m.span()) for m in _LONG_IP.finditer(text))
        other.extend(Span(4, *m.span()) for m in _IBAN.finditer(text) if valid_iban(m[0]))
        other.extend(Span(5, *m.span()) for m in _SECRET.finditer(text) if _secretive(m[0]))
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        other.extend(Span(0, *m.span()) for m in _SPELT.finditer(text))
    return [(s, True) for s in base] + [(s, False) for s in _apart(other, base)]


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap no base span: those would only repeat what is found already."""
    ordered = sorted((s.start, s.end) for s in base)
    starts = [s for s, _ in ordered]
    reach = np.maximum.accumulate([e for _, e in ordered]) if ordered else []
    kept = []
    for span in spans:
        before = bisect_left(starts, span.end)
        if not before or reach[before - 1] <= span.start:
            kept.append(span)
    return kept


def base_spans(text: str) -> list[Span]:
    """The spans of the four fixed patterns, by start and then kind."""
    return sorted((s for s, base in _loose(text) if base), key=lambda s: (s.start, s.kind))


NEAR = 200
"""Characters between two starts up to which the neighbours labeler sees them."""


def votes(text: str, span: Span, base: bool, others: list[int]) -> tuple[int, ...]:
    """What the five labelers say of a span: 1 for, -1 against, 0 nothing.

    Pattern (1 if checks that chance seldom passes hold), gazetteer (domains, card issuers, reserved
    addresses, starts of keys), context (cue words before it), shape (glued to a longer token), neighbours
    (other spans close by, of any kind; ``others`` are all starts in the text, sorted).
    """
    body, kind = text[span.start : span.end], ALL_KINDS[span.kind]
    if kind == "email":
        listed = 1 if re.split(r"[.)\] ]+", body)[-1].lower() in DOMAINS else 0
    elif kind == "card":
        listed = 1 if _digits(body).startswith(CARD_STARTS) else -1
    elif kind == "ip":
        listed = -1 if body.startswith(RESERVED_IP) else 0
    elif kind == "secret":
        listed = 1 if body.startswith(SECRET_STARTS) else 0
    else:
        listed = 1 if body.startswith("+") else 0
    against = AGAINST_SECRET if kind == "secret" else AGAINST
    words = [w.lower() for w in _WORD.findall(text[max(0, span.start - CONTEXT) : span.start])][-6:]
    context = 1 if any(w in CUES[kind] for w in words) else -1 if any(w in against for w in words) else 0
    beside = text[max(0, span.start - 1) : span.start] + text[span.end : span.end + 1]
    shape = -1 if any(c.isalnum() or c in "_=/" for c in beside) else 1
    first, last = bisect_left(others, span.start - NEAR), bisect_right(others, span.start + NEAR)
    same = bisect_right(others, span.start) - bisect_left(others, span.start)
    near = 1 if last - first > same else 0
    checked = base or kind in ("card", "iban")
    return (1 if checked else 0, listed, context, shape, near)


_SPAN = pa.struct([
    ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32()),
    ("marks", pa.list_(pa.int32())),
])
_SPAN_SQL = "array<struct<kind: int, start: long, end: long, base: boolean, pattern: int, marks: array<int>>>"

_WIDTH = 1 << 13
"""Hashed features of the span classifier."""

SAMPLE = 12_000
"""Spans, spread over all vote patterns, that the span classifier is fitted to."""


def _marks(text: str, span: Span, said: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: its votes, runs of three of its characters, words before and after."""
    kind, body = ALL_KINDS[span.kind], text[span.start : span.end]
    shape = "^" + "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in body) + "$"
    seen = {kind, *(f"{kind} vote {i} {v}" for i, v in enumerate(said))}
    seen.update(f"{kind} part {shape[i : i + 3]}" for i in range(len(shape) - 2))
    before = _WORD.findall(text[max(0, span.start - CONTEXT) : span.start])[-4:]
    after = _WORD.findall(text[span.end : span.end + CONTEXT // 2])[:2]
    seen.update(f"{kind} before {w.lower()}" for w in before)
    seen.update(f"{kind} after {w.lower()}" for w in after)
    return sorted({xxhash.xxh32_intdigest(x) % _WIDTH for x in seen})


def pattern_of(kind: int, said: tuple[int, ...], n_digits: int) -> int:
    """Kind, votes and digit count (in fours, 24 and more together) as one number below 10,206."""
    code = kind
    for vote in said:
        code = code * 3 + vote + 1
    return code * 7 + min(n_digits // 4, 6)


def unpattern(code: int) -> tuple[int, tuple[int, ...], int]:
    code, digits = divmod(code, 7)
    said = []
    for _ in range(5):
        code, vote = divmod(code, 3)
        said.append(vote - 1)
    return code, tuple(reversed(said)), digits


def _candidates(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1):
            body = text.as_py() or ""
            found = _loose(body)
            starts = sorted(s.start for s, _ in found)
            row = []
            for span, base in found:
                said = votes(body, span, base, starts)
                row.append({
                    "kind": span.kind, "start": span.start, "end": span.end, "base": base,
                    "pattern": pattern_of(span.kind, said, len(_digits(body[span.start : span.end]))),
                    "marks": _marks(body, span, said),
                })
            rows.append(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, type=pa.list_(_SPAN))], names=["doc_id", "found"]
        )


def reliabilities(patterns: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Probability that a span of each vote pattern is personal data, by expectation-maximisation.

    Per kind, each labeler has a distribution over its three votes given the truth; starting from the
    votes' majority, posteriors and distributions are estimated in turn on the pattern counts. A few
    counts by which each labeler is right are added, the same at every size, and no labeler may turn out
    worse than chance: a vote for never lowers the probability and one against never raises it, so that
    neither few nor skewed spans can turn a labeler round.
    """
    out = {}
    for kind in range(len(ALL_KINDS)):
        codes = [c for c in patterns if unpattern(c)[0] == kind]
        if not codes:
            continue
        said = np.array([unpattern(c)[1] for c in codes]) + 1
        n = np.array([patterns[c] for c in codes], dtype=np.float64)
        truth = sigmoid(2.0 * (said - 1).sum(axis=1))
        trust = np.array([2.0, 4.0, 8.0])
        for _ in range(rounds):
            prior = (n @ truth + 1) / (n.sum() + 2)
            logit = np.full(len(codes), np.log(prior / (1 - prior)))
            for labeler in range(said.shape[1]):
                yes = np.bincount(said[:, labeler], weights=n * truth, minlength=3) + trust
                no = np.bincount(said[:, labeler], weights=n * (1 - truth), minlength=3) + trust[::-1]
                gain = np.log(yes / yes.sum()) - np.log(no / no.sum())
                gain[0], gain[2] = min(gain[0], 0.0), max(gain[2], 0.0)
                logit += gain[said[:, labeler]]
            truth = sigmoid(logit)
        out.update(zip(codes, truth.tolist()))
    return out


def train(spans: list[tuple[int, list[int]]], patterns: dict[int, int]) -> tuple[np.ndarray, float]:
    """Weights and bias of the span classifier: a logistic regression on the features of sampled spans
    (pattern, marks), fitted to EM's probability of their vote pattern. A pattern weighs as the root of
    its count, shared by its sampled spans."""
    if not spans:
        return np.zeros(_WIDTH), -20.0
    truth = reliabilities(patterns)
    codes = np.array([p for p, _ in spans])
    held = {p: n for p, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True)))}
    weights = np.array([np.sqrt(patterns[p]) / held[p] for p in codes.tolist()])
    return fit(
        Rows.of([m for _, m in spans] * 2),  # twice, so that features met once count as features
        np.array([truth[p] for p in codes.tolist()] * 2), _WIDTH, l1=0.0, l2=1e-4, steps=200,
        weights=np.concatenate([weights, weights]),
    )


def _sampled(found: DataFrame, patterns: dict[int, int]) -> list[tuple[int, list[int]]]:
    """At most ``SAMPLE`` spans: of each vote pattern an even share, chosen by hash, equal ones once."""
    if not patterns:
        return []
    quota = max(1, SAMPLE // len(patterns))
    rates = found.sparkSession.createDataFrame(
        pa.table({"pattern": pa.array(list(patterns), pa.int32()),
                  "rate": pa.array([quota / n for n in patterns.values()], pa.float64())})
    )
    key = F.xxhash64("doc_id", "start", "end", "pattern")
    chosen = (
        found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.start", "s.end", "s.pattern", "s.marks")
        .withColumn("key", key).join(F.broadcast(rates), "pattern")
        .where(F.pmod("key", F.lit(1 << 30)) < F.col("rate") * (1 << 30))
        .dropDuplicates(["key"]).orderBy("key").limit(SAMPLE)
    )
    return [(r["pattern"], r["marks"]) for r in chosen.select("pattern", "marks").collect()]


def _listed(spans) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _decide(model: tuple[np.ndarray, float], least: float):
    weights, bias = model

    def score(span) -> float:
        return float(sigmoid(weights[span["marks"]].sum() + bias))

    def run(batches):
        for batch in batches:
            counts, digests, lists = [[], [], [], []], [], []
            for found in batch.column(1):
                all_ = found.as_py()
                base = [(x["start"], x["kind"], x["end"]) for x in all_ if x["base"]]
                likely = [(score(x), x["start"], x["kind"], x["end"]) for x in all_ if not x["base"]]
                taken, added = [], []
                for _, start, kind, end in sorted((x for x in likely if x[0] >= least), key=lambda x: (-x[0], *x[1:])):
                    at = bisect_left(taken, (start, end))
                    if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                        continue
                    insort(taken, (start, end))
                    added.append((start, kind, end))
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                lists.append(_listed(base + added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=pa.int64()) for c in counts),
                 pa.array(digests, type=pa.string()), pa.array(lists, type=pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def personal_data(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs`` (doc_id, text).

    One pass over the whole texts writes the candidate spans with their vote patterns and features.
    Candidates fail none of their kind's checks and overlap no base span. All patterns of the corpus are
    counted (fewer than 10,206 can exist, so the driver's part is bounded); EM weighs the labelers, the
    span classifier learns from that on at most ``SAMPLE`` spans, and every candidate it scores ``least``
    or more joins the base spans, the better of two that overlap. Added spans may also be of the kinds
    iban and secret, which have no base. Base spans always stay. Null and empty texts have no spans;
    repeated rows come back as often as given.
    """
    found = materialise(
        pick(docs, "doc_id", "text").transform(map_batches, _candidates, f"doc_id long, found {_SPAN_SQL}"), "pii-candidates"
    )
    counted = found.select(F.explode("found.pattern").alias("p")).groupBy("p").count().collect()
    patterns = {r["p"]: r["count"] for r in sorted(counted)}
    model = train(_sampled(found, patterns), patterns)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return found.transform(map_batches,
        _decide(model, least), f"doc_id long, {counts}, base_sha256 string, spans string"
    )
