"""Personal data by weak supervision.

Regex, gazetteer and context labelers vote on candidate spans (+1 personal, -1 not, 0 abstain). Expectation
maximisation over the counted vote patterns (a two-coin model per kind: prior, and each labeler's rates of +1, -1
and 0 under either class) estimates the labelers' reliabilities; its posteriors are the soft targets of a logistic
span classifier over votes and shape features, which decides on the candidates. Patterns are short strings over a
fixed alphabet, so their count is bounded by the labelers, not by the corpus; only counted patterns reach the driver.

Defined results: a null or empty text has no spans and the hash of the empty string; a null doc_id stays null;
repeated rows are each reported; an empty table gives an empty result and a model that accepts base spans only;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import record, slices, table, text_udf, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds.
MORE_KINDS = ("person", "ssn", "iban")
ORDER = {k: i for i, k in enumerate(KINDS + MORE_KINDS)}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digit runs are taken whole and never given back: a run that fails, fails from each of its digits.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{2,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{2,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}\b"),
    "phone": re.compile(r"(?<![0-9A-Za-z+=-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "person": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?|\b(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo) [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?"),
}
_DIGIT = re.compile("[0-9]")
#: Literals of which a loose pattern needs one; the other kinds need a digit.
_NEEDS = {
    "email": ("[dot]", "(dot)", " dot "),
    "person": ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "name is", "heiße", "appelle", "llamo"),
}
_GIVEN = frozenset("anna ben carlos clara daniel david elena emma eva felix hans ines james jan john jose juan julia klaus laura lena leon lucas luis maria marie mark martin mary max michael miguel nina olivia paul pedro peter pierre robert sara sofia thomas tom william".split())
_TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info co us ca ch at it nl".split())
_CALLING = ("+1", "+33", "+34", "+44", "+49", "+39", "+41", "+43", "+31", "+52", "+55", "+61", "+81", "+86", "+91")
_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|client|from", re.I),
    "card": re.compile(r"card|visa|master|credit|karte|carte|tarjeta|payment|cvv", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|telefon|tél|teléfono|handy", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "iban": re.compile(r"iban|konto|account|bank|compte|cuenta", re.I),
    "person": re.compile(r"dear|sincerely|regards|signed|author|lieber|cher|querido", re.I),
}
_AGAINST = re.compile(r"isbn|issn|doi|order|version|ticket|sha|hash|token|key|serial|revision|build|\bv$|§|no\.? ?$", re.I)
WINDOW = 40
LABELERS = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: the local part is the whole run before an @, back to the last match's end."""
    found, end = [], 0
    if "@" not in text:
        return found
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            end = m.end()
    return found


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the digit runs of a card's length that fail the checksum."""
    base = [("email", *s) for s in _emails(text)]
    failed = []
    if not _DIGIT.search(text):
        return base, failed
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in ((x.lstrip("0") or "0") for x in m.groups())):
            base.append(("ip", *m.span()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19:
                (base if luhn(digits) else failed).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                base.append(("phone", *m.span()))
    base.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return base, failed


def _votes(kind: str, text: str, start: int, end: int, is_base: bool) -> str:
    """The LABELERS' votes of one candidate over + - 0, then its shape: its length and its different characters, as a digit each."""
    got = text[start:end]
    before, after = text[max(0, start - WINDOW) : start], text[end : end + 12]
    joined = (before[-1:].isalnum() or before[-1:] in '"=/_') or (after[:1].isalnum() or after[:1] in '"=/_')
    digits = [c for c in got if c.isdigit()]
    regex = "+" if is_base else "0"
    if kind == "email":
        gaz = "+" if re.split(r"[.\s\])]", got.lower())[-1] in _TOP_DOMAINS else "-"
        form = "+" if "@" in got else "0"
    elif kind == "ip":
        gaz = "-" if got.startswith(("0.", "127.", "255.")) else "+"
        form = "-" if any(len(p) > 1 and p[0] == "0" for p in got.split(".")) else "+"
    elif kind == "card":
        gaz = "+" if re.match(r"4|5[1-5]|3[47]|6(?:011|5)|2[2-7]", got) else "-"
        form = "+" if luhn("".join(digits)) else "-"
    elif kind == "phone":
        gaz = "+" if got.startswith(_CALLING) else "0"
        form = "+" if 10 <= len(digits) <= 15 else "-"
    elif kind == "ssn":
        gaz = "-" if got[:3] in ("000", "666") or got[0] == "9" else "0"
        form = "-" if got[4:6] == "00" or got[7:] == "0000" else "+"
    elif kind == "iban":
        plain = got.replace(" ", "")
        turned = plain[4:] + plain[:4]
        gaz = "+" if plain[:2] in ("DE", "FR", "ES", "GB", "IT", "NL", "AT", "CH", "BE") else "0"
        form = "+" if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else "-"
    else:
        gaz = "+" if any(w.lower() in _GIVEN for w in got.split()) else "0"
        form = "+" if len(got.split()) >= 3 else "0"
    for_it = "+" if _CONTEXT[kind].search(before) else "0"
    against = "-" if _AGAINST.search(before[-14:]) else "0"
    apart = "-" if joined else "+"
    repeated = "-" if digits and len(set(digits)) == 1 else "0"
    shape = f"{min(9, (end - start) // 4)}{min(9, len(set(got)) // 2)}"
    return regex + form + gaz + for_it + against + apart + repeated + shape


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Base spans, and further candidates with their vote patterns; base spans carry votes through ``patterns``."""
    base, failed = base_spans(text)
    taken = {k: [s for s in base if s[0] == k] for k in KINDS}  # by start, and apart from each other
    starts = {k: [a for _, a, _ in own] for k, own in taken.items()}
    more = [(k, a, b, _votes(k, text, a, b, False)) for k, a, b in failed]
    digit = _DIGIT.search(text)
    for kind, loose in _LOOSE.items():
        if any(x in text for x in _NEEDS[kind]) if kind in _NEEDS else digit:
            for m in loose.finditer(text):
                at = bisect_left(starts.get(kind, ()), m.end())
                if not at or taken[kind][at - 1][2] <= m.start():
                    more.append((kind, *m.span(), _votes(kind, text, *m.span(), False)))
    return base, more


@dataclass
class Model:
    """The span classifier: weights of ``_span_features``; without any, no candidate is accepted."""

    weights: np.ndarray | None = None
    reliability: dict[str, np.ndarray] = field(default_factory=dict)
    threshold: float = 0.5
    probability: dict[tuple[str, str], float] = field(default_factory=dict)  # of the patterns that were asked for

    def accepts(self, kind: str, pattern: str) -> bool:
        if self.weights is None:
            return False
        if (kind, pattern) not in self.probability:
            self.probability[kind, pattern] = float(1 / (1 + np.exp(-np.clip(_span_features(kind, pattern) @ self.weights, -30, 30))))
        return self.probability[kind, pattern] >= self.threshold


def _span_features(kind: str, pattern: str) -> np.ndarray:
    """Kind, every labeler's vote, and the shape against its kind."""
    kinds = KINDS + MORE_KINDS
    x = np.zeros(len(kinds) * 3 + 3 * LABELERS)
    k = kinds.index(kind)
    x[k] = 1
    for i, c in enumerate(pattern[:LABELERS]):
        x[len(kinds) + 3 * i + _VALUE[c]] = 1
    shape = [int(c) / 9 for c in pattern[LABELERS:]]
    x[len(kinds) + 3 * LABELERS + 2 * k :][: len(shape)] = shape
    return x


_VALUE = {"+": 0, "-": 1, "0": 2}


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors by pattern, and each labeler's rates, shape (2 classes, labelers, 3 votes). Starts from the majority vote."""
    votes = np.array([[_VALUE[c] for c in p] for p in patterns])
    one_hot = np.eye(3)[votes]
    posterior = 1 / (1 + np.exp(-((votes == 0).sum(1) - 1.5 * (votes == 1).sum(1) - 1.0)))
    rates = np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        # Each labeler is held better than chance a priori: a personal span gets +, another one -.
        rates = np.einsum("cp,plv->clv", weight, one_hot) + np.array([[[1.0, 2, 2]], [[2.0, 1, 2]]])
        rates /= rates.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("plv,clv->cp", one_hot, np.log(rates)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-6:
            posterior = new
            break
        posterior = new
    return posterior, rates


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, penalty: float = 1e-2) -> np.ndarray:
    """Newton steps on weighted soft targets."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_counts(rows: list[tuple[str, str, int]]) -> Model:
    """EM by kind over the counted votes, then one span classifier over all kinds, votes and shapes."""
    model = Model()
    if not rows:
        return model
    xs, ys, ws = [], [], []
    for kind in sorted({r[0] for r in rows}, key=ORDER.get):
        own = sorted((p, n) for k, p, n in rows if k == kind)
        counts: Counter = Counter()
        for p, n in own:
            counts[p[:LABELERS]] += n
        votes = sorted(counts)
        posterior, model.reliability[kind] = expectation_maximisation(votes, np.array([counts[v] for v in votes], float))
        of = dict(zip(votes, posterior.tolist(), strict=True))
        for p, n in own:
            xs.append(_span_features(kind, p)), ys.append(of[p[:LABELERS]]), ws.append(n)
    w = np.array(ws, float)
    model.weights = _logistic(np.array(xs), np.array(ys), w / w.sum() * min(w.sum(), 1e5))
    return model


_COUNTS = pa.schema([("kind", pa.string()), ("votes", pa.string()), ("n", pa.int64())])


def _count(batches):
    seen: Counter = Counter()
    for batch in slices(batches):
        for text in texts_of(batch):
            base, more = candidates(text)
            for k, a, b in base:
                seen[k, _votes(k, text, a, b, True)] += 1
            for k, _, _, votes in more:
                seen[k, votes] += 1
    yield record(_COUNTS, kind=[k for k, _ in seen], votes=[v for _, v in seen], n=list(seen.values()))


def fit(docs: DataFrame) -> Model:
    """One pass over all texts; each task sends its counted patterns, the driver gets one row a pattern."""
    counted = docs.select("text").mapInArrow(_count, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    return fit_counts([(r.kind, r.votes, r.n) for r in counted.collect()])


def find(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by start, then kind."""
    base, more = candidates(text)
    spans = base + [(k, a, b) for k, a, b, votes in more if model.accepts(k, votes)]
    return base, sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def rendered(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each span by its kind in brackets; overlapping spans are joined under the first one's kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row a document: counts and digest of the base spans, all spans."""
    model = model or fit(docs)

    def run(batches):
        for batch in slices(batches):
            found = [find(t, model) for t in texts_of(batch)]
            yield record(
                _SPANS,
                doc_id=batch.column("doc_id"),
                **{f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS},
                base_sha256=[hashlib.sha256(rendered(base).encode()).hexdigest() for base, _ in found],
                spans=[rendered(spans) for _, spans in found],
                n_spans=[len(spans) for _, spans in found],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with every span replaced by its kind; n_chars follows the new text. A null text stays null."""
    model = model or fit(docs)

    clean = text_udf(lambda texts: [None if t is None else redact(t, find(t, model)[1]) for t in texts], "string", pa.string())
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii_spans": op1_pii_spans}
ORACLES: dict[str, str] = {}
