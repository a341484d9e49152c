"""Personal data: exact base kinds, and a span classifier trained on labelers whose reliabilities EM estimates."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrowtext import pieces
from tessera.llm.shared import map_arrow

#: Kinds in the order of span lists: those of the contract, then the classifier's.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "number", "name", "address")

#: Words that speak for or against personal data or a secret just before a span (fixed values).
CONTEXT_FOR = {"account", "address", "apikey", "bearer", "call", "card", "contact", "email", "fax", "iban", "id", "key", "mail", "mobile", "named", "passphrase", "passport", "passwd", "password", "phone", "pin", "pwd", "secret", "ssn", "tel", "telephone", "token"}
CONTEXT_AGAINST = {"article", "chapter", "edition", "figure", "in", "page", "pages", "paragraph", "pp", "section", "since", "table", "version", "vol", "volume", "year", "isbn"}
#: After these a word is a candidate whatever it is made of (fixed values).
SECRET_WORDS = ("api key", "apikey", "passphrase", "passwd", "password", "pwd", "secret", "token")
TITLES = ("Dr", "Frau", "Herr", "Madame", "Miss", "Monsieur", "Mr", "Mrs", "Ms", "Prof", "Señor", "Señora")
#: Starts of keys that services give out, and of words that aren't secrets (fixed values).
GAZETTEER_FOR = ("akia", "asia", "eyj", "ghp_", "gho_", "glpat-", "pk_live_", "sk_live_", "sk_test_", "xoxb-", "xoxp-")
GAZETTEER_AGAINST = ("http", "md5", "sha1", "sha256", "utf-8", "iso", "rfc", "v1", "v2", "v3")
#: Common given names, surnames and words of streets (fixed values).
GIVEN_NAMES = (
    "Ahmed Alexander Alice Amelia Andrea Andreas Andrew Angela Anita Anna Anthony Antonio Barbara Benjamin Brian Camille Carlos Carmen Catherine Charles Charlotte Chloe Christian Christina Christopher "
    "Claire Claudia Daniel David Deborah Diego Dmitri Donald Edward Elena Elizabeth Emily Emma Eric Fatima Felix Florian Francesca Francisco Frank Frederick Gabriel George Giulia Hannah Hans Heinrich Helen "
    "Hiroshi Ibrahim Ingrid Isabella Ivan James Jan Jane Javier Jean Jennifer Jessica Joan John Jonas Jorge José Joseph Juan Julia Julien Karen Katharina Kenneth Kevin Klaus Laura Lena Linda Lisa Lucas "
    "Luis Lukas Manuel Marco Margaret Maria María Marie Mark Martin Mary Matthew Maximilian Michael Miguel Mohammed Monika Nancy Nicolas Nina Olga Oliver Olivia Pablo Patricia Patrick Paul Pedro Peter "
    "Petra Philip Pierre Priya Rachel Rafael Ravi Rebecca Richard Robert Rosa Ruth Samuel Sandra Sarah Sebastian Sergei Simon Sofia Sophie Stefan Stephen Susan Sven Thomas Timothy Ursula Valentina Victoria William Wolfgang Yuki"
).split()
SURNAMES = (
    "Adams Ali Alvarez Anderson Bailey Baker Bauer Becker Bell Bennett Bernard Bianchi Brown Campbell Carter Chen Clark Collins Cook Cooper Cox Cruz Davies Davis Diaz Dubois Durand Edwards Evans Fernandez "
    "Ferrari Fischer Foster Garcia García Gomez Gonzalez Gray Green Hall Harris Hernandez Hill Hoffmann Howard Hughes Ivanov Jackson Jenkins Johansson Johnson Jones Kelly Kim King Klein Koch Kowalski Kumar Lambert "
    "Laurent Lee Lefebvre Leroy Lewis Lopez Martin Martinez Mayer Meyer Miller Mitchell Moore Moreau Morgan Moreno Morris Müller Murphy Nakamura Nelson Neumann Nguyen Novak Ortiz Parker Patel Perez Petrov Phillips "
    "Popov Price Ramirez Richter Rivera Roberts Robinson Rodriguez Rossi Ruiz Russo Sanchez Sanders Santos Sato Schmidt Schneider Schulz Schwarz Scott Sharma Silva Simmons Singh Smith Stewart Suzuki Tanaka Taylor "
    "Thompson Torres Turner Vogel Wagner Walker Wang Ward Watson Weber White Williams Wilson Wolf Wood Wright Yamamoto Young Zhang Zimmermann"
).split()
STREETS = "Allee Avenue Ave Boulevard Blvd Calle Court Drive Gasse Highway Lane Parkway Place Platz Plaza Road Rd Rue Square Street St Strasse Straße Terrace Via Way Weg".split()

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EDGES = "\"'`()[]{}<>.,;:!?*#%$&|="
_HEX = re.compile(r"[0-9A-Fa-f]{16,}")
_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{9,}|(?:[0-9]{4}[ -]){3}[0-9]{4}|\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}")
_PLAIN = re.compile(r"[0-9]{1,4}|[0-9]+[.,][0-9]+|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?")
#: What may hold blanks: numbers in groups, what is said to be secret, names, addresses.  Each has a cheap sign that it needs.
_NUMBERS = re.compile(rf"(?<![\w.])(?:{_ID.pattern})(?![\w])")
_SECRET = re.compile(rf"(?i)\b(?:{'|'.join(SECRET_WORDS)})(?:\s+is\s+|\s*[:=]\s*|\s+)[\"'`]?(?P<span>[^\s\"'`]{{6,}})")
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
_NAME = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.? (?P<titled>{_CAPITAL}(?: {_CAPITAL})?)|(?P<given>(?:{'|'.join(GIVEN_NAMES)})(?: [A-Z]\.)? {_CAPITAL}))")
_ADDRESS = re.compile(
    rf"(?<![\w.])[0-9]{{1,5}}[a-z]? (?:{_CAPITAL} ){{1,3}}(?:{'|'.join(STREETS)})\b|\b(?:Avenue|Boulevard|Calle|Plaza|Rue|Via) (?:\w+ ){{0,3}}{_CAPITAL},? [0-9]{{1,4}}\b"
    r"|\b[A-ZÄÖÜ]\w*(?:allee|gasse|platz|strasse|straße|weg) [0-9]{1,4}[a-z]?\b"
)
_WITH_DIGIT = re.compile(r"(?<!\S)[^\s0-9]*[0-9]\S*")
#: In RE2's terms, what a text needs to have any candidate.
_SIGNS = rf"[0-9@]|(?i:{'|'.join(SECRET_WORDS)})|(?:{'|'.join(TITLES)})\.? |(?:{'|'.join(GIVEN_NAMES)}) "
_SAYS_SECRET = re.compile(rf"(?i){'|'.join(SECRET_WORDS)}")

LABELERS = ("shape", "gazetteer", "context", "entropy", "base")
#: How likely votes against, none and for are thought to be, by truth.
BELIEF = ((0.4, 0.55, 0.05), (0.05, 0.55, 0.4))
#: Votes are 0 against, 1 abstain, 2 for; features are small numbers, each with its count of values.
FEATURES = (("length", 6), ("digits", 4), ("letters", 3), ("joined", 2), ("class", 4))
_GIVEN, _SURNAMES, _STREETS = frozenset(GIVEN_NAMES), frozenset(SURNAMES), frozenset(x.lower() for x in STREETS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start; leftmost and non-overlapping for each kind, in linear time."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
        # Parts of an address that fails start the next one's at the earliest.
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _pattern(text: str, start: int, end: int, before: list[str], kind: int) -> tuple[int, int]:
    """Votes and features of a candidate, each packed into one number."""
    s = text[start:end]
    low, words = s.lower(), s.split()
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    near = {w.strip(_EDGES).lower() for w in before}
    entropy = _entropy(s)
    context = 2 if near & CONTEXT_FOR else 0 if near & CONTEXT_AGAINST else 1
    if kind == 6:  # a name: its words' forms, lists of names, titles before it
        shape = 2 if len(words) >= 2 else 1
        known = (words[0] in _GIVEN) + (words[-1].removesuffix("'s") in _SURNAMES)
        gazetteer = 2 if known == 2 or len(words) == 1 and words[0] in _SURNAMES else 1 if known else 0
        context = 2 if before and before[-1].rstrip(".") in TITLES or near & CONTEXT_FOR else 1
        spread = 1
    elif kind == 7:  # an address: form, words of streets, a number
        shape = 2
        gazetteer = 2 if any(w.strip(",").lower() in _STREETS for w in words) else 1
        spread = 1
    else:
        shape = 2 if _HEX.fullmatch(s) and digits or _ID.fullmatch(s) else 0 if _PLAIN.fullmatch(s) or len(s) < 6 else 1
        gazetteer = 2 if low.startswith(GAZETTEER_FOR) else 0 if low.startswith(GAZETTEER_AGAINST) else 1
        spread = 2 if len(s) >= 16 and entropy >= 3.0 and letters and digits else 0 if entropy < 2.0 else 1
    votes = 0
    for v in (shape, gazetteer, context, spread, 2 if kind < len(BASE_KINDS) else 1):
        votes = votes * 3 + v
    share = digits / len(s)
    values = (min(5, len(s).bit_length() - 1), min(3, int(share * 4)), 0 if not letters else 1 if letters * 2 < len(s) else 2, int(any(c in s for c in " .-/_")), max(0, kind - len(BASE_KINDS)))
    features = 0
    for v, (_, n) in zip(values, FEATURES, strict=True):
        features = features * n + v
    return votes, features


def _proposed(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what may be personal, best first: patterns that may hold blanks, then single words with a digit."""
    for m in _ADDRESS.finditer(text):
        yield 7, m.start(), m.end()
    for m in _NAME.finditer(text):
        yield 6, *m.span("titled" if m["titled"] else "given")
    for m in _NUMBERS.finditer(text):
        yield 4 if any(c.isalpha() for c in m[0]) else 5, m.start(), m.end()
    if _SAYS_SECRET.search(text):
        for m in _SECRET.finditer(text):
            s, e = m.span("span")
            yield 4, s, e - (len(m["span"]) - len(m["span"].rstrip(".,;:!?)")))
    for m in _WITH_DIGIT.finditer(text):
        w = m[0]
        s = m.start() + len(w) - len(w.lstrip(_EDGES))
        e = m.end() - (len(w) - len(w.rstrip(_EDGES)))
        if s < e:
            yield 4 if sum(c.isalpha() for c in text[s:e]) else 5, s, e


def candidates(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(kind, start, end, votes, features): base spans (kind 0 to 3), then others that overlap none before them (kind 4 to 7)."""
    taken: list[tuple[int, int]] = []
    for kind, s, e in base_spans(text):
        insort(taken, (s, e))
        yield (kind, s, e, *_pattern(text, s, e, text[max(0, s - 40) : s].split()[-3:], kind))
    # Base spans of two kinds may overlap; then what is free is what lies in no merged one.
    merged: list[tuple[int, int]] = []
    for s, e in taken:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    for kind, s, e in _proposed(text):
        i = bisect_right(merged, (s, e))
        if s >= e or i and merged[i - 1][1] > s or i < len(merged) and merged[i][0] < e:
            continue
        merged.insert(i, (s, e))
        yield (kind, s, e, *_pattern(text, s, e, text[max(0, s - 40) : s].split()[-3:], kind))


def _some(column: pa.Array) -> np.ndarray:
    """Rows whose text can have candidates: a digit, an at sign, or a word that names or secrets go with."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, _SIGNS), False).to_numpy(zero_copy_only=False))


PATTERNS = T.StructType([T.StructField(c, T.LongType()) for c in ("votes", "features", "many")])


def patterns(docs: DataFrame, text: str) -> DataFrame:
    """(votes, features, many) over all candidates of all texts; the votes and features bound the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            found: Counter = Counter()
            for i in _some(batch.column(0)):
                found.update((v, f) for _, _, _, v, f in candidates(batch.column(0)[i].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array(list(found.values()))], names=PATTERNS.fieldNames())

    return map_arrow(docs.select(F.col(f"`{text}`").alias("text")), run, PATTERNS).groupBy("votes", "features").agg(F.sum("many").alias("many"))


def _unpack(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    out = np.zeros((len(x), len(sizes)), np.int64)
    for j in range(len(sizes) - 1, -1, -1):
        out[:, j] = x % sizes[j]
        x = x // sizes[j]
    return out


def reliabilities(votes: np.ndarray, many: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for labelers that vote independently given the truth (Dawid and Skene, 1979).

    votes: a row a pattern, 0, 1 or 2 by labeler; many: how often.  Returns the
    probability that each pattern is personal data, and, by truth, labeler and
    vote, how likely the vote is.  The start is the majority; what the base
    labeler marks is taken as true throughout.  A labeler is held to be better
    than chance by prior counts (``BELIEF``), a tenth of the candidates but base
    spans: without them, truth and its opposite could change places.
    """
    held = 1.0 + 0.1 * many[votes[:, LABELERS.index("base")] < 2].sum()
    sure = votes[:, LABELERS.index("base")] == 2
    p = np.clip(0.5 + (votes - 1).sum(1) / 4.0, 0.05, 0.95)
    p[sure] = 1.0
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        prior = (many @ p + 1) / (many.sum() + 2)
        for t, weight in ((1, many * p), (0, many * (1 - p))):
            for j in range(votes.shape[1]):
                n = np.bincount(votes[:, j], weight, minlength=3) + held * np.array(BELIEF[t])
                table[t, j] = n / n.sum()
        log = np.array([math.log(1 - prior), math.log(prior)])[:, None] + sum(np.log(table[:, j, votes[:, j]]) for j in range(votes.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        p[sure] = 1.0
    return p, table


def _design(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """One-hot columns of the votes (without the base labeler's, which a classifier of other spans never sees) and features."""
    columns = [np.ones(len(votes))]
    columns += [(votes[:, j] == v).astype(float) for j in range(votes.shape[1] - 1) for v in (0, 2)]
    columns += [(features[:, j] == v).astype(float) for j, (_, n) in enumerate(FEATURES) for v in range(n)]
    return np.stack(columns, 1)


def fit(votes: np.ndarray, features: np.ndarray, many: np.ndarray, p: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on the patterns, weighted by how often they are, with p as labels: ridge-penalised Newton steps."""
    x, w = _design(votes, features), np.zeros(1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (many * (q - p)) + ridge * w
        curve = (x * (many * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return w


class SpanModel:
    """Decides by votes and features, with weights of their own for each class of spans (None: accepts none)."""

    def __init__(self, weights: list[np.ndarray | None], least: float) -> None:
        self.weights, self.least = weights, least

    def table(self) -> np.ndarray:
        """Accepted, by packed votes and features."""
        v = _unpack(np.arange(3 ** len(LABELERS)), [3] * len(LABELERS))
        f = _unpack(np.arange(int(np.prod([n for _, n in FEATURES]))), [n for _, n in FEATURES])
        x = _design(np.repeat(v, len(f), 0), np.tile(f, (len(v), 1)))
        p = np.stack([np.zeros(len(x)) if w is None else 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for w in self.weights], 1)
        return (p[np.arange(len(x)), np.tile(f[:, -1], len(v))] >= self.least).reshape(len(v), len(f))


def train(docs: DataFrame, text: str = "text", least: float = 0.8) -> SpanModel:
    """The classifier for docs, trained on the votes over all of their texts (no sample)."""
    rows = sorted(map(tuple, patterns(docs, text).collect()))  # at most 243 * 576 rows
    packed = np.array(rows, np.int64).reshape(-1, 3)
    votes, features, many = _unpack(packed[:, 0], [3] * len(LABELERS)), _unpack(packed[:, 1], [n for _, n in FEATURES]), packed[:, 2].astype(float)
    sure = votes[:, LABELERS.index("base")] == 2
    weights: list[np.ndarray | None] = [None] * FEATURES[-1][1]
    # A labeler is as good as it is on one sort of spans; base spans are examples for secrets and numbers.
    for classes in ((0, 1), (2,), (3,)):
        own = np.isin(features[:, -1], classes) & ~sure
        if own.any():
            own |= sure & (0 in classes)
            p, _ = reliabilities(votes[own], many[own])
            for c in classes:
                weights[c] = fit(votes[own], features[own], many[own], p)
    return SpanModel(weights, least)


def spans_of(text: str, accepted: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start: all base spans, and other candidates that the classifier accepts."""
    return sorted((k, s, e) for k, s, e, v, f in candidates(text) if k < len(BASE_KINDS) or accepted[v, f])


def name_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


ADDED = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), *(T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS[len(BASE_KINDS) :], "spans")), T.StructField("redacted", T.StringType())])


def find_pii(docs: DataFrame, text: str = "text", *, model: SpanModel | None = None, redact: bool = False) -> DataFrame:
    """Adds to each row the personal data in its text.

    Base kinds are found by rule (``base_spans``).  Candidates are numbers in
    groups, what follows a word like "password", names after titles or given
    names, addresses, and other words with a digit: labelers (shape, gazetteer,
    context, entropy and the base rules) vote on every candidate of every text,
    EM estimates how reliable each is on each class of candidates, and a
    logistic regression learns the probabilities; candidates it accepts are
    spans ``secret``, ``number`` (no letters), ``name`` or ``address``.  They
    never overlap base spans or each other.

    Adds ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``,
    ``spans``, ``n_secret``, ``n_number``, ``n_name``, ``n_address``, ``n_spans`` (all) and, if ``redact``, ``redacted``: the text with each span (of
    overlapping ones their union, under the first one's name) replaced by its
    kind in angle brackets.  Columns of these names are replaced.  A null or
    empty text has no spans (redacted stays null or empty).  Repeated rows are
    treated alike; an empty table gives an empty one.  Two passes; what is
    shuffled and collected is counts of vote patterns.
    """
    accepted = (model or train(docs, text)).table()
    schema_added = [f for f in ADDED if redact or f.name != "redacted"]
    keep = [c for c in docs.columns if c == text or c not in {f.name for f in schema_added}]
    base = docs.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*base.schema.fields, *schema_added])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            source, n = batch.column(keep.index(text)), batch.num_rows
            counts = np.zeros((len(KINDS), n), np.int64)
            sha, names, clean = [nothing] * n, [""] * n, [None] * n
            for i in _some(source):
                t = source[i].as_py()
                found = spans_of(t, accepted)
                if not found:
                    continue
                own = [x for x in found if x[0] < len(BASE_KINDS)]
                for k, _, _ in found:
                    counts[k, i] += 1
                if own:
                    sha[i] = hashlib.sha256(name_spans(own).encode()).hexdigest()
                names[i] = name_spans(found)
                if redact:
                    clean[i] = _redacted(t, found)
            nb = len(BASE_KINDS)
            columns = [*batch.columns, *map(pa.array, counts[:nb]), pa.array(sha), pa.array(names), *map(pa.array, counts[nb:]), pa.array(counts.sum(0))]
            if redact:
                columns.append(pc.coalesce(pa.array(clean, source.type), source))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return map_arrow(base, run, schema)


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs).drop("text")
