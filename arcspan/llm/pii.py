"""Personal data: weak-supervision aggregation.

Base spans (e-mail, IP address, card and phone number) come from fixed rules and always stay. Wider patterns propose further
candidates of these kinds, and credentials ("secret"). Six labelers vote on every candidate, base or not, and need not agree: a
strict form of the kind, a gazetteer (:class:`Gazetteers`: domains, calling codes, card issuers, reserved networks, known beginnings
of credentials), the words on its left, the shape (check digits, lengths, mix of characters), the characters beside it, and the words
of its line that speak of other numbers. Votes are for, against or none, so a candidate falls under one of a few thousand vote
patterns; only counts of patterns reach the driver, whatever the corpus size. Expectation-maximisation estimates how reliable each
labeler is from the counts, and a logistic span classifier is trained on the resulting soft labels. Candidates that it accepts, and
that overlap no base span, are added.

Texts are scanned whole, in linear time: digits and at signs are found with numpy and other texts are left at once; no pattern
backtracks over a long run, and overlaps are found by bisection. A long text takes memory for itself and its candidates.

Defined results: a null or empty text has no span; of candidates that overlap, the kind listed first and then the leftmost stays;
repeated rows each get a result; without candidates no model is needed; an empty table gives an empty table; only the key and the
text are read, and :func:`mask` keeps other columns whatever their names. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import as_bytes, cut, lean, slices, table

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
N_BASE = 4
FOR, AGAINST = 1, 2
LABELERS = ("strict", "gazetteer", "left", "shape", "beside", "line")
N_LABELERS = len(LABELERS)
#: Lowest probability of the span classifier that adds a span.
THRESHOLD = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Wider patterns, by kind.
_WIDE = (
    (EMAIL, re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){1,8}")),
    (IP, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (CARD, re.compile(r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/])")),
    (PHONE, re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])|(?<![0-9+])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])")),
    (SECRET, re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,80}[0-9])[A-Za-z0-9_+/-]{16,512}(?![A-Za-z0-9_+/-])")),
)
_CONTEXT = tuple(
    re.compile(rf"\b(?:{words})\b[^\n]{{0,12}}$", re.IGNORECASE)
    for words in ("e-?mail|mail|contact|write to|reach", "ip|host|server|address|addr", "card|visa|mastercard|amex|credit|payment", "phone|tel|telephone|call|fax|mobile|cell|contact", "token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|bearer|credentials?|private[_ -]?key")
)
_AGAINST = re.compile(r"\b(?:version|isbn|issn|doi|order|invoice|section|figure|fig|no|chapter|commit|revision|sha-?1|sha-?256|md5|checksum|digest|uuid|build)\b[^\n]{0,6}$", re.IGNORECASE)
_OTHER_LINE = re.compile(r"\b(?:version|isbn|issn|invoice|serial|chapter|checksum|commit|revision|build|score|table of)\b", re.IGNORECASE)
_STRICT = (
    re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.)){0,62}[A-Za-z0-9]?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}"),
    re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    re.compile(r"\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"),
    re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=[^\n]*[a-z])(?=[^\n]*[A-Z])[A-Za-z0-9_+/-]{20,})"),
)


@dataclass(frozen=True)
class Gazetteers:
    """What is known of addresses, numbers and credentials. Any can be given anew, see :func:`gazetteers`.

    Two letters are a country's domain, and one to three digits that begin with no zero a calling code, as the numbering plan has it.
    """

    domains: frozenset[str]
    #: First digits of cards from one number to another, and lengths.
    issuers: tuple[tuple[str, str, tuple[int, ...]], ...]
    #: Networks that belong to no person: first address and bits.
    reserved: tuple[tuple[int, int], ...]
    #: How credentials of known makers begin.
    beginnings: tuple[str, ...]

    def domain(self, name: str) -> bool:
        return len(name) == 2 and name.isalpha() or name in self.domains

    def issuer(self, digits: str) -> bool:
        return any(a <= digits[: len(a)] <= b and len(digits) in lengths for a, b, lengths in self.issuers)

    def personal(self, octets: list[int]) -> bool:
        address = sum(x << (24 - 8 * k) for k, x in enumerate(octets))
        return not any(address >> (32 - bits) == net >> (32 - bits) for net, bits in self.reserved)


def _net(text: str) -> tuple[int, int]:
    address, bits = text.split("/")
    return sum(int(x) << (24 - 8 * k) for k, x in enumerate(address.split("."))), int(bits)


# Generic domains, issuer numbers of cards, special-purpose networks, beginnings of credentials.
DEFAULT = Gazetteers(
    frozenset("com org net edu gov mil int info biz name pro mobi jobs travel museum coop aero cat asia post tel arpa app dev page blog cloud online site shop store tech xyz top live email agency media news world life example test invalid localhost".split()),
    (("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("36", "36", (14, 19)), ("300", "305", (14, 16)), ("38", "39", (14, 16)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16, 17, 18, 19)), ("62", "62", (16, 17, 18, 19)), ("50", "50", (13, 14, 15, 16, 17, 18, 19)), ("56", "58", (13, 14, 15, 16, 17, 18, 19)), ("60", "63", (13, 14, 15, 16, 17, 18, 19)), ("67", "69", (13, 14, 15, 16, 17, 18, 19))),
    tuple(map(_net, "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split())),
    ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "eyJ", "ya29"),
)
#: Rows that a table of a gazetteer may have, as it is sent to all tasks.
MOST_KNOWN = 1_000_000


def gazetteers(domains: DataFrame | None = None, reserved: DataFrame | None = None, beginnings: DataFrame | None = None) -> Gazetteers:
    """Gazetteers of one-column tables (domains, networks as address/bits, beginnings); the default where none is given."""

    def rows(t: DataFrame) -> list[str]:
        found = [r[0] for r in t.limit(MOST_KNOWN + 1).collect() if r[0] is not None]
        if len(found) > MOST_KNOWN:
            raise ValueError(f"a gazetteer has more than {MOST_KNOWN} rows")
        return found

    return Gazetteers(
        DEFAULT.domains if domains is None else frozenset(x.lower().lstrip(".") for x in rows(domains)),
        DEFAULT.issuers,
        DEFAULT.reserved if reserved is None else tuple(map(_net, rows(reserved))),
        DEFAULT.beginnings if beginnings is None else tuple(rows(beginnings)),
    )


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in s.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed rules, by kind and start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((EMAIL, start, done))
        at = text.find("@", max(at + 1, done))
    out += [(IP, *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [(CARD, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, clear of base spans and of each other."""
    taken, out = sorted((s, e) for _, s, e in base), []
    for kind, pattern in _WIDE:
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        found = []
        for m in pattern.finditer(text):
            at = bisect_left(starts, m.end())
            if not at or ends[at - 1] <= m.start():
                found.append(m.span())
        out += [(kind, *x) for x in found]
        taken = sorted(taken + found)
    return out


def _entropy(span: str) -> float:
    n = np.unique(np.frombuffer(span.encode(), np.uint8), return_counts=True)[1] / len(span)
    return float(-(n * np.log2(n)).sum())


def votes(text: str, kind: int, start: int, end: int, base: bool, g: Gazetteers = DEFAULT) -> int:
    """Votes of the labelers, two bits each, in the order of :data:`LABELERS`."""
    span, left = text[start:end], text[max(0, start - 40) : start]
    digits = _digits(span)
    plain = re.sub(r" ?(?:\[at\]|\(at\)) ?", "@", re.sub(r" ?(?:\[dot\]|\(dot\)) ?", ".", span)) if kind == EMAIL else span
    strict = FOR if _STRICT[kind].fullmatch(plain) else AGAINST if base else 0
    context = AGAINST if _AGAINST.search(left) else FOR if _CONTEXT[kind].search(left) else 0
    if kind == EMAIL:
        gazetteer = FOR if g.domain(plain.rpartition(".")[2].lower()) else AGAINST
        shape = FOR if len(plain) <= 254 and ".." not in plain else AGAINST
    elif kind == IP:
        four = [int(x.lstrip("0") or 0) for x in span.split(".")] if ":" not in span else []
        gazetteer = 0 if not four else FOR if g.personal(four) else AGAINST
        shape = FOR if ":" in span or all(len(p) <= 3 for p in span.split(".")) else AGAINST
    elif kind == CARD:
        gazetteer = FOR if g.issuer(digits) else 0
        shape = FOR if luhn(digits) and len(set(digits)) > 2 else AGAINST
    elif kind == PHONE:
        national = digits[2:] if span[0] != "+" and digits.startswith("00") else digits
        gazetteer = FOR if national[0] != "0" else AGAINST
        shape = FOR if len(set(digits)) > 2 and 7 <= len(national) <= 15 else AGAINST
    else:
        gazetteer = FOR if span.startswith(g.beginnings) else 0
        mixed = len(digits) >= 3 and len(digits) < len(span) and _entropy(span) >= 3
        shape = FOR if mixed else AGAINST
    near = text[max(0, start - 1) : start] + text[end : end + 1]
    beside = AGAINST if any(c.isalnum() or c in "_/\\:" for c in near) else FOR if near.strip(" \t\n.,;()\"'=") == "" else 0
    begin, stop = text.rfind("\n", max(0, start - 120), start) + 1, text.find("\n", end, end + 120)
    line = text[max(begin, start - 120) : stop if stop >= 0 else end + 120]
    other = AGAINST if _OTHER_LINE.search(line) else 0
    return sum(v << 2 * k for k, v in enumerate((strict, gazetteer, context, shape, beside, other)))


def candidates(text: str, g: Gazetteers = DEFAULT) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, votes) of all candidates of a text."""
    base = base_spans(text)
    out = [(k, s, e, True, votes(text, k, s, e, True, g)) for k, s, e in base]
    return out + [(k, s, e, False, votes(text, k, s, e, False, g)) for k, s, e in wide_spans(text, base)]


_HINT = np.zeros(256, bool)
_HINT[[*range(48, 58), 64]] = True
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32())]))
_SCHEMA = "found array<struct<kind:int,s:int,e:int,base:boolean,votes:int>>"


def _scan(column: pa.Array, g: Gazetteers = DEFAULT) -> list[list[tuple]]:
    """Candidates of each text. Without a digit, an at sign or a bracketed "at" a text has none."""
    out: list[list[tuple]] = [[]] * len(column)
    for i, j in slices(column, 1 << 22):
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset + i : column.offset + j + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        hint = np.flatnonzero(_HINT[raw])
        at = np.flatnonzero((raw == 91) | (raw == 40))
        if len(at):
            at = at[at + 3 < len(raw)]
            hint = np.sort(np.concatenate([hint, at[(raw[at + 1] == 97) & (raw[at + 2] == 116)]]))
            at = np.flatnonzero(raw == 58)
            hint = np.sort(np.concatenate([hint, at]))
        elif (raw == 58).any():
            hint = np.sort(np.concatenate([hint, np.flatnonzero(raw == 58)]))
        rows = np.unique(np.searchsorted(off - off[0], hint, "right") - 1)
        for k in rows.tolist():
            out[i + k] = candidates(raw[off[k] - off[0] : off[k + 1] - off[0]].tobytes().decode(), g)
    return out


def _propose(batches: Iterator[pa.RecordBatch], g: Gazetteers = DEFAULT) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _scan(as_bytes(batch.column(batch.num_columns - 1)), g)
        names = ("kind", "s", "e", "base", "votes")
        rows = [[dict(zip(names, x, strict=True)) for x in spans] for spans in found]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, _FOUND)], names=[*batch.schema.names[:-1], "found"])


def propose(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), g: Gazetteers = DEFAULT) -> DataFrame:
    """All candidates of each text with their votes."""
    read = docs.select(*keep, F.col(text))
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in read.schema.fields[:-1])
    return read.mapInArrow(lean(lambda b: _propose(b, g)), keys + _SCHEMA)


def reliabilities(kind: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: soft labels, and P(vote | label) by labeler.

    kind and v (patterns x labelers) give each pattern, n its count. Priors say that labelers are better than chance, so that
    the labels keep their meaning where the data says little.
    """
    prior = np.array([[2.0, 1.0, 4.0], [2.0, 4.0, 1.0]])  # label x (none, for, against)
    p = np.clip(0.5 + 0.2 * ((v == FOR).sum(1) - (v == AGAINST).sum(1)), 0.05, 0.95)
    theta = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        share = np.array([(1 + (n * p)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        for l in range(v.shape[1]):  # noqa: E741
            for z, w in enumerate((n * (1 - p), n * p)):
                got = prior[z] + np.bincount(v[:, l], w, 3)
                theta[l, z] = got / got.sum()
        odds = np.log(share[kind]) - np.log(1 - share[kind])
        for l in range(v.shape[1]):  # noqa: E741
            odds = odds + np.log(theta[l, 1, v[:, l]]) - np.log(theta[l, 0, v[:, l]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, theta


def _features(kind: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(len(KINDS))[kind], v == FOR, v == AGAINST], 1).astype(float)


def train(kind: np.ndarray, v: np.ndarray, n: np.ndarray, p: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of the span classifier: logistic regression on soft labels, by Newton's method. Counts are damped by a root."""
    x, w, beta = _features(kind, v), np.sqrt(n), np.zeros(len(KINDS) + 2 * v.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (q - p)) + ridge * beta
        hessian = (x * (w * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta = beta - np.linalg.solve(hessian, gradient)
    return beta


def accepted(beta: np.ndarray | None, kind: int, code: int) -> bool:
    if beta is None:
        return False
    v = np.array([[code >> 2 * i & 3 for i in range(N_LABELERS)]])
    return bool(_features(np.array([kind]), v) @ beta >= np.log(THRESHOLD / (1 - THRESHOLD)))


def fit(found: DataFrame) -> frozenset[tuple[int, int]]:
    """The (kind, votes) patterns that the span classifier accepts. At most 5 x 729 patterns reach the driver."""
    rows = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").count().collect()
    rows.sort()
    if not rows:
        return frozenset()
    kind, code, n = (np.array([r[i] for r in rows]) for i in range(3))
    v = np.stack([code >> 2 * i & 3 for i in range(N_LABELERS)], 1)
    p, _ = reliabilities(kind, v, n.astype(float))
    beta = train(kind, v, n.astype(float), p)
    return frozenset((int(k), int(c)) for k, c in zip(kind, code, strict=True) if accepted(beta, int(k), int(c)))


def chosen(spans: list[tuple], patterns: frozenset) -> list[tuple[int, int, int]]:
    """Base spans and accepted ones, by kind and start."""
    return sorted((k, s, e) for k, s, e, base, code in spans if base or (k, code) in patterns)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def digests(docs: DataFrame, g: Gazetteers = DEFAULT) -> DataFrame:
    """Counts of base spans, their digest, all spans, and the number of added ones of each document."""
    found = cut(propose(docs, g=g))
    patterns = fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans, added = [[] for _ in range(N_BASE)], [], [], []
            for row in batch.column(1).to_pylist():
                got = [tuple(x.values()) for x in row]
                base = sorted(x[:3] for x in got if x[3])
                for k in range(N_BASE):
                    counts[k].append(sum(x[0] == k for x in base))
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                every = chosen(got, patterns)
                spans.append(written(every))
                added.append(len(every) - len(base))
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"n_{k}" for k in KINDS[:N_BASE]], "base_sha256", "spans", "n_added"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(lean(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are replaced as one, by the first one's kind."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text", g: Gazetteers = DEFAULT) -> DataFrame:
    """The documents with personal data masked, all other columns as they are (``n_chars``, if there, follows the text)."""
    patterns = fit(propose(docs, text, (), g))
    names = docs.columns
    last = docs.select(*[c for c in names if c != text], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            found = _scan(as_bytes(column), g)
            if any(found):
                new = [mask_text(x.as_py(), chosen(f, patterns)) if f else x.as_py() for x, f in zip(column, found, strict=True)]
                batch = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, column.type)], names=batch.schema.names)
            yield batch

    out = last.mapInArrow(lean(run), last.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
