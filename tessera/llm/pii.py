"""Personal data by patterns and a skip-chain conditional random field.

Base spans.  Emails, IP addresses, card numbers and phone numbers are matched over the whole text, leftmost
and without overlap within a kind; matches that fail their check (parts of an address over 255, the Luhn
sum, the count of digits) are dropped.

The field.  Tokens that could carry such data (with a digit or an @, or equal to the local part of an email
of the document) are its nodes, labelled with a kind or as outside.  A node has log-linear features of its
shape and of the whole tokens beside it.  Chain edges join nodes that follow one another; skip edges join
each node to the next one that repeats it or resembles it (the same text, the same run of at least six
digits at the front or end, the same part before the @), and to the first observed one of those.  Tokens
inside base spans are observed.  Loopy message passing runs on every document with a node and carries
labels along the edges, so one entity keeps one label in the whole document.  A token outside all base
spans becomes part of a span if its marginal passes `certain`; the marginal alone decides.  Such tokens of
one kind that follow one another are one span.

Weights are trained here, on a bounded hash-chosen sample of documents that have a digit or an @, by
pseudo-likelihood with the potentials that inference uses.  Observed tokens are of their kind, tokens that
no skip edges tie to an observed one are outside; the tied rest and matches that run on beyond their count of
digits, but for numbers that no card has, are unlabelled, so the patterns' misses are not taught.  Each observed token also stands for its weak forms (without the plus, the domain or one
part), tied to it by a skip edge, so that forms which no pattern knows are seen as their kind.

Defined results
    null or empty text           no spans
    very long text               whole, in time and memory linear in it
    null doc_id                  kept; never trained on
    repeated rows                equal rows out, trained on once
    equal or overlapping kinds   a digit run may be both part of a card and of a phone; base spans all stay
    equal marginals              the kind that is listed first
    empty table, nothing to train on   the start weights: base spans, and repeats of them
    extra columns                ignored by `find`; passed through by `redact`, by place, so names may repeat
Memory in a worker grows with the longest text; the sample holds at most `most_nodes` nodes a document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import forest  # the least row that each row reaches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: Beyond so many digits two tokens are not one entity; emails and addresses are single tokens.
MOST_DIGITS = {"email": -1, "ip": -1, "card": 19, "phone": 15}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits: the run's own beginning matches as well and comes first.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s]+")
CARRIES = re.compile(r"[0-9@]")
TRIM = ".,;:!?\"'()[]{}<>|#$%&*"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(divmod(2 * int(d), 10)[0] + divmod(2 * int(d), 10)[1] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> list[Span]:
    """Each @ with the longest run of local characters before it, back to the last match."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        run = text[max(free, at - 64) : at]
        start = max(free, at - 64) + len(run.rstrip(LOCAL))
        if start == at - 64 and start > free:  # a longer run
            run = text[free:at]
            start = free + len(run.rstrip(LOCAL))
        if start < at and (m := EMAIL_DOMAIN.match(text, at)):
            free = m.end()
            out.append(("email", start, free))
        else:
            free = at + 1  # no local part reaches over an @
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    out = emails(text)
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# -- the field -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    features: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels)
    skip: np.ndarray


def bucket(n: int) -> int:
    return bisect_right((0, 3, 6, 9, 12, 15, 19), n - 1) if n else 0


#: One-hot groups of a token's shape: digits, dots, hyphens, letters, @, a leading plus, brackets, a card's count of digits without
#: and with the Luhn sum; and of its neighbours.
SHAPE = (8, 3, 2, 2, 2, 2, 2, 3)
N_FEATURES = 1 + sum(SHAPE) + 2 * 4
WIDE = 1 + len(SHAPE) + 2


def neighbour_class(token: str) -> int:
    if not token:
        return 0
    if DIGIT.search(token):
        return 1
    return 2 if token.isalpha() else 3


def card_class(token: str) -> int:
    """0 without a card's count of digits, 1 with it but without the Luhn sum, 2 with both."""
    digits = NOT_DIGIT.sub("", token)
    return 1 + luhn(digits) if 13 <= len(digits) <= 19 else 0


def features(token: str, before: str, after: str) -> list[int]:
    values = (bucket(len(NOT_DIGIT.sub("", token))), min(2, token.count(".")), int("-" in token), int(any(map(str.isalpha, token))), int("@" in token), int(token[:1] == "+"), int("(" in token or ")" in token), card_class(token))
    out, base = [0], 1
    for v, n in zip(values, SHAPE, strict=True):
        out.append(base + v)
        base += n
    return [*out, base + neighbour_class(before), base + 4 + neighbour_class(after)]


@dataclass
class Graph:
    tokens: list[tuple[int, int]]  # trimmed extents
    features: np.ndarray  # (nodes, features a node)
    observed: np.ndarray  # label index, or -1
    chain: np.ndarray  # (edges, 2)
    skip: np.ndarray


def similar_keys(core: str) -> list[str]:
    """Tokens that share a key resemble one another."""
    low = core.casefold()
    keys = ["t" + low]
    digits = NOT_DIGIT.sub("", core)
    if len(digits) >= 6:
        keys += ["f" + digits[:6], "e" + digits[-6:]]
    if "@" in low:
        local = low.partition("@")[0]
        if len(local) >= 4:
            keys.append("t" + local)
    return keys


def graph(text: str, base: list[Span]) -> Graph:
    """Nodes in order of text; every list is linear in the text, as edges only join neighbours, next repeats and first observed ones."""
    parts = {p for k, s, e in base if k == "email" for p in [text[s:e].casefold().partition("@")[0]] if len(p) >= 4}
    extents: list[tuple[int, int]] = []
    rows: list[list[int]] = []
    if parts or CARRIES.search(text):
        before, open_row = "", None  # the trimmed token before, and the node that waits for the one after it
        for m in TOKEN.finditer(text):
            whole = m[0]
            core = whole.strip(TRIM)
            if open_row is not None:
                rows.append(features(*open_row, core))
                open_row = None
            if core and (CARRIES.search(core) or core.casefold() in parts):
                start = m.start() + whole.index(core)
                extents.append((start, start + len(core)))
                open_row = (core, before)
            before = core
        if open_row is not None:
            rows.append(features(*open_row, ""))
    observed = np.full(len(extents), -1)
    starts = [s for s, _ in extents]
    for kind, s, e in base:
        k = max(0, bisect_right(starts, s) - 1)
        while k < len(extents) and extents[k][0] < e:
            if extents[k][1] > s and observed[k] < 0:
                observed[k] = LABELS.index(kind)
            k += 1
    last: dict[str, int] = {}
    anchor: dict[str, int] = {}  # the first observed node of each key: distant repeats lean on it directly
    keys = [similar_keys(text[s:e]) for s, e in extents]
    for k in np.flatnonzero(observed >= 0).tolist():
        for key in keys[k]:
            anchor.setdefault(key, k)
    skip = set()
    for k, own in enumerate(keys):
        for key in own:
            skip.update((min(k, o), max(k, o)) for o in (last.get(key, k), anchor.get(key, k)) if o != k)
            last[key] = k
    near = [(k, k + 1) for k in range(len(extents) - 1) if extents[k + 1][0] - extents[k][1] <= 3]
    return Graph(extents, np.array(rows, np.int64).reshape(-1, WIDE), observed, as_edges(near), as_edges(skip))


def as_edges(pairs) -> np.ndarray:
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(g: Graph, w: Weights, rounds: int = 50) -> np.ndarray:
    """Loopy belief propagation in the log domain, with damped parallel updates; exact where edges close no loop."""
    unary = w.features[g.features].sum(axis=1)
    seen = np.flatnonzero(g.observed >= 0)
    unary[seen] = -40.0
    unary[seen, g.observed[seen]] = 0.0
    source = np.concatenate([g.chain[:, 0], g.skip[:, 0], g.chain[:, 1], g.skip[:, 1]])
    target = np.concatenate([g.chain[:, 1], g.skip[:, 1], g.chain[:, 0], g.skip[:, 0]])
    n = len(source) // 2
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    forward = np.concatenate([np.broadcast_to(w.chain, (len(g.chain), *w.chain.shape)), np.broadcast_to(w.skip, (len(g.skip), *w.skip.shape))])
    potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
    message = np.zeros((2 * n, len(LABELS)))
    belief = unary.copy()
    for _ in range(rounds if n else 0):
        given = belief[source] - message[back]
        new = log_sum(given[:, :, None] + potential, 1)
        new -= log_sum(new, 1)[:, None]
        step = 0.5 * message + 0.5 * new
        still = np.abs(step - message).max() < 1e-4
        message = step
        belief = unary.copy()
        np.add.at(belief, target, message)
        if still:
            break
    belief -= log_sum(belief, 1)[:, None]
    return np.exp(belief)


def more_spans(text: str, base: list[Span], w: Weights, certain: float = 0.9) -> list[Span]:
    """Spans that the field adds to the base ones: tokens of a sure kind, joined where a chain edge joins two of one kind."""
    g = graph(text, base)
    if not len(g.tokens) or (g.observed >= 0).all():
        return []
    p = marginals(g, w)
    pick = p.argmax(axis=1)
    good = np.flatnonzero((g.observed < 0) & (pick > 0) & (p.max(axis=1) >= certain)).tolist()
    chained, out, held = {int(b) for _, b in g.chain}, [], -2
    for k in good:
        kind, (start, stop) = LABELS[pick[k]], g.tokens[k]
        if held == k - 1 and k in chained and out[-1][0] == kind and len(NOT_DIGIT.sub("", text[out[-1][1] : stop])) <= MOST_DIGITS[kind]:
            out[-1] = (kind, out[-1][1], stop)
        else:
            out.append((kind, start, stop))
        held = k
    return out


def all_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the added ones in the same order."""
    base = base_spans(text)
    more = more_spans(text, base, w)
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


# -- training --------------------------------------------------------------------------------------


def start_weights() -> Weights:
    """Before training: outside is likelier, equal neighbours in skip edges are much likelier."""
    f = np.zeros((N_FEATURES, len(LABELS)))
    f[0, 0] = 1.0
    return Weights(f, np.zeros((len(LABELS),) * 2), np.eye(len(LABELS)) * 4.0)


def run_on(text: str) -> list[tuple[int, int]]:
    """Matches with more digits than any card or phone has: something else runs on behind an entity, which may be whole."""
    found = [(CARD, 19), (PHONE, 15)] if DIGIT.search(text) else []
    return [(m.start(), m.end()) for p, most in found for m in p.finditer(text) if m.end() - m.start() > most and len(NOT_DIGIT.sub("", m[0])) > most]


#: Features, labels (-1: none), chain, skip, and ties from observed tokens to their weak forms, which only the forms see.
Example = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def weak_forms(token: str) -> list[str]:
    """What is left of an entity's token where somebody repeats it short."""
    out = [token[1:]] if token[:1] == "+" else []
    if "@" in token:
        out.append(token.partition("@")[0])
    elif len(DIGIT.findall(token)) >= 7:
        out += [x for x in (token[: -len(token) // 4], token[len(token) // 4 :]) if x]
    return [x for x in out if x]


def example(text: str, most_nodes: int) -> Example | None:
    """The labelled graph of one document, its weak forms appended; of a longer list of nodes the first `most_nodes`."""
    g = graph(text, base_spans(text))
    n = min(len(g.tokens), most_nodes)
    if not n:
        return None
    chain, skip = (e[(e < n).all(axis=1)] for e in (g.chain, g.skip))
    seen = g.observed[:n]
    group = forest(n, [(skip[:, 0], skip[:, 1])])
    label = np.where(seen >= 0, seen, np.where(np.isin(group, group[seen >= 0]), -1, 0))
    for start, stop in run_on(text):
        label[[k for k, (s, e) in enumerate(g.tokens[:n]) if s < stop and e > start and seen[k] < 0 and card_class(text[s:e]) != 1]] = -1
    rows, labels, ties = [g.features[:n]], [label], []
    at = n
    for k in np.flatnonzero(seen >= 0).tolist():
        for form in weak_forms(text[g.tokens[k][0] : g.tokens[k][1]]):
            rows.append(np.array([features(form, "x", "x")]))
            labels.append(seen[k : k + 1])
            ties.append((k, at))
            at += 1
    return np.concatenate(rows), np.concatenate(labels), chain, skip, as_edges(ties)


def joined(examples: list[Example]) -> tuple[np.ndarray, ...]:
    """One-hot features, labels and edges of all examples side by side."""
    shift = np.cumsum([0, *(len(e[1]) for e in examples)])
    x, y = np.concatenate([e[0] for e in examples]), np.concatenate([e[1] for e in examples])
    hot = np.zeros((len(y), N_FEATURES))
    np.put_along_axis(hot, x, 1.0, axis=1)
    return hot, y, *(np.concatenate([e[k] + s for e, s in zip(examples, shift, strict=False)]).reshape(-1, 2) for k in (2, 3, 4))


def around(edges: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
    """How many labelled neighbours of each label a node has on the other side of its edges; each counts, as in inference."""
    out = np.zeros((len(y), len(LABELS)))
    of = edges[y[edges[:, 1 - side]] >= 0]
    np.add.at(out, (of[:, side], y[of[:, 1 - side]]), 1.0)
    return out


def objective(w: Weights, data: tuple[np.ndarray, ...], decay: float) -> tuple[float, Weights]:
    """Mean log pseudo-likelihood of the labelled nodes less the decay towards the start, and its gradient."""
    hot, y, chain, skip, ties = data
    told = np.flatnonzero(y >= 0)
    left, right = around(chain, y, 1)[told], around(chain, y, 0)[told]
    both = (around(skip, y, 0) + around(skip, y, 1) + around(ties, y, 1))[told]
    hot, truth, w0 = hot[told], np.eye(len(LABELS))[y[told]], start_weights()
    z = hot @ w.features + left @ w.chain + right @ w.chain.T + both @ (w.skip + w.skip.T) / 2
    log_p = z - log_sum(z, 1)[:, None]
    error, n = truth - np.exp(log_p), max(1, len(told))
    parts = [(w.features, 0.0), (w.chain, 0.0), (w.skip, w0.skip)]
    value = float((truth * log_p).sum() / n - decay / 2 * sum(((a - b) ** 2).sum() for a, b in parts))
    tied = both.T @ error / n
    slope = hot.T @ error / n, (left.T @ error + error.T @ right) / n, (tied + tied.T) / 2
    return value, Weights(*(d - decay * (a - b) for d, (a, b) in zip(slope, parts, strict=True)))


def train(examples: list[Example], rounds: int = 500, rate: float = 0.1, decay: float = 1e-4) -> Weights:
    """Ascent of the objective with steps scaled by the slopes' running squares (Adam)."""
    w = start_weights()
    if not examples:
        return w
    data = joined(examples)
    state = [np.zeros_like(a) for a in (w.features, w.chain, w.skip)]
    square = [np.zeros_like(a) for a in state]
    for t in range(1, rounds + 1):
        slope = objective(w, data, decay)[1]
        made = []
        for k, (a, d) in enumerate(zip((w.features, w.chain, w.skip), (slope.features, slope.chain, slope.skip), strict=True)):
            state[k] = 0.9 * state[k] + 0.1 * d
            square[k] = 0.99 * square[k] + 0.01 * d * d
            made.append(a + rate * (state[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8))
        w = Weights(*made)
    return w


def fit(df: DataFrame, sample: int = 1500, most_nodes: int = 2000) -> Weights:
    """Weights from the `sample` documents of least hash that have a digit or an @; only their graphs reach the driver."""
    docs = common.id_and_text(df).where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("doc_id", "text"))
    keys = docs.select("h", "doc_id").orderBy("h", "doc_id").limit(sample).distinct()
    chosen = docs.join(F.broadcast(keys), ["h", "doc_id"]).dropDuplicates(["h", "doc_id"]).select("h", "doc_id", "text")

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("h", "x", "y", "chain", "skip", "ties")}
            for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                made = example(t, most_nodes)
                if made is not None:
                    for name, v in zip(out, (h, *(part.ravel().tolist() for part in made)), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), *(pa.array(out[n], pa.list_(pa.int32())) for n in ("x", "y", "chain", "skip", "ties"))], names=list(out))

    rows = chosen.mapInArrow(common.lean(run), "h long, x array<int>, y array<int>, chain array<int>, skip array<int>, ties array<int>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["h"], r["x"]))
    of = lambda r, n, wide: np.array(r[n], np.int64).reshape(-1, wide)
    return train([(of(r, "x", WIDE), np.array(r["y"], np.int64), *(of(r, n, 2) for n in ("chain", "skip", "ties"))) for r in rows])


# -- over tables -----------------------------------------------------------------------------------


def find(df: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, base and spans of every row; a span is (kind, start, stop) in code points, the stop exclusive."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches):
        for batch in batches:
            found = [all_spans(t, weights) if t else ([], []) for t in batch.column("text").to_pylist()]
            lists = [pa.array([[{"kind": k, "start": s, "stop": e} for k, s, e in f[n]] for f in found], pa.list_(kind)) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "base", "spans"])

    one = "array<struct<kind:string,start:int,stop:int>>"
    return common.id_and_text(df).mapInArrow(common.lean(run), f"doc_id long, base {one}, spans {one}")


def redacted(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans replaced by the kind of its first, in angle brackets."""
    out, free = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= free:
            out += [text[free:s], f"<{kind}>"]
        free = max(free, e)
    return "".join([*out, text[free:]])


def redact(df: DataFrame, weights: Weights) -> DataFrame:
    """df with spans replaced in `text`, and `n_chars` brought in line if there is such a column.  Columns keep their places."""
    names = df.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if names.count("n_chars") == 1 else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[text_at].to_pylist()
            made = [redacted(t, all_spans(t, weights)[1]) if t else t for t in texts]
            columns[text_at] = pa.array(made, columns[text_at].type)
            if chars_at is not None:
                n = columns[chars_at]
                columns[chars_at] = pa.array([old if a == b or a is None else len(b) for old, a, b in zip(n.to_pylist(), texts, made, strict=True)], n.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return common.map_by_place(df, run)
