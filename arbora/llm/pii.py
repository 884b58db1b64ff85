"""Personal data: base patterns, and a skip-chain conditional random field that carries their labels through a document.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers by fixed patterns, leftmost and non-overlapping for each
kind. The field's nodes are the tokens with a digit or an @, and words that equal the local part of a base address (any other token
is outside by definition). Neighbouring nodes share transition potentials. Skip potentials are shared by distant tokens that repeat
a form, by addresses and words with the same local part, and by runs of digits, whatever marks and blanks stand between them, with
the card or phone number that they repeat wholly or in part. The tokens of such a run are one node.

Weights begin at statistics over all documents: a token's features against the base spans' labels, neighbours' labels, repeated
tokens' labels. They are then fitted through the messages on a bounded sample of documents with repetitions: the gradient of the
likelihood of the known labels is what messages expect with these labels given less what they expect without. Sum-product messages
are passed around the loops, and a token that comes out with an entity's label although no base span covers it, and that repeats a
token which one does cover, is added to the spans. Base spans stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, unit

KINDS = ["email", "ip", "card", "phone"]
OUTSIDE = len(KINDS)
LABELS = OUTSIDE + 1
PASSES, DAMPING, SURE = 10, 0.5, 0.6
#: Added to the potential of a base span's label, more than all messages to a node can sum to.
GIVEN = 1e9
#: Repetitions that agree, for each label, which the skip potentials start from: many corpora hold few.
PRIOR = 20
#: Documents with repetitions that the weights are fitted on at most, about, nodes that such a document may have, and steps of the fit.
FIT_ROWS, FIT_NODES, STEPS = 400, 200, 15
#: Characters that a repeated form must have, and digits that a run must; local parts next to an @ may be shorter.
FORM = 5

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_HINT = re.compile(r"[0-9@]")
_ADDRESSED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?=@)")
_TOKEN = re.compile(r"\S++")
_DIGITS = re.compile(r"[0-9]++")
_BETWEEN = re.compile(r"(?:[^\w@]|_)++")
_EDGE = ".,;:!?()[]<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and then start; matches that fail their test are dropped and not tried again."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _HINT.search(text) is None:
        return out
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


#: Features of a token, a bit each.
FEATURES = ["@", "@ then dot", "+ first", "bracket", "hyphen", "four bytes", "digits only", "letters", "1-3 digits", "4-6 digits", "7-12 digits", "13-19 digits", "20 digits", "Luhn", "after +", "quote or ="]


def features(token: str, after_plus: bool) -> int:
    digits = "".join(c for c in token if c in "0123456789")
    n = len(digits)
    core = token.strip(".,;:!?()[]\"'")
    parts = core.split(".")
    tests = (
        "@" in token,
        "@" in token and "." in token.split("@", 1)[1],
        token[0] == "+",
        "(" in token or ")" in token,
        "-" in token,
        len(parts) == 4 and all(p.isdigit() and p.isascii() and _byte(p) for p in parts),
        all(c in "0123456789 ().+-" for c in token),
        any(c.isalpha() for c in token),
        1 <= n <= 3,
        4 <= n <= 6,
        7 <= n <= 12,
        13 <= n <= 19,
        n >= 20,
        13 <= n <= 19 and luhn(digits),
        after_plus,
        "=" in token or '"' in token,
    )
    return sum(1 << i for i, x in enumerate(tests) if x)


def _bare(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens without a digit or an @ that equal the local part of a base address."""
    known = {text[a:b].split("@", 1)[0].lower() for kind, a, b in base if KINDS[kind] == "email"}
    known = {x for x in known if len(x) >= FORM and not _HINT.search(x)}
    if not known:
        return []
    return [m.span() for m in _TOKEN.finditer(text) if m[0].strip(_EDGE).lower() in known]


def _digit_keys(text: str, base: list[tuple[int, int, int]]) -> dict[str, tuple[int, bool]]:
    """Digit strings that repeat a base card or phone number, wholly or by some of its groups: where the last of those digits stands, and whether it ends the number."""
    keys: dict[str, tuple[int, bool]] = {}
    for kind, a, b in base:
        if KINDS[kind] not in ("card", "phone"):
            continue
        groups = [m.span() for m in _DIGITS.finditer(text, a, b)]
        digits = "".join(text[x:y] for x, y in groups)
        ends = np.cumsum([0] + [y - x for x, y in groups]).tolist()
        for i, x in enumerate(ends):
            for (_, at), y in zip(groups[i:], ends[i + 1 :], strict=True):
                if y - x >= FORM and not keys.get(digits[x:y], (0, False))[1]:
                    keys[digits[x:y]] = at - 1, y == len(digits)
        if KINDS[kind] == "phone":  # from abroad, without the country's code, or with a 0 for it
            for other in ["00" + digits, *(zero + digits[k:] for k in (1, 2, 3) for zero in ("", "0"))]:
                if not keys.get(other, (0, False))[1]:
                    keys[other] = b - 1, True
    return keys


def _runs(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Runs of digit groups, leftmost and longest, that repeat a base number: start, end, and where the number's last digit stands.

    No run enters or leaves a base span; one that breaks off before the number's end isn't followed by another group.
    """
    keys = _digit_keys(text, base)
    if not keys:
        return
    longest = max(map(len, keys))
    bounds = sorted({x for _, a, b in base for x in (a, b)})
    groups = [m.span() for m in _DIGITS.finditer(text)]

    def joined(j: int) -> bool:
        """Whether group j goes on what group j - 1 began."""
        before, a = groups[j - 1][1], groups[j][0]
        return bisect_left(bounds, before) == bisect_right(bounds, a) and _BETWEEN.fullmatch(text, before, a) is not None

    i = 0
    while i < len(groups):
        digits, last, found = "", i, ""
        for j in range(i, len(groups)):
            a, b = groups[j]
            if len(digits) + b - a > longest or j > i and not joined(j):
                break
            digits += text[a:b]
            if digits in keys and (keys[digits][1] or j + 1 == len(groups) or not joined(j + 1)):
                last, found = j, digits
        if found:
            yield groups[i][0], groups[last][1], keys[found][0]
        i = last + 1


class Graph:
    """Nodes, features, labels by base spans, and edges of a document: 0 between neighbours, 1 from a form's first occurrence in a base span to all others, or else from each to the next, and from a number to the runs that repeat it.

    A run that repeats a number outside the base spans makes one node of its tokens; ``runs`` has the starts and ends of those in a node.
    """

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        tokens = sorted([m.span() for m in _NODE.finditer(text)] + _bare(text, base))
        labels = [OUTSIDE] * len(tokens)
        starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
        for kind, a, b in base:
            for i in range(bisect_right(ends, a), bisect_left(starts, b)):
                labels[i] = min(labels[i], kind)
        runs = [(a, b, bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1, bisect_right(starts, at) - 1) for a, b, at in _runs(text, base)]
        joins = {k for a, b, i, j, _ in runs if min(labels[i : j + 1]) == OUTSIDE for k in range(i + 1, j + 1)}
        place = (np.cumsum([i not in joins for i in range(len(tokens))], dtype=int) - 1).tolist()
        self.spans: list[tuple[int, int]] = []
        self.labels: list[int] = []
        for i, (a, b) in enumerate(tokens):
            if i in joins:
                self.spans[-1] = self.spans[-1][0], b
            else:
                self.spans.append((a, b))
                self.labels.append(labels[i])
        self.bits: list[int] = []
        self.edges: list[tuple[int, int, int]] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        linked: set[tuple[int, int]] = set()
        for a, b, i, j, at in runs:
            i, j, at = place[i], place[j], place[at]
            if j != at:
                linked.add((min(j, at), max(j, at)))
            if i == j and self.labels[i] == OUTSIDE:
                if text[a - 1 : a] == "(" and text.count(")", a, b) > text.count("(", a, b):
                    a -= 1
                self.runs[i].append((a - (text[a - 1 : a] == "+"), b))
        forms: dict[str, list[int]] = defaultdict(list)
        after = False
        for i, (a, b) in enumerate(self.spans):
            token = " ".join(text[a:b].split())
            near = i > 0 and a - self.spans[i - 1][1] == 1
            after = near and (token.startswith("(") and after or text[self.spans[i - 1][0]] == "+" or after and self.bits[i - 1] >> 3 & 1 == 1)
            self.bits.append(features(token, after))
            if near:
                self.edges.append((i - 1, i, 0))
            form = token.strip(_EDGE).lower()
            found = {f for f in (form, form.split("@", 1)[0]) if len(f) >= FORM}
            if "@" in form:
                found |= set(_ADDRESSED.findall(form))
            for f in found:
                forms[f].append(i)
        for nodes in forms.values():
            hub = next((i for i in nodes if self.labels[i] < OUTSIDE), None)
            if hub is None:
                linked |= set(zip(nodes, nodes[1:], strict=False))
            else:  # evidence reaches each repetition at once and alike, however many there are
                linked |= {(min(i, hub), max(i, hub)) for i in nodes if i != hub}
        self.edges += [(i, j, 1) for i, j in sorted(linked)]

    def hidden(self) -> set[int]:
        """Nodes outside the base spans that repeat one inside: the patterns don't say what they are, so training leaves them out."""
        return {x for i, j, kind in self.edges if kind for x, other in ((i, j), (j, i)) if self.labels[x] == OUTSIDE and self.labels[other] < OUTSIDE}


    def fits(self) -> bool:
        """Whether the weights can learn repetitions from this document."""
        return len(self.bits) <= FIT_NODES and min(self.labels, default=OUTSIDE) < OUTSIDE and any(kind for *_, kind in self.edges)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (0, features, label), of (1, label, next label), of (2, label, repetition's label), and of (3, 0, 0), documents to fit on."""
    for batch in batches:
        counts: dict[tuple[int, int, int], int] = defaultdict(int)
        for part in pieces(batch, 0):
            for text in part.column(0).to_pylist():
                if text and _HINT.search(text):
                    g = Graph(text, base_spans(text))
                    hidden = g.hidden()
                    counts[3, 0, 0] += g.fits()
                    for i, (bits, label) in enumerate(zip(g.bits, g.labels, strict=True)):
                        counts[0, bits, label] += i not in hidden
                    for i, j, kind in g.edges:
                        counts[1 + kind, g.labels[i], g.labels[j]] += not hidden & {i, j}
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["what", "a", "b", "n"])


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features, known labels (-1: unknown) and edges of the documents to fit on."""
    for batch in batches:
        for part in pieces(batch, 0):
            rows: list[tuple[list[int], list[int], list[int]]] = []
            for text in part.column(0).to_pylist():
                if text and _HINT.search(text) and (g := Graph(text, base_spans(text))).fits():
                    hidden = g.hidden()
                    rows.append((g.bits, [-1 if i in hidden else x for i, x in enumerate(g.labels)], [x for e in g.edges for x in e]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["bits", "labels", "edges"])


def _design(bits: np.ndarray) -> np.ndarray:
    return np.concatenate(((bits[:, None] >> np.arange(len(FEATURES))) & 1, np.ones((len(bits), 1))), axis=1).astype(float)


def _normal(logs: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=axes, keepdims=True))
    return p / p.sum(axis=axes, keepdims=True)


class Field:
    """Token weights and the two tables of edge potentials, all logarithms."""

    def __init__(self, weights: np.ndarray, tables: np.ndarray) -> None:
        self.weights, self.tables = weights, tables

    @classmethod
    def trained(cls, counts: list[tuple[int, int, int, int]], steps: int = 600, rate: float = 0.5) -> Field:
        """Multinomial logistic regression on the feature counts; edges from how much more often labels meet than by chance."""
        seen = sorted({a for what, a, _, _ in counts if what == 0})
        place = {a: i for i, a in enumerate(seen)}
        n = np.zeros((len(seen), LABELS))
        pairs = np.full((2, LABELS, LABELS), 0.5)
        pairs[1] += PRIOR * np.eye(LABELS)
        for what, a, b, c in counts:
            if what == 0:
                n[place[a], b] += c
            elif what < 3:
                pairs[what - 1, a, b] += c
        x = _design(np.array(seen, np.int64)) if seen else np.zeros((0, len(FEATURES) + 1))
        w = np.zeros((len(FEATURES) + 1, LABELS))
        # every pattern of features counts by the logarithm of how often it occurs, so that rare ones are learnt too
        each = n.sum(axis=1, keepdims=True)
        target = n / np.maximum(each, 1) * np.log1p(each)
        total = max(1.0, target.sum())
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
            p = p / p.sum(axis=1, keepdims=True) if len(z) else p
            w -= rate * (x.T @ (p * target.sum(axis=1, keepdims=True) - target) / total + 1e-4 * w)
        both = pairs + pairs.transpose(0, 2, 1)
        both[0] = pairs[0]
        chance = both.sum(axis=2, keepdims=True) * both.sum(axis=1, keepdims=True) / both.sum(axis=(1, 2), keepdims=True)
        return cls(w, np.clip(np.log(both / chance), -3, 3))

    def _passed(self, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs, and messages along and then against each edge, after ``PASSES`` damped rounds."""
        i, j, kind = edges.T
        source, target = np.concatenate((i, j)), np.concatenate((j, i))
        tables = np.concatenate((self.tables[kind], self.tables[kind].transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(i)) + len(i), np.arange(len(i))))
        message = np.zeros((len(source), LABELS))
        belief = unary.copy()
        for _ in range(PASSES):
            inner = (belief[source] - message[back])[:, :, None] + tables
            top = inner.max(axis=1)
            new = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
            belief = unary.copy()
            np.add.at(belief, target, message)
        return belief, message

    def _unary(self, bits: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Token potentials, with the labels that are given (those from 0 on)."""
        unary = _design(bits) @ self.weights
        unary[np.arange(len(given)), np.maximum(given, 0)] += np.where(given >= 0, GIVEN, 0.0)
        return unary - unary.max(axis=1, keepdims=True)

    def expected(self, bits: np.ndarray, given: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each node's labels, and of the labels at both ends of each edge."""
        belief, message = self._passed(self._unary(bits, given), edges)
        i, j, kind = edges.T
        along, against = message[: len(edges)], message[len(edges) :]
        pair = self.tables[kind] + (belief[i] - against)[:, :, None] + (belief[j] - along)[:, None, :]
        return _normal(belief, (1,)), _normal(pair, (1, 2))

    def fitted(self, bits: np.ndarray, known: np.ndarray, edges: np.ndarray, steps: int = STEPS, rate: float = 0.5, decay: float = 0.05) -> Field:
        """Steps up the gradient of the likelihood of the known labels, drawn back to where they began."""
        field = self
        x = _design(bits)
        for _ in range(steps if len(edges) else 0):
            (seen, seen_pairs), (free, free_pairs) = field.expected(bits, known, edges), field.expected(bits, np.full_like(known, -1), edges)
            weights = field.weights + rate * (x.T @ (seen - free) / len(bits) - decay * (field.weights - self.weights))
            tables = field.tables.copy()
            for kind in (0, 1):
                of = edges[:, 2] == kind
                tables[kind] += rate * ((seen_pairs[of] - free_pairs[of]).sum(axis=0) / max(1, of.sum()) - decay * (field.tables[kind] - self.tables[kind]))
            field = Field(weights, np.clip(tables, -3, 3))
        return field

    def marginals(self, bits: np.ndarray, labels: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Probabilities of each node's labels; base labels are given, so no number of doubtful repetitions outweighs them."""
        unary = self._unary(bits, np.where(labels < OUTSIDE, labels, -1))
        return _normal(self._passed(unary, edges)[0] if len(edges) else unary, (1,))

    def added(self, texts: list[str], graphs: list[tuple[int, Graph]]) -> dict[int, list[tuple[int, int, int]]]:
        """Spans that the field adds to each text, all graphs passing messages at once."""
        graphs = [(t, g) for t, g in graphs if any(kind and (g.labels[i] < OUTSIDE) != (g.labels[j] < OUTSIDE) for i, j, kind in g.edges) or any(kind for *_, kind in g.edges) and min(g.labels) < OUTSIDE]
        if not graphs:
            return {}
        first = np.concatenate(([0], np.cumsum([len(g.bits) for _, g in graphs])))
        bits = np.concatenate([np.array(g.bits, np.int64) for _, g in graphs])
        labels = np.concatenate([np.array(g.labels, np.int64) for _, g in graphs])
        edges = np.concatenate([np.array([(i + f, j + f, k) for i, j, k in g.edges], np.int64).reshape(-1, 3) for f, (_, g) in zip(first, graphs, strict=False)])
        p = self.marginals(bits, labels, edges)
        best, sure = p.argmax(axis=1), p.max(axis=1) >= SURE
        out: dict[int, list[tuple[int, int, int]]] = {}
        for f, (t, g) in zip(first, graphs, strict=False):
            # a repetition counts if its chain of repetitions holds a base span of that kind
            chain = list(range(len(g.bits)))

            def root(x: int, chain: list[int] = chain) -> int:
                while chain[x] != x:
                    chain[x] = chain[chain[x]]
                    x = chain[x]
                return x

            for i, j, kind in g.edges:
                if kind:
                    chain[root(j)] = root(i)
            held = {(root(i), g.labels[i]) for i in range(len(g.bits)) if g.labels[i] < OUTSIDE}
            found = []
            for i, (a, b) in enumerate(g.spans):
                label = int(best[f + i])
                if g.labels[i] == OUTSIDE and label < OUTSIDE and sure[f + i] and (root(i), label) in held:
                    if i in g.runs:
                        found += [(label, *run) for run in g.runs[i]]
                        continue
                    token = texts[t][a:b]
                    core = token.strip(_EDGE)
                    lead = token.find(core)
                    found.append((label, a + lead, a + lead + len(core)))
            if found:
                out[t] = found
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def trained(texts: DataFrame) -> Field:
    """A field for a table of ``text``: statistics of all rows, then a fit on about ``FIT_ROWS`` of those with repetitions, picked by a hash."""
    counted = texts.mapInArrow(_counted, "what long, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    # at most 2**16 patterns of features by 5 labels, 2 tables of 25, and a number
    counts = sorted(tuple(r) for r in counted.collect())
    field = Field.trained([c for c in counts if c[0] < 3])
    fit = sum(c[3] for c in counts if c[0] == 3)
    if not fit:
        return field
    picked = texts.filter(unit(F.lit(31), "text") < FIT_ROWS / fit).mapInArrow(_graphs, "bits array<long>, labels array<long>, edges array<long>")
    rows = sorted(tuple(map(tuple, r)) for r in picked.collect())
    first = np.cumsum([0] + [len(bits) for bits, *_ in rows])
    join = lambda parts: np.array([x for part in parts for x in part], np.int64)
    edges = join(e for *_, e in rows).reshape(-1, 3)
    edges[:, :2] += np.repeat(first[:-1], [len(e) // 3 for *_, e in rows])[:, None]
    return field.fitted(join(b for b, *_ in rows), join(x for _, x, _ in rows), edges)


def pii_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of each row; the counts are of base spans.

    ``spans`` lists base and added spans as kind:start:end in code points. Null and empty texts have none. Texts are read for the
    counts that train the field, for the sample it is fitted on, and for the spans, and never shuffled; equal texts get equal spans
    in any batch. Other columns are dropped; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    field = trained(rows.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                texts = [x or "" for x in part.column(1).to_pylist()]
                base = [base_spans(x) for x in texts]
                more = {}
                for i, (x, b) in enumerate(zip(texts, base, strict=True)):
                    if b:  # without a base span no label can be carried on
                        more |= field.added(texts, [(i, Graph(x, b))])
                out = []
                for i, b in enumerate(base):
                    n = [0] * len(KINDS)
                    for k, *_ in b:
                        n[k] += 1
                    extra = more.get(i, [])
                    out.append((*n, hashlib.sha256(joined(b).encode()).hexdigest(), joined(b + extra), len(extra)))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[x.split()[0] for x in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)
