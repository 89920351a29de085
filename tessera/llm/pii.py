"""Personal data by base rules and a skip-chain conditional random field.

Each text is read once. The base rules give spans that always stay. The nodes of the field are the tokens that have a
digit or an at sign, or are long mixtures of letters and digits; labels are none, email, ip, card, phone and secret. A
node's potential depends on its signature (a small class of its shape, and whether an assignment mark stands before it),
tokens side by side share a chain potential, and each token shares a skip potential with the last one before it that is
the same or similar: equal when lower-cased and stripped, or with the same last seven digits, where the tokens of a base
span count with the digits of the whole span, and short runs of digits side by side with those of the run.

The weights are fitted by pseudo-likelihood on counts of (signature, label, neighbours' labels) over all documents;
signatures and labels are few, so the collected table has a bound that does not depend on the corpus. Labels are the base
spans, and secrets that a cue word assigns; a token that only repeats such a one is left unlabelled, since the rules say
nothing of it. Every HIDE-th node, by a hash, is fitted from its skip neighbours alone, so that the skip weights are
learned where signatures would explain all. Loopy belief propagation then runs over all graphs of a batch at once, and
nodes outside base spans whose label has a marginal of `CERTAIN` or more become added spans. So a number that a rule
found is found again in a form that no rule takes, and a secret wherever it stands.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, texts
from .words import MIX_1, U, mix

KINDS = ["email", "ip", "card", "phone", "secret"]
#: Kinds that base rules find.
BASE = 4
SECRET = 5
LABELS = ["none", *KINDS]
CERTAIN = 0.9
PASSES = 30
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The rules' patterns; a look-behind only skips starts that cannot match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[0-9@]")
#: Words that assign a secret, a mark, and what may stand for one: long, of letters and digits.
_CUE = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)[\"']?\Z")
_MARK = re.compile(r"[=:]+\Z")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/.=-]{16,}")
_TRIM = ".,;:!?()\"'*#$%&|<>"
HIDE = 4
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' spans, in order."""
    out, stop = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > stop and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            stop = m.end()
            out.append((a, 0, stop))
        at = text.find("@", max(at + 1, stop))
    if re.search(r"[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def value(token: str) -> str:
    """A token without marks around it, and without a name that it assigns."""
    core = token.strip(_TRIM)
    return core.rpartition("=")[2].strip(_TRIM) if "=" in core.rstrip("=") else core


def mixed(token: str) -> bool:
    """Whether a token looks like a random key: 16 characters or more, letters and digits that change places often."""
    core = value(token)
    if not _MIXED.fullmatch(core):
        return False
    kinds = [c.isdigit() for c in core if c.isalnum()]
    return sum(map(bool.__ne__, kinds, kinds[1:])) >= 4


def signature(token: str, assigned: bool = False) -> int:
    """A small number for the shape of a node: 10 sizes of its digits by 10 make-ups, apart where an assignment mark stands before it."""
    n = len(_digits(token))
    size = next((i for i, most in enumerate((0, 2, 4, 6, 7, 9, 11, 15, 19)) if n <= most), 9)
    letters = any(c.isalpha() for c in token)
    if "@" in token:
        kind = 0
    elif letters:
        kind = 8 + ("=" in token.strip(_TRIM).rstrip("=")) if mixed(token) else 1
    elif token.count(".") >= 3:
        kind = 2
    elif token.startswith("+"):
        kind = 3
    elif "(" in token or ")" in token:
        kind = 4
    elif "-" in token:
        kind = 5
    else:
        kind = 6 if token.strip(".,;:!?").isdigit() else 7
    return (0 if kind > 7 else size) * 10 + kind + 100 * assigned


#: The last one stands for a hidden signature.
SIGNATURES = 201
HIDDEN = SIGNATURES - 1


def similar_key(token: str) -> str:
    d = _digits(token)
    if len(d) >= 7 and not any(c.isalpha() for c in token):
        return d[-7:]
    return (value(token) if mixed(token) else token.strip(_TRIM)).lower()


def nodes(text: str, spans) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, signature, label, whether the token before it is a node, node of its skip edge or -1).

    Labels are those of the base spans, SECRET where a cue assigns one, and -1 for tokens that only repeat such nodes.
    """
    if not _CANDIDATE.search(text):
        return []
    got, k, earlier = [], 0, ("", "")
    for i, m in enumerate(_TOKEN.finditer(text)):
        t = m.group()
        if not _CANDIDATE.search(t):
            earlier = (earlier[1], t)
            continue
        a, b = m.span()
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        label, j, key = 0, k, None
        while not label and j < len(spans) and spans[j][0] < b:
            label = spans[j][1] + 1 if spans[j][2] > a else 0
            if label in (3, 4):
                key = _digits(text[spans[j][0] : spans[j][2]])[-7:]
            j += 1
        mark = bool(_MARK.search(earlier[1]))
        if not label and mixed(t):
            name = t.strip(_TRIM).rpartition("=")[0]
            if _CUE.search(name.rstrip("=: ")) or _CUE.search((earlier[0] if earlier[1] in ("=", ":", ":=", "=>") else earlier[1]).rstrip("=:")):
                label = SECRET
            a += t.rindex(value(t))
            b = a + len(value(t))
        plain = not label and "@" not in t and not any(c.isalpha() for c in t)
        got.append([a, b, signature(t, mark), label, i, key, _digits(t) if plain else "", t])
        earlier = (earlier[1], t)
    x = 0
    while x < len(got):  # short runs of digits side by side have the key of the run
        y = x + 1
        if got[x][6]:
            while y < len(got) and got[y][6] and got[y][4] == got[y - 1][4] + 1:
                y += 1
            whole = "".join(g[6] for g in got[x:y])
            if y - x > 1 and 7 <= len(whole) <= 19 and all(len(g[6]) <= 7 for g in got[x:y]):
                for g in got[x:y]:
                    g[5] = whole[-7:]
        x = y
    for g in got:
        g[5] = similar_key(g[7]) if g[5] is None else g[5]
    taken = {g[5] for g in got if g[3]}
    out, last, seen = [], -2, {}
    for a, b, sig, label, i, key, _, _ in got:
        out.append((a, b, sig, -1 if not label and key in taken else label, int(last == i - 1), seen.get(key, -1)))
        seen[key] = len(out) - 1
        last = i
    return out


def _graph(rows: pd.DataFrame):
    """Nodes of all documents in one row, chain edges and skip edges as pairs of positions."""
    sizes = rows["sig"].map(len).to_numpy()
    first = np.cumsum(sizes) - sizes
    join = lambda c: np.concatenate([np.asarray(x, np.int64) for x in rows[c]]) if len(rows) else np.zeros(0, np.int64)
    sig, label, after, skip = join("sig"), join("label"), join("after"), join("skip")
    base = np.repeat(first, sizes)
    chain = np.flatnonzero(after == 1)
    jump = np.flatnonzero(skip >= 0)
    return sig, label, np.stack((chain - 1, chain)), np.stack((base[jump] + skip[jump], jump)), np.repeat(np.arange(len(rows)), sizes)


N = len(LABELS)


class Field:
    """Node weights (signatures x labels), chain weights (labels x labels) and one skip weight per label."""

    def __init__(self, counts: pd.DataFrame, rounds: int = 300, ridge: float = 0.5, skip_ridge: float = 0.05):
        """counts: sig, label, left, right, back, on (neighbours' labels, or -1), n.

        The skip weight of a label is one that all labels share and its own part, so that what repeats of one kind teach
        counts for the kinds whose repeats are rare.
        """
        self.node, self.chain, self.skip = np.zeros((SIGNATURES, N)), np.zeros((N, N)), np.zeros(N)
        shared, part = np.zeros(1), np.zeros(N)
        self.node[:, 0] = 2.0  # unknown shapes are nothing, but long mixtures may be anything
        self.node[np.isin(np.arange(SIGNATURES) % 10, (8, 9)), 0] = 0.0
        if not len(counts):
            return
        sig, y, n = counts["sig"].to_numpy(), counts["label"].to_numpy(), counts["n"].to_numpy(float)
        near = [(counts[c].to_numpy(), c) for c in ("left", "right", "back", "on")]
        prior, goal = self.node.copy(), np.eye(N)[y] * n[:, None]
        weight = np.minimum(n, 50 * np.sqrt(n))  # a frequent context counts less than its copies
        goal *= (weight / n)[:, None]
        second = [np.zeros_like(x) for x in (self.node, self.chain, part, shared)]
        for _ in range(rounds):
            z = self.node[sig].copy()
            for v, c in near:
                on = v >= 0
                if c == "left":
                    z[on] += self.chain[v[on]]
                elif c == "right":
                    z[on] += self.chain[:, v[on]].T
                else:
                    z[on, v[on]] += self.skip[v[on]]
            p = np.exp(z - z.max(1, keepdims=True))
            gap = goal - p / p.sum(1, keepdims=True) * weight[:, None]
            g = [np.zeros_like(x) for x in (self.node, self.chain, self.skip)]
            np.add.at(g[0], sig, gap)
            for v, c in near:
                on = v >= 0
                if c == "left":
                    np.add.at(g[1], v[on], gap[on])
                elif c == "right":
                    np.add.at(g[1].T, v[on], gap[on])
                else:
                    np.add.at(g[2], v[on], gap[on, v[on]])
            g[0] -= ridge * (self.node - prior)
            g[1] -= ridge * self.chain
            g.append(g[2].sum(keepdims=True) - skip_ridge * shared)
            g[2] -= ridge * part
            for w, d, s in zip((self.node, self.chain, part, shared), g, second):
                s += d * d
                w += 0.5 * d / np.sqrt(s + 1e-9)
            self.skip = shared + part

    def marginals(self, sig, chain, skip, clamp) -> np.ndarray:
        """Label marginals of each node by loopy belief propagation; clamp: labels known from the base rules, or 0."""
        unary = self.node[sig].copy()
        unary[clamp > 0] = -30.0
        unary[np.flatnonzero(clamp > 0), clamp[clamp > 0]] = 0.0
        a = np.concatenate((chain[0], skip[0], chain[1], skip[1]))
        b = np.concatenate((chain[1], skip[1], chain[0], skip[0]))
        c, s, half = chain.shape[1], skip.shape[1], chain.shape[1] + skip.shape[1]
        pair = np.empty((2 * half, N, N))
        pair[:c], pair[half : half + c] = self.chain, self.chain.T
        pair[c:half] = pair[half + c :] = np.diag(self.skip)
        back = np.concatenate((np.arange(half, 2 * half), np.arange(half)))
        message = np.zeros((2 * half, N))
        for _ in range(PASSES if half else 0):
            total = unary.copy()
            np.add.at(total, b, message)
            z = (total[a] - message[back])[:, :, None] + pair
            top = z.max(1, keepdims=True)
            new = np.log(np.exp(z - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if change < 1e-4:
                break
        total = unary
        np.add.at(total, b, message)
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def read(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and the nodes of each row; null text as empty."""

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist()):
                spans = base_spans(text)
                got = list(zip(*nodes(text, spans))) or [()] * 6
                out.append((doc_id, [k for _, k, _ in spans], [a for a, _, _ in spans], [e for _, _, e in spans], *map(list, got)))
            yield pd.DataFrame(out, columns=["doc_id", "kind", "a", "b", "start", "stop", "sig", "label", "after", "skip"])

    columns = "doc_id long, kind array<int>, a array<int>, b array<int>, start array<int>, stop array<int>, sig array<int>, label array<int>, after array<int>, skip array<int>"
    return texts(docs).mapInPandas(run, columns)


def fit(rows: DataFrame) -> Field:
    keys = ["sig", "label", "left", "right", "back", "on"]

    def run(batches):
        for b in batches:
            sig, y, chain, skip, _ = _graph(b)
            side = np.full((4, len(sig)), -1)
            side[0, chain[1]], side[1, chain[0]] = y[chain[0]], y[chain[1]]
            side[2, skip[1]], side[3, skip[0]] = y[skip[0]], y[skip[1]]
            start = np.concatenate([np.asarray(x, np.int64) for x in b["start"]]) if len(b) else sig
            hide = mix(start.view(U) * MIX_1 + sig.view(U)) % U(HIDE) == 0
            sig = np.where(hide, HIDDEN, sig)
            side[:2, hide] = -1
            got = pd.DataFrame({"sig": sig, "label": y, **dict(zip(keys[2:], side))})[y >= 0]
            yield got.groupby(keys).size().reset_index(name="n").astype(int)

    counts = rows.where(F.size("sig") > 0).mapInPandas(run, ", ".join(f"`{k}` int" for k in keys) + ", n long").groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.sum("n").alias("n"))
    return Field(counts.toPandas().sort_values(keys).reset_index(drop=True))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base spans, base_sha256, spans, n_added, n_spans (base and added).

    Null and empty texts have no spans; an empty table gives no rows. Equal texts, repeated rows and rows that share an id
    each get the spans of their own text; texts of any length are read whole. A marginal of exactly CERTAIN adds a span,
    and of labels that tie the first in KINDS counts.
    """
    rows = cut(read(docs))
    held = rows.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches):
        for b in batches:
            sig, y, chain, skip, row = _graph(b)
            added: dict[int, list] = {}
            if len(sig):
                based = (y > 0) & (y <= BASE)
                p = held.value.marginals(sig, chain, skip, np.where(based, y, 0))
                best = p.argmax(1)
                new = ~based & (best > 0) & (p.max(1) >= CERTAIN)
                start, stop = (np.concatenate([np.asarray(x, np.int64) for x in b[c]]) for c in ("start", "stop"))
                after = np.zeros(len(sig), bool)
                after[chain[1]] = True
                for i in np.flatnonzero(new):
                    own = added.setdefault(int(row[i]), [])
                    if after[i] and new[i - 1] and best[i - 1] == best[i] and own:
                        own[-1][2] = int(stop[i])
                    else:
                        own.append([int(start[i]), int(best[i]) - 1, int(stop[i])])
            out = []
            for i, (doc_id, kind, a, e) in enumerate(zip(b["doc_id"].tolist(), b["kind"], b["a"], b["b"])):
                spans = list(zip(map(int, a), map(int, kind), map(int, e)))
                more = added.get(i, [])
                n = [sum(k == j for k in kind) for j in range(BASE)]
                out.append((doc_id, *n, hashlib.sha256(named(spans).encode()).hexdigest(), named(sorted([*spans, *map(tuple, more)])), len(more), len(spans) + len(more)))
            yield pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return rows.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
