"""Personal data by rules and a skip-chain conditional random field.

Base spans come from four exact patterns. The field's variables are whole mentions: the base spans, whose labels are
observed, and every other piece of text that looser patterns take for a number of several groups or for a written-out
address (``4111.1111.1111.1111``, ``555-123-4567``, ``bob(at)example.com``). A mention's shape has a factor, neighbours
in the text have one (chain), and so have distant mentions (skip) of the same key, which is its digits or its letters
without the writing, or of a similar key: one the end of the other, or one edit away. Loopy sum-product passes beliefs
along all edges, and a mention takes the label that more than half of its belief is on; these are the added spans.

The factors are tables trained piecewise, by counting, on about ``sample`` documents and on a few made-up ones, so that
small tables train too. A base span there also teaches by copies of it in other writings, which have its label, and by
more other data in the same writings, which has none; so shape alone decides nothing, and links do.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}
_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does: a later start would have met the same fate.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A number of groups in any writing, and an address with its signs spelt out. Runs are possessive: time stays linear.
_NUMBER = re.compile(r"(?<![A-Za-z0-9.])\+?\(?[0-9]++(?:(?:\x20?[\[(](?:\.|dot)[\])]\x20?|[\x20()./_-]{1,3})[0-9]++)*+(?![A-Za-z0-9])")
_ADDRESS = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|[\[({]at[\])}])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?(?:\.|[\[({](?:\.|dot)[\])}])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"
)
_AT = re.compile(r"\x20?[\[({]at[\])}]\x20?|\x20at\x20|\x20?@\x20?")
_DOT = re.compile(r"\x20?[\[({](?:\.|dot)[\])}]\x20?|\x20dot\x20|\x20?\.\x20?")
_GROUPS = re.compile(r"[0-9]+")

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points, by start, then kind; leftmost non-overlapping per kind, failing matches dropped."""
    out: list[Span] = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), "email"))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mention(core: str) -> tuple[str, int] | None:
    """(key, shape) of a piece of text, None if it can't be personal data of any kind."""
    if _AT.search(core):
        at = _AT.sub("@", core, 1)
        key = _DOT.sub(".", at).lower()
        return key, SHAPES - 1 - (key != core.lower())
    groups = _GROUPS.findall(core)
    digits = "".join(groups)
    address = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if not address and not 7 <= len(digits) <= 19:
        return None
    size = sum(len(digits) >= n for n in (7, 10, 14))
    shape = (((size * 2 + address) * 2 + (len(digits) >= 14 and _luhn(digits))) * 2 + ("+" in core)) * 2 + ("(" in core) if not _DOT.search(core.replace(".", "")) else 64
    return ".".join(groups) if address else digits, shape


#: Shapes of numbers, of numbers with spelt-out dots, and of addresses with and without their signs.
SHAPES, LABELS = 67, len(KINDS) + 1
_SIZES = (SHAPES * LABELS, LABELS * LABELS, LABELS * LABELS, LABELS * LABELS)
_CHAIN, _SAME, _NEAR = (sum(_SIZES[:k]) for k in (1, 2, 3))
_NEIGHBOURS = 60


def _marks(key: str) -> Iterator[tuple[str, str]]:
    """What similar keys share: for numbers of 10 digits and more, and addresses, the key less one character; for all
    numbers of 7 digits and more the last 7. An IP address is like no other."""
    if "@" not in key and "." in key:
        return
    if "@" in key or len(key) >= 10:
        yield "", key
        for i in range(len(key)):
            yield "", key[:i] + key[i + 1 :]
    if "@" not in key:
        yield "end", key[-7:]


def _numbers(text: str, a: int, b: int, observed: set[str]) -> list[tuple[int, int]]:
    """The mentions in a run of digits and signs: pieces between spaces, joined where they have an observed key or the end of one; where
    none has, the whole run if it can be personal data, else each piece that can."""
    pieces = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\x20]+", text[a:b])]
    out, i, hit = [], 0, False
    while i < len(pieces):
        size, best = 0, None
        for j in range(i, len(pieces) if observed else i):
            size += sum(c.isdigit() for c in text[pieces[j][0] : pieces[j][1]])
            if size > 19:
                break
            known = mention(text[pieces[i][0] : pieces[j][1]].strip("-/_. "))
            best = j if known and known[0] in observed else best
        hit = hit or best is not None
        out.append((pieces[i][0], pieces[i if best is None else best][1]))
        i = i + 1 if best is None else best + 1
    if not hit and mention(text[a:b]):
        return [(a, b)]
    out = [(x + len(t) - len(t.lstrip("-/_. ")), x + len(t.rstrip("-/_. "))) for x, y in out if (t := text[x:y]).strip("-/_. ")]
    return [(x, y) for x, y in out if mention(text[x:y])]


class Mentions:
    """The variables of a text: spans, shapes, observed labels (0: not observed, else kind + 1), and its edges. The
    mentions of one key, or of similar keys, are linked one to the next, so edges are as many as mentions."""

    def __init__(self, text: str, spans: list[Span]):
        hidden, at = [], 0
        for a, b, _ in spans:
            if b > at:
                hidden += [text[at : max(a, at)], "\0" * (b - max(a, at))]
                at = b
        open_text = "".join([*hidden, text[at:]]) if spans else text
        found: list[tuple[int, int, int]] = [(a, b, _RANK[k] + 1) for a, b, k in spans]
        observed = {m[0] for a, b, _ in spans if (m := mention(text[a:b]))}
        observed |= {key[i:] for key in observed if key.isdigit() for i in range(1, len(key) - 6)}
        taken: list[tuple[int, int]] = []
        if "@" in open_text or "at" in open_text:
            taken = [m.span() for m in _ADDRESS.finditer(open_text)]
            found += [(a, b, 0) for a, b in taken]
        k = 0
        for m in _NUMBER.finditer(open_text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if b - a >= 7 and (k == len(taken) or taken[k][0] >= b):
                found += [(*x, 0) for x in _numbers(open_text, a, b, observed)]
        self.span, self.shape, self.label, self.key = [], [], [], []
        for a, b, label in sorted(found):
            if known := mention(text[a:b]):
                self.span.append((a, b))
                self.label.append(label)
                self.key.append(known[0])
                self.shape.append(known[1])
        self.label = np.array(self.label, np.int64)
        self.chain = [(i, i + 1) for i in range(len(self.span) - 1) if 0 <= self.span[i + 1][0] - self.span[i][1] <= _NEIGHBOURS]
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        self.same, near = [], set()
        for i, key in enumerate(self.key):
            if key in last:
                self.same.append((last[key], i))
            last[key] = i
            first.setdefault(key, i)
        if len(first) > 1:
            seen: dict[tuple[str, str], int] = {}
            for key, i in first.items():
                for mark in _marks(key):
                    if mark in seen and seen[mark] != i:
                        near.add((seen[mark], i))
                    seen[mark] = i
        self.near = sorted(near)

    def known(self) -> np.ndarray:
        """Which labels teach something: a mention without a base span that is linked with one of a span is neither."""
        held = self.label > 0
        for edges in (self.same + self.near, reversed(self.same + self.near)):
            for i, j in edges:
                held[i] = held[j] = held[i] or held[j]
        return (self.label > 0) | ~held


def _writings(core: str, kind: str) -> list[str]:
    """Other ways to write a base span."""
    if kind == "email":
        name, place = core.rsplit("@", 1)
        return [f"{name[:-1] or name}@{place}", f"{name}(at){place}", f"{name} at {place.replace('.', ' dot ')}", f"{name} [at] {place.replace('.', ' [dot] ')}", f"{name} @ {place}"]
    groups = _GROUPS.findall(core)
    if kind == "ip":
        return [x.join(groups) for x in ("[.]", "(dot)", "-", " ")]
    digits = "".join(groups)
    if kind == "card":
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [*(x.join(four) for x in (".", "/", "_", " - ")), digits[:5] + str((int(digits[5]) + 1) % 10) + digits[6:]]
    own = digits[-10:]
    return [f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", digits, f"{own[3:6]}-{own[6:]}", f"00{digits}"]


def _other(core: str, shape: int, rng: random.Random) -> None | str:
    """Other data in the same writing and of the same shape."""
    for _ in range(40):
        new = "".join(rng.choice("123456789" if c != "0" else "0") if c.isdigit() else rng.choice("bcdfghklmnprstvz") if c.isalpha() and "dot" not in core and "at" not in core else c for c in core)
        if (got := mention(new)) and got[1] == shape:
            return new
    return None


#: A mention in another writing counts as personal data once in so many times, before any link speaks for it. So mentions
#: that are linked with each other alone, however often, stay without a label.
_RARE = 100


def _counts(texts) -> np.ndarray:
    """Counts of (shape, label), of chained and of skip-linked label pairs, as one vector."""
    out = np.zeros(sum(_SIZES), np.int64)

    def pair(at: int, a: int, b: int) -> None:
        a, b = sorted((a, b))
        out[at + a * LABELS + b] += 1

    for text in texts:
        if not text or not _ANY.search(text):
            continue
        spans = base_spans(text)
        t = Mentions(text, spans)
        known = t.known()
        np.add.at(out, (np.array(t.shape, np.int64) * LABELS + t.label)[known], 1)
        for at, edges in ((_CHAIN, t.chain), (_SAME, t.same), (_NEAR, t.near)):
            for i, j in edges:
                if known[i] and known[j]:
                    pair(at, int(t.label[i]), int(t.label[j]))
        rng = random.Random(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        for a, b, kind in spans[:50]:
            label, own = _RANK[kind] + 1, mention(text[a:b])
            for core in _writings(text[a:b], kind) if own else ():
                if got := mention(core):
                    out[got[1] * LABELS + label] += 1
                    out[got[1] * LABELS] += _RARE
                    pair(_SAME if got[0] == own[0] else _NEAR, label, label)
                    for _ in range(2):
                        #: Numbers that aren't personal data repeat as well.
                        if (decoy := _other(core, got[1], rng)) and mention(decoy)[0] != own[0]:
                            pair(_SAME, 0, 0)
                            pair(_NEAR, 0, 0)
    return out


def _examples(n: int = 80, seed: int = 5) -> list[str]:
    """Made-up texts with a base span of each kind among other numbers and addresses, in any order."""
    rng, out = random.Random(seed), []
    number = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    for _ in range(n):
        card = "4" + number(14)
        card += next(d for d in "0123456789" if _luhn(card + d))
        own = [f"a{number(3)}@b{number(2)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card, f"+1 ({number(3)}) {number(3)}-{number(4)}"]
        rest = [number(8), f"{number(3)}-{number(3)}-{number(4)}", f"{number(4)}.{number(4)}.{number(4)}.{number(4)}", f"{number(4)}-{number(2)}-{number(2)} {number(2)}", f"{number(2)}-{number(2)}-{number(2)}-{number(2)}", f"w{number(3)} at v{number(2)} dot z"]
        parts = [*own, *rest, *rest[: rng.randrange(4)]]
        rng.shuffle(parts)
        out.append("".join(x + ", and " + "on " * rng.choice((1, 1, 40)) for x in parts))
    return out


def tables(counts: np.ndarray, smooth: float = 0.5) -> tuple[np.ndarray, ...]:
    """Log factors: shape by label, and label pairs of chain, same and near edges (how far above chance they meet)."""
    shape = counts[: _SIZES[0]].reshape(SHAPES, LABELS) + smooth
    out = [np.log(shape / shape.sum(1, keepdims=True))]
    for at in (_CHAIN, _SAME, _NEAR):
        pair = counts[at : at + LABELS * LABELS].reshape(LABELS, LABELS).astype(float)
        pair = (pair + pair.T) / 2 + smooth
        alone = pair.sum(1) / pair.sum()
        out.append(np.log(pair / pair.sum() / np.outer(alone, alone)))
    return tuple(out)


def beliefs(t: Mentions, factors: tuple[np.ndarray, ...], rounds: int = 30, damp: float = 0.5, close: float = 1e-6) -> np.ndarray:
    """Loopy sum-product: the marginal of each mention's label; observed mentions keep theirs. Exact where edges form no
    loop. Memory grows with the mentions of one text, by about 400 bytes for each edge."""
    unary = np.exp(factors[0][np.array(t.shape, np.int64)])
    seen = t.label > 0
    unary[seen] = 1e-12
    unary[seen, t.label[seen]] = 1.0
    kinds = (t.chain, t.same, t.near)
    edges = np.array([e for k in kinds for e in k], np.int64).reshape(-1, 2)
    if len(edges):
        weight = np.exp(np.concatenate([np.repeat(f[None], len(k), 0) for f, k in zip(factors[1:], kinds, strict=True)]))
        source, target = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        weight, back = np.concatenate((weight, weight.transpose(0, 2, 1))), np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        message = np.full((len(source), LABELS), 1 / LABELS)
        for _ in range(rounds):
            total = np.log(unary)
            np.add.at(total, target, np.log(message))
            cavity = total[source] - np.log(message[back])
            cavity = np.exp(cavity - cavity.max(1, keepdims=True))
            new = np.einsum("ea,eab->eb", cavity, weight)
            new = np.maximum((1 - damp) * new / new.sum(1, keepdims=True) + damp * message, 1e-30)
            moved = np.abs(new - message).max()
            message = new
            if moved < close:
                break
        total = np.log(unary)
        np.add.at(total, target, np.log(message))
    else:
        total = np.log(unary)
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def added_spans(text: str, spans: list[Span], factors) -> list[Span]:
    """Spans that the field adds; none overlaps a base span. Mentions without any edge, if no shape is decided by
    itself, need no messages."""
    t = Mentions(text, spans)
    if not (t.label == 0).any():
        return []
    belief = beliefs(t, factors)
    best = belief.argmax(1)
    return [(*t.span[i], KINDS[best[i] - 1]) for i in np.flatnonzero((t.label == 0) & (best > 0) & (belief.max(1) > 0.5)).tolist()]


def train(docs: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, ...]:
    """Factors from the documents of the smallest hashed ids, about ``sample`` of them. The driver gets count vectors of
    fixed size only."""
    rate = min(1.0, sample / max(1, docs.count()))
    some = docs.where(F.expr(f"pmod(xxhash64(doc_id, 5), 1000003) < {rate * 1000003}")).select("text")

    def run(it):
        total = np.zeros(sum(_SIZES), np.int64)
        for batch in it:
            total += _counts(batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "c"])

    counts = _counts(_examples())
    for row in some.mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect():
        counts[row.i] += row.c
    return tables(counts)


def find(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (base and added) of every row.

    A null or empty text has no spans. A text's mentions are held at once, in memory that grows with their number. Each row stands alone once the factors are trained: repeated rows and ids give
    equal results. Other columns are ignored; an empty table gives an empty result.
    """
    factors = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), sample))

    def run(it):
        for batch in it:
            rows = [_row(text, factors.value) for text in batch.column("text").to_pylist()]
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
            columns = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


_NONE = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def _row(text: str | None, factors) -> tuple:
    if not text or not _ANY.search(text):
        return _NONE
    spans = base_spans(text)
    counts = [sum(s[2] == k for s in spans) for k in KINDS]
    every = sorted([*spans, *added_spans(text, spans, factors)], key=lambda s: (s[0], _RANK[s[2]], s[1]))
    return (*counts, hashlib.sha256(written(spans).encode()).hexdigest(), written(every))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of ``documents``."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
