"""Personal data by rules and a semi-Markov conditional random field.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers;
what they find always stays.  The model adds spans that the rules miss (a phone
number without its plus sign, an address written with "at" and "dot", account
and identity numbers).  It scores whole candidate segments, by features of the
whole span, and one dynamic program over the tokens around a trigger (a digit, an
``@``, an "at" that a "dot" follows) chooses boundaries and types together; a
segment holds at most ``LONGEST`` tokens, and a digit, an ``@``, or an "at" and a
"dot".  Its weights maximise the conditional likelihood of generated snippets
(``SNIPPETS`` of them, fixed seed), no rows of the corpus.

Offsets are code points, ends exclusive.  A null text is empty.  Texts are read
whole, in time linear in their length.  Further columns are ignored, repeated
rows get equal results.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from galley.llm.common import ids_and_texts

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = 4
LONGEST = 22
SNIPPETS = 2400
EPOCHS = 6
SEED = 11

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# from the start of a run of digits only: a match cannot begin inside one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))
        # a run of address characters ends at an @, so no character is passed twice
        done = max(done, text.rfind("@", done, at) + 1 if at >= 0 else done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by the rules, in order."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the model -------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|\n|[^\w\s]|.", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_AROUND = 48  # characters on each side of a trigger
_TRIGGER = re.compile(rf"[0-9]|@|\b(?i:at)\b(?=[^\n]{{1,{_AROUND}}}?\b(?i:dot)\b)")
_EMAIL_WORDS = {"at", "dot"}
_SMALL_WORDS = set("a an and are as at but by each for from he in is it of on one or she that the they this to was with you".split())
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)")
_SPELLED = re.compile(r"\w[\w.+-]*(?:\W{1,2}dot\W{1,2}\w+)*\W{1,2}at(?:\W{1,2}[\w-]+\W{1,2}dot)+\W{1,2}\w{2,}", re.I)


def iban_holds(text: str) -> bool:
    """Whether the check digits of an account number are right."""
    if not _IBAN.fullmatch(text):
        return False
    packed = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _shape(tokens: list[str]) -> str:
    out = []
    for t in tokens:
        if t[0] in "0123456789":
            out.append(f"9{len(t)}" if len(t) < 5 else "9+")
        elif t.isalpha():
            out.append(t.lower() if t.lower() in _EMAIL_WORDS else ("A" if t.isupper() else "a") + (str(len(t)) if len(t) < 4 else "+"))
        else:
            out.append(" " if t.isspace() else t)
    return "".join(out)


def _coarse(tokens: list[str]) -> str:
    """The span's order of digits, letters and marks, whatever their number."""
    out = []
    for t in tokens:
        kind = "9" if t[0] in "0123456789" else "@" if t.lower() in _EMAIL_WORDS else "a" if t.isalpha() else " " if t.isspace() else t
        if kind != "a" or out[-1:] != ["a"]:
            out.append(kind)
    return "".join(out) if len(out) <= 16 else "long"


def features(tokens: list[str], i: int, j: int) -> list[str]:
    """Features of the whole span ``tokens[i:j]`` and its edges."""
    span = tokens[i:j]
    text = "".join(span)
    digits = "".join(c for c in text if "0" <= c <= "9")
    groups = [t for t in span if t[0] in "0123456789"]
    letters = sum(c.isalpha() for c in text)
    before = next((t.lower() for t in reversed(tokens[max(0, i - 4) : i]) if t.isalpha()), "")
    n = len(digits)
    lower = [t.lower() for t in span]
    out = [
        "bias",
        f"coarse={_coarse(span)}",
        f"shape={_shape(span)}" if len(span) <= 12 else "shape=long",
        f"kinds={''.join(sorted(set(re.sub('[0-9]', '9', re.sub('[A-Za-z]+', 'a', text)))))}",
        f"digits={n if n < 20 else 20}",
        f"groups={[len(g) for g in groups]}" if len(groups) <= 5 else "groups=many",
        f"luhn={12 <= n <= 19 and luhn(digits)}/{letters > 0}",
        f"before={before}",
        f"tail={[t if t in _EMAIL_WORDS else t.isalpha() for t in lower if t.isalnum()][-3:]}",
        f"open={span[0][0] in '+('}{span[0].isalpha()}",
        f"letters={min(letters, 4)}{'@' in text}{_SPELLED.fullmatch(text) is not None}",
        f"glued={i > 0 and not tokens[i - 1].isspace() and tokens[i - 1] not in '(<[:,'}"
        f"{j < len(tokens) and tokens[j][0].isalnum()}",
    ]
    if "at" in lower and lower[-1].isalpha():
        host = next((t for t in lower[lower.index("at") + 1 :] if t.isalpha()), "")
        out.append(f"prose={lower[-1] in _SMALL_WORDS}{host in _SMALL_WORDS}")
    if len(groups) == 4 and text.count(".") == 3 and not letters:
        out.append(f"bytes={all(int(g) <= 255 for g in groups)}")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]+", text):
        out.append(f"iban={15 <= sum(c.isalnum() for c in text) <= 34}{iban_holds(text)}")
    if text[0] in "+0(" and not letters:
        out.append(f"dialled={text[:2] if text[0] == '0' else text[0]}/{min(len(groups), 4)}/{9 <= n <= 15}")
    return out


def _may_open(t: str) -> bool:
    return t.isalnum() or t in "+("


def segments(tokens: list[str]) -> list[tuple[int, int]]:
    """Candidate segments: bounded, with a digit, an ``@`` or an at and a dot, and no lone prose."""
    out = []
    for i, first in enumerate(tokens):
        if not _may_open(first):
            continue
        spaces = letters = 0
        hot = at = False
        for j in range(i, min(i + LONGEST, len(tokens))):
            t = tokens[j]
            if t == "\n" or spaces > 9:
                break
            if t.isspace():
                spaces += 1
            low = t.lower()
            at = at or low == "at"
            hot = hot or t[0] in "0123456789@" or (at and low == "dot")
            if spaces and t.isalpha() and low not in _EMAIL_WORDS and not (t.isupper() and len(t) <= 4):
                letters += 1
                if letters > (5 if at else 2):
                    break
            if hot and t.isalnum() and (j > i or len(t) >= 6):
                out.append((i, j + 1))
    return out


class SemiCrf:
    """Segment scores are sums of weights per (feature, type); outside is zero."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}

    def scores(self, tokens: list[str], spans: list[tuple[int, int]], seen: list[list[str]] | None = None) -> np.ndarray:
        seen = seen or [features(tokens, i, j) for i, j in spans]
        zero = np.full(len(KINDS), -0.3)  # an unseen feature speaks against a span
        get = self.weights.get
        return np.array([sum(get(f, zero) for f in fs) for fs in seen]).reshape(-1, len(KINDS))

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation: ``(first token, end token, kind)``."""
        spans = segments(tokens)
        if not spans:
            return []
        score = self.scores(tokens, spans)
        kind, value = score.argmax(axis=1), score.max(axis=1)
        ends: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(spans):
            if value[k] > 0:
                ends.setdefault(j, []).append(k)
        best, back = [0.0] * (len(tokens) + 1), [-1] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            best[j] = best[j - 1]
            for k in ends.get(j, ()):
                if best[spans[k][0]] + value[k] > best[j]:
                    best[j], back[j] = best[spans[k][0]] + value[k], k
        out, j = [], len(tokens)
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                out.append((*spans[back[j]], int(kind[back[j]])))
                j = spans[back[j]][0]
        return out[::-1]

    def fit(self, examples: list[tuple[list[str], set[tuple[int, int, int]]]], rate: float = 0.3) -> SemiCrf:
        """Stochastic ascent on the log-likelihood of the true segmentations."""
        cached = []
        for tokens, gold in examples:
            spans = segments(tokens)
            cached.append((len(tokens), spans, [features(tokens, i, j) for i, j in spans], gold))
        order = list(range(len(cached)))
        draw = random.Random(SEED)
        for epoch in range(EPOCHS):
            draw.shuffle(order)
            for at in order:
                n, spans, seen, gold = cached[at]
                if not spans:
                    continue
                score = self.scores([], spans, seen)
                each = np.logaddexp.reduce(score, axis=1)
                fore, ahead = [0.0] * (n + 1), [0.0] * (n + 1)
                into: dict[int, list[int]] = {}
                out_of: dict[int, list[int]] = {}
                for k, (i, j) in enumerate(spans):
                    into.setdefault(j, []).append(k)
                    out_of.setdefault(i, []).append(k)
                for j in range(1, n + 1):
                    fore[j] = _logsum([fore[j - 1], *(fore[spans[k][0]] + each[k] for k in into.get(j, ()))])
                for i in range(n - 1, -1, -1):
                    ahead[i] = _logsum([ahead[i + 1], *(ahead[spans[k][1]] + each[k] for k in out_of.get(i, ()))])
                step = rate / (1 + epoch)
                for k, (i, j) in enumerate(spans):
                    grad = -np.exp(np.minimum(score[k] + fore[i] + ahead[j] - fore[n], 0))
                    for kind in range(len(KINDS)):
                        if (i, j, kind) in gold:
                            grad[kind] += 1
                    if np.abs(grad).max() > 1e-4:
                        for f in seen[k]:
                            w = self.weights.get(f)
                            if w is None:
                                w = self.weights[f] = np.zeros(len(KINDS))
                            w += step * grad
        return self


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _snippets() -> list[tuple[list[str], set[tuple[int, int, int]]]]:
    """Generated text with known spans, and numbers that are none of them."""
    draw = random.Random(SEED)
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice(["an", "re", "on", "le", "sch", "ti", "os", "ent", "é", "ü"]) for _ in range(draw.randint(1, 4)))

    def card() -> str:
        body = draw.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity(kind: int) -> tuple[str, str]:
        if kind == 0:
            plain = lambda: re.sub("[éü]", "e", word())
            gap = draw.choice(["", ".", "_", "-"])
            host, top = plain(), draw.choice(["com", "org", "net", "example", "de", "io", "edu"])
            if draw.random() < 0.2:
                return "mail", f"{plain()}{gap}{plain()}{draw.choice(['', d(2)])}@{host}.{top}"
            left, right = draw.choice([(" ", " "), (" ", " "), (" (", ") "), (" [", "] "), ("(", ")"), ("[", "]")])
            at, dot = (left + w + right for w in draw.choice([("at", "dot"), ("at", "dot"), ("AT", "DOT"), ("At", "Dot")]))
            name = plain() + draw.choice([gap + plain(), "", d(2), dot + plain()])
            host = draw.choice([host, host, f"{host}-{plain()}", f"{plain()}{dot}{host}"])
            return draw.choice(["mail", "email", "write", "to"]), f"{name}{at}{host}{dot}{top}"
        if kind == 1:
            return "host", ".".join(str(draw.randint(0, 255)) for _ in range(4))
        if kind == 2:
            c = card()
            return "card", draw.choice([c, "-".join(c[i : i + 4] for i in range(0, 16, 4)), " ".join(c[i : i + 4] for i in range(0, 16, 4))])
        if kind == 3:
            a, b, c = d(3), d(3), d(4)
            abroad = draw.choice(["1", "33", "34", "39", "44", "49", "353", "61"])
            return draw.choice(["tel", "phone", "call", "mobile", "fax", "at", "number"]), draw.choice(
                [
                    f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"+49 {a} {b}{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}",
                    f"1-{a}-{b}-{c}", f"00{abroad} {d(2)} {b}{c}", f"00{abroad} {a} {d(6)}", f"00{abroad} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
                    f"+{abroad} {d(2)} {c} {d(4)}", f"0{d(2)} {c} {d(4)}", f"0{d(3)} {d(6)}", f"0{d(4)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"(0{d(2)}) {d(7)}",
                    f"0{d(2)}/{d(7)}", f"0{d(3)}-{d(7)}",
                ]
            )
        if kind == 4:
            bank = draw.choice(["", "", "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)), draw.choice("MXK")])
            land = draw.choice("ABCDEFGHIJKLMNPRST") + draw.choice("ABCDEFGHIJKLMNOPRSTUVZ")
            body = bank + d(draw.randint(11, 26) - len(bank))
            check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
            whole = f"{land}{check:02d}{body}" if draw.random() < 0.8 else f"{draw.choice(['DE', 'FR', 'ES'])}{d(2)}{d(18)}"
            return "iban", draw.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])
        return "ssn", f"{d(3)}-{d(2)}-{d(4)}"

    def other() -> str:
        return draw.choice(
            [
                f"Version {d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"{draw.choice(['19', '20'])}{d(2)}", f"{d(2)},{d(3)} items", f"${d(2)}.{d(2)}",
                f"no {d(1)}", d(draw.randint(1, 8)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", "token = " + "".join(draw.choice("0123456789abcdef") for _ in range(32)),
                "AKIA" + "".join(draw.choice("ABCDEFGHIJ0123456789") for _ in range(16)), f"page {d(3)}", f"{word()} at {word()}", f"CC BY-NC {d(1)}.{d(1)}", f"{d(1)}{word()}", f"{d(3)}.{d(3)}",
                f"{word()} at the {word()}", f"{d(2)} {word()} {d(2)}", d(10), "-".join([d(2), d(2)]), f"{d(1)} - {d(1)}",
                f"{d(2)} {d(2)} {d(4)}", f"{d(1)} {d(3)} {d(3)}", f"{d(3)} {d(3)}", f"{d(4)} {d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"0.{d(6)}", f"0{d(1)}:{d(2)}",
                f"{d(3)} {d(3)} {d(3)} {d(3)}", f"{d(1)} {d(1)} {d(2)} {d(3)}", f"{d(4)}, {d(4)}, {d(4)}", f"looked at the dot on {word()}", f"{word()} at {word()} and a dot",
                f"{word()} at {draw.choice(['a', 'the', 'one', 'each', 'this'])} dot {draw.choice(['on', 'in', 'of', 'and', 'or', 'by'])} {word()}",
                f"at {d(2)}:{d(2)} {word()}", "".join(draw.choice("ABCDEFGH") for _ in range(3)) + d(6), f"{draw.choice('AB')}{d(2)} {d(4)}", f"ISBN {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            ]
        )

    out = []
    for k in range(SNIPPETS):
        left = " ".join(word() for _ in range(3)) + draw.choice([" ", " ", ", ", ": ", "\n", ". "]) if draw.random() < 0.75 else ""
        right = draw.choice([" ", ". ", ", ", "\n"]) + word() if draw.random() < 0.85 else ""
        kind = k % (len(KINDS) * 2 + 2)
        kind = 0 if kind >= len(KINDS) * 2 else kind  # addresses have the most forms
        if kind < len(KINDS):
            cue, span = entity(kind)
            if draw.random() < 0.3:
                left += draw.choice([cue, cue.title()]) + draw.choice([" ", ": "])
        else:
            span = other()
        tokens = _TOKEN.findall(left + span + right)
        gold: set[tuple[int, int, int]] = set()
        if kind < len(KINDS):
            bounds = np.cumsum([0] + [len(t) for t in tokens]).tolist()
            if len(left) in bounds and len(left) + len(span) in bounds:
                gold.add((bounds.index(len(left)), bounds.index(len(left) + len(span)), kind))
        out.append((tokens, gold))
    return out


def train() -> SemiCrf:
    return SemiCrf().fit(_snippets())


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers; overlapping ones are one."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - _AROUND), min(len(text), m.end() + _AROUND)
        if a <= end:
            end = b
        else:
            if end >= 0:
                yield start, end
            start, end = a, b
    if end >= 0:
        yield start, end


def all_spans(text: str, model: SemiCrf) -> tuple[list, list]:
    """Spans by the rules, and those with the model's further ones."""
    base = base_spans(text)
    more = []
    for lo, hi in _regions(text):
        tokens = _TOKEN.findall(text[lo:hi])
        found = model.decode(tokens)
        if found:
            bounds = np.cumsum([lo] + [len(t) for t in tokens]).tolist()
            more += [(bounds[i], kind, bounds[j]) for i, j, kind in found]
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    free = []
    for s, kind, e in more:
        k = int(np.searchsorted(starts, e)) - 1  # the last rule span that begins before the end
        if k < 0 or reach[k] <= s:
            free.append((s, kind, e))
    return base, sorted(base + free)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    weights = train().weights  # some hundred features, whatever the corpus

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = SemiCrf()
        model.weights = weights
        for part in parts:
            rows = []
            for text in part["text"]:
                base, every = all_spans(text or "", model)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(BASE_KINDS)]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            names = [*(f"n_{k}" for k in KINDS[:BASE_KINDS]), "base_sha256", "spans"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    counts = ", ".join(f"n_{k} long" for k in KINDS[:BASE_KINDS])
    return ids_and_texts(docs).mapInPandas(
        batches, f"doc_id long, {counts}, base_sha256 string, spans string"
    )
