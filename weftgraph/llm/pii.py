"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The field labels whole segments. A candidate is a run of at most MAX_TOKENS
tokens that begins and ends with a sign that a value can begin and end with and
holds one @, or an `at` and a `dot` behind it, or 7 to 19 digits in at most 5
groups, or 4 groups of 3 digits at most. It scores by features of the span as a
whole: its groups of digits, separators, checksum, octets, the words around it.
Dynamic programming over places chooses boundaries and types jointly; what lies
outside segments goes token by token with score 0. A place begins MAX_TOKENS
candidates at most, so time grows with a text's length.

As every candidate holds a digit, an @ or a spelled-out address, the best
labelling of a text falls apart into zones around those; only zones are
tokenised, and the rest of a text costs one search. The field is trained on generated sentences by gradient
steps on the likelihood, which sums over all segmentations.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import merge
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")

# --- base rules ---------------------------------------------------------------------------------
# Forms of the base patterns that take linear time on any text; they match alike.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
#: `at` and `dot` of an address in words, bare or in brackets.
_SPELLED = re.compile(r"(?<![^\W_])at[\])]?\x20?(?:[A-Za-z0-9-]+[\x20\[\](]{1,3}){1,2}dot(?![^\W_])", re.I)
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain with a dot: the local part reaches as far left as it can."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = end = m.end()
        free = max(free, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    if not _HINT.search(text):
        return []
    out = [(0, *span) for span in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# --- the field -----------------------------------------------------------------------------------
MAX_TOKENS = 20
#: Characters on either side of a digit or @ that belong to its zone.
MARGIN = 48
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
#: Words that announce a value.
CUES = {
    "mail": 0, "email": 0, "e": 0, "contact": 0, "ip": 1, "host": 1, "address": 1, "card": 2, "visa": 2, "account": 2,
    "number": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3,
}
#: Last parts of addresses that are told from words in a sentence.
TOP = "com org net edu gov info biz io de fr es it uk eu us".split()
FEATURES = (
    ["bias", "has_at", "word_at_dot", "spelled", "top_domain", "bracketed", "loose_words", "dot_beside", "host_dot", "more_left", "more_right", "plus", "paren", "luhn16", "octets", "letters", "left_digit", "right_digit", "left_sign", "money", "many"]
    + [f"cue_{k}" for k in KINDS]
    + [f"digits_{k}" for k in ("0", "1-6", "7-9", "10", "11-12", "13-15", "16-19", "20+")]
    + [f"groups_{k}" for k in ("1", "2", "3", "4", "5+")]
    + [f"sep_{k}" for k in ("space", "dash", "dot", "slash", "other")]
    + [f"shape_{k}" for k in ("4-4-4-4", "3-3-4", "3-4", "1-3-3-4", "2-3-4", "ip")]
)
_AT = {name: i for i, name in enumerate(FEATURES)}
_SHAPES = {"4-4-4-4", "3-3-4", "3-4", "1-3-3-4"}


def hinted(text: str) -> bool:
    return bool(_HINT.search(text) or ("dot" in text.lower() and _SPELLED.search(text)))


def zones(text: str) -> Iterator[tuple[int, int]]:
    hints: Iterable = _HINT.finditer(text)
    if "dot" in text.lower():
        hints = merge(hints, _SPELLED.finditer(text), key=lambda m: m.start())
    start = end = None
    for m in hints:
        if end is not None and m.start() <= end:
            end = max(end, m.end() + MARGIN)
            continue
        if end is not None:
            yield max(0, start), min(len(text), end)
        start, end = m.start() - MARGIN, m.end() + MARGIN
    if end is not None:
        yield max(0, start), min(len(text), end)


def candidates(tokens: list[str]) -> list[tuple[int, int]]:
    """Runs of tokens that may be a value."""
    # what a token is: 0 ends every run, 1 digits, 2 an @, 3 at, 4 dot, 5 another word, 6 else
    kinds = []
    for t in tokens:
        if "\n" in t or len(t) > 64 or (t.isspace() and len(t) > 1):
            kinds.append(0)
        elif t[0].isdigit():
            kinds.append(1)
        elif t == "@":
            kinds.append(2)
        else:
            low = t.lower()
            kinds.append(3 if low == "at" else 4 if low == "dot" else 5 if t[0].isalnum() else 6)
    out = []
    for i, first in enumerate(kinds):
        if first in (0, 2) or (first == 6 and tokens[i] not in "+("):
            continue
        digits = groups = widest = signs = at = dot = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            kind = kinds[j]
            if kind == 1:
                size = len(tokens[j])
                digits, groups, widest = digits + size, groups + 1, max(widest, size)
            elif kind == 2:
                signs += 1
                if signs > 1:
                    break
            elif kind == 3:
                at = 1
            elif kind == 4:
                dot = at
            elif kind == 0:
                break
            if kind != 2 and kind != 6 and (signs or dot or (7 <= digits <= 19 and groups <= 5) or (groups == 4 and widest <= 3)):
                out.append((i, j + 1))
    return out


def span_features(tokens: list[str], i: int, j: int) -> list[int]:
    """Numbers of the features that a segment has."""
    own = tokens[i:j]
    runs = [t for t in own if t[0].isdigit() and t.isascii()]
    seps = {t for t in own if not t[0].isalnum()}
    words = [t.lower() for t in own if t[0].isalpha()]
    n, shape = sum(map(len, runs)), "-".join(str(len(t)) for t in runs)
    before = tokens[i - 1] if i else " "
    after = tokens[j] if j < len(tokens) else " "
    cue = next((CUES[w.lower()] for w in reversed(tokens[max(0, i - 5) : i]) if w.lower() in CUES), None)
    has = ["bias"]
    has += ["has_at"] * ("@" in seps) + ["plus"] * (own[0] == "+")
    has += ["paren"] * ("(" in seps and ")" in seps) + ["letters"] * bool(words)
    # what goes on beyond the span in signs that such values are made of
    beyond = tokens[j + 1][0].isalnum() if j + 1 < len(tokens) else False
    has += ["more_left"] * (before[-1].isalnum() or before in "._%-@") + ["more_right"] * (after[0].isalnum() or (after in ".-@_" and beyond))
    has += ["host_dot"] * ("@" in own and "." in own[own.index("@") :])
    if "at" in words and "dot" in words:
        terms = "".join(t.lower() if t[0].isalnum() else " " for t in own).split()
        # one word, at, words parted by dots: an address as it is spelled out
        k = terms.index("at") if "at" in terms else len(terms)
        name, host = terms[:k], terms[k + 1 :]
        parted = lambda part: len(part) % 2 == 1 and all((w == "dot") == (x % 2 == 1) for x, w in enumerate(part))
        spelled = parted(name) and len(host) > 2 and parted(host)
        has += ["word_at_dot"] + ["spelled"] * spelled + ["top_domain"] * (spelled and terms[-1] in TOP) + ["bracketed"] * (spelled and not seps.isdisjoint("[(")) + ["loose_words"] * (not parted(name) or not parted(host))
        near = [t.lower() for t in (*tokens[max(0, i - 2) : i], *tokens[j : j + 2])]
        has += ["dot_beside"] * ("dot" in near)
    if 16 <= n <= 19 and not words and luhn("".join(runs)):
        has.append("luhn16")
    if len(runs) == 4 and len(own) == 7 and seps == {"."} and all(len(t) <= 3 and int(t) <= 255 for t in runs):
        has += ["octets", "shape_ip"]
    has += ["left_digit"] * before[-1].isdigit() + ["right_digit"] * after[0].isdigit()
    has += ["left_sign"] * (not before.isspace() and not before.isalnum()) + ["money"] * (before in "$€£%#" or after in "$€£%")
    has += ["many"] * (len(own) > 11)
    if cue is not None:
        has.append(f"cue_{KINDS[cue]}")
    for name, most in (("0", 0), ("1-6", 6), ("7-9", 9), ("10", 10), ("11-12", 12), ("13-15", 15), ("16-19", 19), ("20+", math.inf)):
        if n <= most:
            has.append(f"digits_{name}")
            break
    if runs:
        has.append(f"groups_{len(runs) if len(runs) < 5 else '5+'}")
    for s in seps - set("[]()") if "bracketed" in has else seps:
        has.append({" ": "sep_space", "-": "sep_dash", ".": "sep_dot", "/": "sep_slash"}.get(s, "sep_other"))
    if shape in _SHAPES:
        has.append(f"shape_{shape}")
    elif shape.endswith("-3-4"):
        has.append("shape_2-3-4")
    return [_AT[h] for h in dict.fromkeys(has)]


def decode(tokens: list[str], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first token, end token) of the best segmentation."""
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for i, j in candidates(tokens):
        scores = weights[span_features(tokens, i, j)].sum(0)
        k = int(scores.argmax())
        if scores[k] > 0:
            ending.setdefault(j, []).append((i, k, float(scores[k])))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, k, score in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (k, i, j)
    out, j = [], len(tokens)
    while j > 0:
        if back[j]:
            out.append(back[j])
            j = back[j][1]
        else:
            j -= 1
    return out[::-1]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(3, 7)))


def _card(rng: random.Random) -> str:
    body = "4" + _digits(rng, 14)
    return body + next(d for d in "0123456789" if luhn(body + d))


def _value(rng: random.Random, kind: int) -> str:
    word = lambda: _word(rng)
    if kind == 0:
        name, host, top = f"{word()}{rng.choice(['.', '_', ''])}{word()}{rng.choice(['', _digits(rng, 2)])}", word(), rng.choice(TOP)
        left, right = rng.choice([("", ""), ("", ""), ("[", "]"), ("(", ")")])
        first = f"{word()}{rng.choice(['', '', f' {left}dot{right} {word()}', _digits(rng, 2)])}"
        return rng.choice([f"{name}@{host}.{top}"] * 2 + [f"{first} {left}at{right} {host} {left}dot{right} {top}"])
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        c = _card(rng)
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {a} {b}{c}", f"1-{a}-{b}-{c}"])


def _distractor(rng: random.Random) -> str:
    return rng.choice([
        _digits(rng, rng.randint(1, 6)), _digits(rng, rng.randint(7, 14)), f"{_digits(rng, 2)}.{_digits(rng, 2)}", f"${_digits(rng, 3)}.{_digits(rng, 2)}",
        f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}", f"{_digits(rng, 1)}.{_digits(rng, 1)}.{_digits(rng, 1)}",
        f"{rng.randint(1900, 2030)}", f"v{_digits(rng, 1)}.{_digits(rng, 2)}", f"{_digits(rng, 16)}", f"{_digits(rng, 20)}", f"{_digits(rng, 3)} {_digits(rng, 4)}",
        "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"{_digits(rng, 2)}, {_digits(rng, 2)}, {_digits(rng, 3)}", f"{_digits(rng, 4)} {_digits(rng, 4)}", "@", f"page {_digits(rng, 3)}",
        f"at {_word(rng)} the dot", f"{_word(rng)} at {_word(rng)}, dot {_word(rng)}", f"{_word(rng)} at {_word(rng)} dot {_word(rng)}", f"look at {_word(rng)} {_word(rng)} dot {_word(rng)}",
    ])


def generated(n: int, seed: int) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Sentences of invented words, values and look-alikes, with their segments."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        tokens, spans = [], []
        for _ in range(rng.randint(2, 4)):
            for _ in range(rng.randint(1, 4)):
                tokens += ["".join(rng.choice("aeinorsth") for _ in range(rng.randint(2, 8))), rng.choice([" ", " ", ", "])]
            if rng.random() < 0.55:
                kind = rng.randrange(4)
                if rng.random() < 0.3:
                    tokens += [rng.choice([w for w, k in CUES.items() if k == kind]), rng.choice([": ", " "])]
                tokens = _TOKEN.findall("".join(tokens))
                value = _TOKEN.findall(_value(rng, kind))
                spans.append((kind, len(tokens), len(tokens) + len(value)))
                tokens += [*value, " "]
            else:
                tokens = _TOKEN.findall("".join(tokens)) + [*_TOKEN.findall(_distractor(rng)), " "]
        out.append((tokens, [s for s in spans if s[2] - s[1] <= MAX_TOKENS]))
    return out


def _logsumexp(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


@lru_cache(maxsize=1)
def trained(sentences: int = 600, epochs: int = 60, seed: int = 7) -> np.ndarray:
    """FEATURES x KINDS weights that maximise the likelihood of generated segmentations, less an L2 term.

    Each epoch runs the forward and backward sums over all segmentations of
    every sentence; features are found once. Depends on its arguments alone.
    """
    rows, owners, parts = [], [], []
    for tokens, spans in generated(sentences, seed):
        own = candidates(tokens)
        parts.append((len(tokens), own, len(rows), {(i, j): k for k, i, j in spans}))
        for i, j in own:
            x = np.zeros(len(FEATURES))
            x[span_features(tokens, i, j)] = 1
            rows.append(x)
            owners.append((i, j))
    x = np.array(rows)
    gold = np.zeros((len(rows), len(KINDS)))
    for _, own, at, spans in parts:
        for k, span in enumerate(own):
            if span in spans:
                gold[at + k, spans[span]] = 1
    weights, speed = np.zeros((len(FEATURES), len(KINDS))), np.zeros((len(FEATURES), len(KINDS)))
    for _ in range(epochs):
        scores = x @ weights
        total = np.logaddexp.reduce(scores, axis=1)
        mass = np.zeros(len(rows))
        for n, own, at, _ in parts:
            by_end, by_start = {}, {}
            for k, (i, j) in enumerate(own):
                by_end.setdefault(j, []).append((i, float(total[at + k])))
                by_start.setdefault(i, []).append((j, float(total[at + k])))
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _logsumexp([ahead[j - 1], *(ahead[i] + s for i, s in by_end.get(j, ()))])
            for i in range(n - 1, -1, -1):
                behind[i] = _logsumexp([behind[i + 1], *(behind[j] + s for j, s in by_start.get(i, ()))])
            for k, (i, j) in enumerate(own):
                mass[at + k] = math.exp(min(0.0, ahead[i] + total[at + k] + behind[j] - ahead[n]))
        expected = np.exp(scores - total[:, None]) * mass[:, None]
        gradient = x.T @ (gold - expected) - 0.05 * weights
        speed = 0.9 * speed + 0.1 * gradient * gradient
        weights = weights + 0.5 * gradient / (np.sqrt(speed) + 1e-3)
    return weights


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Segments of the field that touch no base span."""
    out, taken = [], sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))  # how far spans up to here go
    for start, end in zones(text):
        # a zone doesn't begin or end inside a token
        while start and (text[start - 1].isalnum() and text[start].isalnum()) and start > 0 and not text[start].isspace():
            start += 1
            if start >= end:
                break
        while end < len(text) and end > start and text[end - 1].isalnum() and text[end].isalnum():
            end -= 1
        places, tokens = [], []
        for m in _TOKEN.finditer(text, start, end):
            places.append(m.start())
            tokens.append(m[0])
        places.append(end)
        for kind, i, j in decode(tokens, weights):
            s, e = places[i], places[j - 1] + len(tokens[j - 1])
            before = bisect_left(starts, e)
            if not before or reach[before - 1] <= s:
                out.append((kind, s, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, sentences: int = 600, epochs: int = 60) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of `docs`.

    Base spans (leftmost non-overlapping of each pattern, failing ones dropped)
    are counted, hashed and all kept; the field adds spans that touch none of
    them. Places are code points, ends exclusive. Null texts are empty.
    Repeated rows are each searched; only doc_id and text are read.
    """
    weights = trained(sentences, epochs)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                text = text or ""
                base = base_spans(text)
                more = added_spans(text, base, weights) if hinted(text) else []
                counts = [sum(s[0] == k for s in base) for k in range(4)]
                rows.append((*counts, sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pd.concat([pdf[["doc_id"]], pd.DataFrame(rows, columns=names, index=pdf.index)], axis=1)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInPandas(search, schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
