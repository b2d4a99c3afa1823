"""Personal data by candidate gradient boosting.

Base patterns with their checks (Luhn, octets, digit counts) always count.
High-recall generators then propose further, overlapping spans (addresses
written with "(at)" and "dot", grouped or national numbers, IPv6, cards with
dots); boosted trees judge each by its format and context, isotonic
calibration turns margins into probabilities, and a threshold per kind, set on
held-out candidates for a target precision, selects. Of overlapping selected
spans the likelier stays; none may overlap a base span.

No table labels spans, so the trees learn from a seeded synthetic set of
`TRAIN_SENTENCES` sentences (a fixed bound) with planted personal data and
look-alikes: dates, times, versions, prices, order numbers, hexadecimal keys.
They see only candidates that overlap no base span, as in use.

Defined results: null text counts as empty; an empty text has no spans; spans
are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import map_columns, with_column
from folioflow.llm._gbt import fit_gbt, fit_isotonic, gbt_margin, isotonic

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}
TRAIN_SENTENCES = 12_000
SEED = 7
PRECISION = 0.995
AT_ONCE = 20_000  # candidates judged together

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

_AT = r"(?:@|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
LOOSE = {
    "email": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}(?:{_DOT}[A-Za-z0-9_-]{{1,63}})?{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])|[0-9]{1,3}(?:\s?[.,]\s?[0-9]{1,3}){3}"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20./_-][0-9]{4}){2}[\x20./_-][0-9]{3,7}|[0-9]{4}[\x20./_-][0-9]{6}[\x20./_-][0-9]{5})(?![0-9])|[0-9](?:[\x20./_-]?[0-9]){11,18}"),
    "phone": re.compile(r"(?:\+|\b00)?\(?[0-9][0-9\x20()./-]{5,18}[0-9]"),
}

# Where a further span may begin inside one that was found: at words and at groups of digits, whose ends are known by the start.
_INNER = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])(?=({LOOSE['email'].pattern}))", re.I),
    "ip": re.compile(r"(?<![0-9])(?=([0-9]{1,3}(?:\s?[.,]\s?[0-9]{1,3}){3}))"),
}
_RUN = re.compile(r"[0-9](?:[0-9\x20()./_-]*[0-9])?")
_GROUP = re.compile("[0-9]+")
_NO_DIGIT = re.compile("[^0-9]+")

# The end of every loose email, which is found in one pass; a text without it holds none.
_EMAIL_END = re.compile(rf"{_AT}[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9-]", re.I)

# Words that stand near personal data or near its look-alikes.
CUES = {
    "email": ("mail", "e-mail", "email", "write", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte", "payment"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "telefon", "cell", "teléfono", "téléphone"),
    "other": ("version", "v", "order", "isbn", "page", "pages", "section", "id", "ref", "price", "eur", "usd", "date", "invoice", "build", "token", "key"),
}


def luhn(digits: str) -> bool:
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(n - 9 * (n > 9) for n in twice)) % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in found.split(".")))
    digits = _NO_DIGIT.sub("", found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> list[tuple[int, int]]:
    """What the base pattern's leftmost matches are, found from each @ backwards.

    A scan from the left would try every start in a long run of letters.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """What the base pattern's leftmost matches are: four groups of digits with one dot between each, read group by group.

    A scan from the left would try every start in a long run of digits.
    """
    out, chain = [], []  # of groups parted by single dots, at most four
    for m in _GROUP.finditer(text):
        if not (chain and m.start() == chain[-1][1] + 1 and text[chain[-1][1]] == "."):
            chain.clear()
        chain.append(m.span())
        if len(chain) == 4:
            out.append((chain[0][0], m.end()))
            chain.clear()
    return out


def _digits(text: str) -> bool:
    return any(c in text for c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind, then start; failing matches are dropped and not retried."""
    out = [("email", *span) for span in _emails(text)]
    if _digits(text):
        if "." in text:
            out += [("ip", a, b) for a, b in _ips(text) if _passes("ip", text[a:b])]
        for kind in ("card", "phone") if "+" in text else ("card",):
            out += [(kind, *m.span()) for m in BASE[kind].finditer(text) if _passes(kind, m[0])]
    return out


MOST_GROUPS = 8  # of digits in a phone number
CARD_GROUPS = 6


def _grouped(text: str, taken: bytearray) -> set[tuple[str, int, int]]:
    """Cards and phones of whole groups of digits: from every group, all ends that the kind allows, so that neighbouring numbers are proposed apart as well as together."""
    out: set[tuple[str, int, int]] = set()
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, *run.span()) if not taken[m.start()]]
        for i, (a, _) in enumerate(groups):
            card, phone, digits, last = True, True, 0, None
            for n, (start, b) in enumerate(groups[i : i + MOST_GROUPS]):
                between = text[last:start] if last is not None else ""
                card = card and n < CARD_GROUPS and (last is None or len(between) == 1 and between in " ./_-")
                phone = phone and b - a <= 20 and "_" not in between
                digits, last = digits + b - start, b
                if digits > 19 or not (card or phone) or 1 in taken[a:b]:
                    break
                if card and digits >= 12 and luhn(_NO_DIGIT.sub("", text[a:b])):
                    out.add(("card", a, b))
                if phone and 7 <= digits <= 15:
                    x = a - (a > 0 and text[a - 1] == "(")
                    x -= x > 0 and text[x - 1] == "+"
                    out.add(("phone", x, b))
                    if x < a and ")" not in text[a:b] and text[x] == "(":
                        out.add(("phone", a, b))
    return out


def _covered(text: str, base: list[tuple[str, int, int]]) -> bytearray:
    """One byte a character: 1 inside the base spans."""
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    return taken


def candidates(text: str, taken: bytearray | None = None) -> list[tuple[str, int, int]]:
    """What the high-recall generators propose, by kind and place; all spans may overlap one another, but not what is `taken`."""
    taken = bytearray(len(text)) if taken is None else taken
    out: set[tuple[str, int, int]] = set()
    if _EMAIL_END.search(text):
        out |= {("email", *m.span()) for m in LOOSE["email"].finditer(text)} | {("email", *m.span(1)) for m in _INNER["email"].finditer(text)}
    if _digits(text):
        for kind in KINDS[1:]:
            out |= {(kind, *m.span()) for m in LOOSE[kind].finditer(text)}
        out |= {("ip", *m.span(1)) for m in _INNER["ip"].finditer(text)} | _grouped(text, taken)
    return _ordered([s for s in out if 1 not in taken[s[1] : s[2]]])


@lru_cache(maxsize=4096)
def _inside(s: str) -> tuple[list[float], set[str]]:
    """Features of a candidate's own characters, and its separators."""
    digits = _NO_DIGIT.sub("", s)
    written = re.findall("[0-9]+", s)
    groups = [len(g) for g in written] or [0]
    seps = re.findall("[^0-9A-Za-z]+", s)
    words = re.findall("[A-Za-z]+", s)
    dates = re.search(r"\b(19|20)[0-9]{2}[-./][01]?[0-9][-./][0-3]?[0-9]\b|\b[0-3]?[0-9][-./][01]?[0-9][-./](19|20)[0-9]{2}\b", s)
    return [
        len(s), len(digits), len(groups), max(groups), min(groups), float(len(set(groups)) == 1), len(set(seps)), sum(map(len, seps)),
        float(len(digits) >= 12 and luhn(digits)), float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in written)),
        float(s[:1] == "+" or s[:2] == "00"), float(s[:1] in "0("), float("(" in s and ")" in s), float("@" in s), s.count(":"),
        len(words), float(bool(words) and words[-1].lower() in ("com", "org", "net", "de", "fr", "es", "io", "info", "example")), float(bool(re.search(r"[(\[{]\s?at", s, re.I))), float(bool(re.search(r"\sat\s", s, re.I))), float(bool(re.search(r"dot", s, re.I))),
        float(bool(dates)), len(set(digits)), int(digits[:1] or 0), groups[0], groups[-1],
    ], set(seps)


@lru_cache(maxsize=4096)
def _before(before: str) -> tuple[list[float], int, str]:
    """Features of what stands before, and the length of a number there and what parts it from the candidate."""
    near = set(re.findall(r"[\w-]+", before.lower())[-4:])
    left = re.search(r"([0-9]+)([\x20()./_-]{1,2})$", before)
    return [
        float(bool(re.search(r"[0-9A-Za-z_.]$", before))), float(bool(re.search(r"[$€£#]\s?$", before))),
        *(float(bool(near & set(CUES[k]))) for k in (*KINDS, "other")),
    ], len(left[1]) if left else 0, left[2] if left else ""


@lru_cache(maxsize=4096)
def _after(after: str) -> tuple[list[float], int, str]:
    """The same of what stands behind."""
    right = re.match(r"([\x20()./_-]{1,2})([0-9]+)", after)
    return [float(bool(re.match("[0-9A-Za-z_]", after))), float(bool(re.match(r"[.,:-][0-9]", after)))], len(right[2]) if right else 0, right[1] if right else ""


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    (own, seps), (left, n_left, part_left), (right, n_right, part_right) = _inside(text[a:b]), _before(text[max(0, a - 32) : a]), _after(text[b : b + 12])
    return [*(float(kind == k) for k in KINDS), *own, *left, *right, n_left, float(part_left in seps), n_right, float(part_right in seps)]


def _planted(rng: random.Random) -> tuple[str, str]:
    """A kind ("" for a look-alike) and its text."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice(("an", "ter", "lo", "mi", "re", "sol", "ka", "ed")) for _ in range(rng.randint(2, 4)))
    top = rng.choice(("com", "org", "net", "de", "fr", "es", "io", "edu", "co", "it", "eu", "app", "gov", "ch", "nl"))
    kind = rng.choice((*KINDS, "", "", "", ""))
    if kind == "email":
        o, c, i = *rng.choice(("()", "[]", "{}")), rng.choice(("", "", " "))
        at, dot = rng.choice((("@", "."), (f" {o}at{c} ", "."), (f"{i}{o}at{c}{i}", f"{i}{o}dot{c}{i}"), (f"{o}{i}at{i}{c}", "."), (" at ", " dot "), (f"{i}{o}at{c}{i}", ".")))
        if rng.random() < 0.25:
            at, dot = at.upper(), dot.upper()
        return kind, f"{w()}{rng.choice(('', '.' + w(), d(2), '_' + w(), '-' + w()))}{at}{w()}{rng.choice(('', '', dot + w(), '-' + w()))}{dot}{top}"
    if kind == "ip":
        if rng.random() < 0.4:
            return kind, rng.choice((".", " . ")).join(str(rng.randint(1, 255)) for _ in range(4))
        group = lambda: rng.choice((f"{rng.randrange(65536):x}", f"{rng.randrange(65536):04x}", f"{rng.randrange(4096):x}", "0", "0000"))
        return kind, ":".join([rng.choice((f"2{d(3)}", "fe80", "2001", f"{rng.randrange(65536):x}")), *(group() for _ in range(7))])
    if kind == "card":
        n = rng.choice((15, 15, 16, 16, 16))
        body = rng.choice("3456") + d(n - 2)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(("", " ", "-", ".", "/", "_"))
        return kind, sep.join((body[:4], body[4:10], body[10:]) if n == 15 and rng.random() < 0.7 else (body[i : i + 4] for i in range(0, n, 4)))
    if kind == "phone":
        if rng.random() < 0.5:  # national numbers: a leading 0 and groups, by one separator or with another behind the first group
            sizes = rng.choice(((2, 2, 2, 2, 2), (3, 4, 4), (3, 3, 4), (4, 6), (4, 7), (5, 6), (3, 7), (3, 8), (4, 3, 4), (3, 2, 2, 2), (4, 2, 2, 2), (3, 3, 2, 2), (3, 2, 2, 2, 2)))
            body, sep = "0" + d(sum(sizes) - 1), rng.choice((" ", "-", ".", "/"))
            groups = [body[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes))]
            first = rng.choice((sep, sep, "/", " "))
            rest = sep if sep != "/" else rng.choice((" ", "/"))
            return kind, rng.choice((f"{groups[0]}{first}{rest.join(groups[1:])}", f"({groups[0]}) {rest.join(groups[1:])}"))
        return kind, rng.choice((f"+{rng.randint(1, 99)} {d(3)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"00{rng.randint(30, 59)} {d(2)} {d(4)} {d(4)}", f"00{rng.randint(30, 59)} {d(1)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"))
    return "", rng.choice((
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1990, 2030)}",
        lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 999)}", lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}", lambda: f"order {d(rng.randint(8, 18))}", lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 32, 40)))), lambda: f"pages {d(3)}-{d(3)}", lambda: " ".join(str(rng.randint(1900, 2030)) for _ in range(4)), lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}{rng.choice(' T')}{rng.randint(0, 23):02}:{d(2)}:{d(2)}", lambda: f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1990, 2030)} {rng.choice(('', '- '))}{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1990, 2030)}",
        lambda: rng.choice((" ", ", ", "-", ".")).join(str(i) for i in range(rng.randint(0, 3), rng.randint(8, 24))), lambda: ":".join(f"{rng.randrange(256):02x}" for _ in range(6)),
        lambda: f"{rng.choice(('', 'room ', 'lines ', 'pages '))}{', '.join(str(rng.randint(1, 255)) for _ in range(rng.randint(3, 6)))}",
        lambda: "-".join((d(4), d(4))), lambda: f"{rng.randint(0, 40)}-{rng.randint(0, 40)}, {rng.randint(0, 40)}-{rng.randint(0, 40)}, {rng.randint(0, 40)}-{rng.randint(0, 40)}", lambda: f"0.{d(rng.randint(4, 7))} 0.{d(rng.randint(4, 7))}", lambda: " ".join(str(rng.randint(1, 999)) for _ in range(rng.randint(4, 9))), lambda: " ".join((d(2), *[rng.choice(("000", d(3))) for _ in range(3)])),
        lambda: f"{w()} at {w()}. {w().title()}", lambda: f"{w()} at the dot of {w()}", lambda: f"{d(4)} {d(4)} {d(4)} {d(3)}", lambda: f"{d(1)} {d(2)} {d(1)} {d(3)} {d(2)}", lambda: f"id {d(rng.randint(7, 12))}", lambda: f"{d(3)}, {d(2)}, {d(3)}, {d(2)}",
    ))()


def synthetic(n: int = TRAIN_SENTENCES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of the candidates in `n` seeded sentences."""
    rng = random.Random(seed)
    filler = ("the", "of", "and", "erin", "thanor", "de", "la", "queda", "der", "einung", "onthe", "at", "was", "heron", "to")
    rows, labels, kinds = [], [], []
    for _ in range(n):
        kind, span = _planted(rng)
        cue = f"{rng.choice(CUES[kind or rng.choice((*KINDS, 'other'))])}{rng.choice(('', ':', '.'))} " if rng.random() < (0.6 if kind else 0.25) else ""
        left = " ".join(rng.choice(filler) for _ in range(rng.randint(0, 8)))
        if kind == "card" and rng.random() < 0.2:
            left += " " + "".join(rng.choice("0123456789") for _ in range(16))
        if kind in ("card", "phone") and rng.random() < 0.2:  # in lists and tables, numbers stand side by side
            cue += "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 4))) + rng.choice((" ", " - ", ". "))
        right = rng.choice((" ", ". ", ", ", "")) + " ".join(rng.choice(filler) for _ in range(rng.randint(0, 6)))
        text = f"{left} {cue}"
        a, b, text = len(text), len(text) + len(span), text + span + (right if right[:1] in " .," else " " + right)
        for k, x, y in candidates(text, _covered(text, base_spans(text))):  # only what the base leaves is ever judged
            overlap = max(0, min(b, y) - max(a, x))
            rows.append(features(text, k, x, y))
            labels.append(float(kind == k and overlap / (max(b, y) - min(a, x)) >= 0.85))
            kinds.append(KINDS.index(k))
    return np.array(rows, float), np.array(labels), np.array(kinds)


@lru_cache(maxsize=1)
def trained(precision: float = PRECISION) -> dict:
    """Trees on three quarters of the synthetic candidates; calibration and thresholds on the rest."""
    x, y, kinds = synthetic()
    held = np.arange(len(y)) % 4 == 3
    model = fit_gbt(x[~held], y[~held], trees=90, depth=5)
    margin = gbt_margin(model, x[held])
    curve = fit_isotonic(margin, y[held])
    p, thresholds = isotonic(curve, margin), {}
    for i, k in enumerate(KINDS):
        of = kinds[held] == i
        scores, truth = p[of], y[held][of]
        ok = [t for t in np.unique(scores) if truth[scores >= t].mean() >= precision]
        thresholds[k] = float(max(0.5, min(ok))) if ok else 2.0
    return {"gbt": model, "curve": curve, "thresholds": thresholds}


def spans(texts: list[str], model: dict) -> list[tuple[list, list]]:
    """For each text the base spans and the added ones, (kind, start, end, score) each."""
    rows, where, chosen, taken = [], [], [], {}
    out = []

    def judge() -> None:
        margin = gbt_margin(model["gbt"], np.array(rows, float))
        p = isotonic(model["curve"], margin)
        chosen.extend((score, m, w) for score, m, w in zip(p.tolist(), margin.tolist(), where, strict=True) if score >= model["thresholds"][w[1]])
        rows.clear()
        where.clear()

    for i, t in enumerate(texts):
        base = base_spans(t)
        out.append(([(*s, 1.0) for s in base], []))
        covered = _covered(t, base)
        proposed = candidates(t, covered)
        if proposed:
            taken[i] = covered
        for k, a, b in proposed:
            rows.append(features(t, k, a, b))
            where.append((i, k, a, b))
            if len(rows) >= AT_ONCE:
                judge()
    if rows:
        judge()
    for score, _, (i, k, a, b) in sorted(chosen, key=lambda r: (-r[0], -r[1], r[2])):  # the likelier, by the margin within a step of the curve
        if 1 not in taken[i][a:b]:
            taken[i][a:b] = b"\1" * (b - a)
            out[i][1].append((k, a, b, score))
    return out


def _ordered(found: list[tuple]) -> list[tuple]:
    return sorted(found, key=lambda s: (_RANK[s[0]], s[1], s[2]))


def redacted(text: str, found: list[tuple]) -> str:
    """The text with each span, or each union of overlapping spans, replaced by its first kind in brackets."""
    parts, at = [], 0
    for k, a, b, *_ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def detect(df: DataFrame, key: str, text: str, model: dict | None = None) -> DataFrame:
    """`key`, `spans` (kind, start, end, score; base spans have score 1) and the `redacted` text (null stays null)."""
    model = model or trained()

    def make():
        def work(keys, texts):
            found = [_ordered(base + added) for base, added in spans([t or "" for t in texts], model)]
            clean = [None if t is None else redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            return [keys, [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found], clean]

        return work

    kind = df.schema[key].dataType.simpleString()
    return map_columns(df.select(F.col(key).alias("key"), F.col(text).cast("string")), make, f"key {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>, redacted string").withColumnRenamed("key", key)


def redact_column(df: DataFrame, text: str, model: dict | None = None) -> DataFrame:
    """`df` with all spans in its column `text` replaced by their kind in brackets; null stays null."""
    model = model or trained()

    def make():
        def work(texts):
            found = spans([t or "" for t in texts], model)
            return [t if t is None or not (base or added) else redacted(t, base + added) for t, (base, added) in zip(texts, found, strict=True)]

        return work

    return with_column(df, text, "string", text, make)


def digest(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Counts and hash of the base spans, and all spans as a string; texts don't leave the task."""
    model = model or trained()

    def make():
        write = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in _ordered(found))

        def work(ids, texts):
            found = spans([t or "" for t in texts], model)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
            return [ids, *counts, [hashlib.sha256(write(base).encode()).hexdigest() for base, _ in found], [write(base + added) for base, added in found]]

        return work

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op2_pii_boosted(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
