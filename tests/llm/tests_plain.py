"""Plain versions that several tests hold results against."""

import re

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def _right(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def pii_spans(t):
    return [(kind, m.start(), m.end()) for kind in PII for m in re.finditer(PII[kind], t or "", re.A) if _right(kind, m[0])]


def targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Water filling of 1.5 times all sizes, by weight in order of code point, null last, up to twice a source's size."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else w[s] * level for s in names}
        full |= set(over)
