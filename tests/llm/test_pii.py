import random
import re

from quillspark.llm import pii as P

#: The contract's patterns, as given.
CONTRACT = {
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


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def plain(t):
    return [(k, m.start(), m.end()) for k, kind in enumerate(CONTRACT) for m in re.finditer(CONTRACT[kind], t or "", re.A) if ok(kind, m[0])]


def card(rng):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 7)))
    make = [
        lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: card(rng),
        lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: str(rng.randrange(10**rng.randrange(1, 18))), lambda: f"{rng.randrange(99)}-{rng.randrange(99)} {rng.randrange(9999)}",
        lambda: "a@b.c@d.e_f@g-h.ii", lambda: "1.2.3.4.5.6.7.8", lambda: "001.02.3.0255", lambda: "".join(rng.choice("0123456789.@+- ()ab") for _ in range(20)),
    ]
    rows = [" ".join(rng.choice(make)() if rng.random() < 0.2 else word() for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return [*rows, None, "", "@", "+", "1" * 3000, "1 " * 4000, "a" * 5000 + "@x.yz", "+1" + "(" * 3000, "x@y" + ".z" * 3000, "𝒳 a@b.cd 😀 1.1.1.1"]


def test_base_spans_equal_the_contract(spark):
    rows = list(enumerate(corpus()))
    got = P.find_personal_data(spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string"), ["doc_id"]).collect()
    assert len(got) == len(rows) + 1
    text = dict(rows)
    for r in got:
        base = [tuple(s) for s in r["base"]]
        assert base == plain(text[r["doc_id"]])
        spans = [tuple(s) for s in r["spans"]]
        assert spans == sorted(spans) and set(base) <= set(spans)
        for k, a, b in set(spans) - set(base):  # what the trees add touches nothing else
            assert a < b <= len(text[r["doc_id"]]) and all(b <= x or y <= a for j, x, y in spans if (j, x, y) != (k, a, b))


def test_the_trees_add_loose_formats_and_leave_look_alikes(spark):
    """Trained on a corpus of base formats and plain numbers alone; planted formats are never in it."""
    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    byte = lambda: str(rng.randrange(1, 255))
    four = lambda d, by: by.join(d[i : i + 4] for i in range(0, 16, 4))
    near = lambda: next(c for c in iter(lambda: digits(16), None) if not luhn(c))
    cue = lambda w: w if rng.random() < 0.5 else name()
    known = [
        lambda: f"{cue('write to')} {rng.choice([name() + '.' + name(), name()])}@{rng.choice([name() + '.example.com', name() + '.com'])}", lambda: f"{cue('host')} {'.'.join(byte() for _ in range(4))} is", lambda: f"{cue('card')} {card(rng)} then",
        lambda: f"{cue('call')} +1 ({rng.randrange(200, 999)}) 555-{digits(4)} or", lambda: f"on {rng.randrange(10, 28)}.10.2019 and", lambda: f"id {digits(rng.randrange(4, 17))} of", lambda: f"part {digits(3)}-{digits(2)}-{digits(2)} in", lambda: f"version {byte()}.{digits(1)}.{digits(1)}.{digits(4)} of",
    ]
    rows = [f"{name()} {rng.choice(known)()} {name()}" for _ in range(3000)]
    right = [
        (0, lambda: f"{name()} (at) {name()} (dot) com"), (0, lambda: f"{name()}.{name()}[at]{name()}.example.org"), (1, lambda: "[.]".join(byte() for _ in range(4))),
        (2, lambda: four(card(rng), ".")), (2, lambda: four(card(rng), "- ")), (3, lambda: f"001 (7{digits(2)}) 555-{digits(4)}"), (3, lambda: f"1.{rng.randrange(200, 999)}.555.{digits(4)}"),
    ]
    look_alike = [lambda: f"{rng.randrange(10, 28)}-12-{digits(2)}", lambda: four(near(), "."), lambda: f"{byte()}[.]{byte()}[.]{byte()}[.]{rng.randrange(300, 999)}", lambda: f"{digits(2)}/{digits(2)}/{digits(3)}"]
    first, want = len(rows), {}
    for _ in range(25):
        for k, f in right:
            text = f()
            want[len(rows)] = (k, 6, 6 + len(text))
            rows.append(f"about {text} and")
    lower = len(rows)
    for _ in range(100):
        rows += [f"about {f()} and" for f in look_alike]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    added = {}
    for r in P.find_personal_data(df, ["doc_id"]).collect():
        assert [tuple(s) for s in r["base"]] == plain(rows[r["doc_id"]])
        if extra := set(map(tuple, r["spans"])) - set(map(tuple, r["base"])):
            added[r["doc_id"]] = extra
    hit = sum(bool({(a, b) for _, a, b in added.get(i, ())} & {s[1:]}) for i, s in want.items())
    false = sum(i < first or i >= lower for i in added)
    print("added", len(added), "right", hit, "of", len(want), "false", false, [rows[i] for i in added if i < first or i >= lower][:9])
    assert hit >= 0.8 * len(want) and hit / (hit + false) >= 0.9


def test_many_matches_in_one_text_take_linear_time(spark):
    import time

    began = time.time()
    text = "\n".join(f"GET 10.{i % 256}.{i // 256 % 256}.7 a{i}(at)x(dot)yz" for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = P.find_personal_data(df, ["doc_id"]).collect()[0]
    assert len(r["base"]) == 50_000 and [tuple(x) for x in r["base"]] == plain(text)
    assert P.redact_documents(df).collect()[0]["text"].count("[IP]") == 50_000
    assert time.time() - began < 120


def test_redaction_and_edges(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4.", "x"), (1, "mail a@b.cd or 1.2.3.4.", "x"), (2, None, "y"), (None, "", "z"), (3, "𝒳 a@b.cd😀 +4111 1111 1111 1111 é", "w")], "doc_id bigint, text string, spans string")
    got = sorted((r["spans"], r["text"]) for r in P.redact_documents(df).collect() if r["doc_id"] != 2)
    assert got == [("w", "𝒳 [EMAIL]😀 +[CARD] é"), ("x", "mail [EMAIL] or [IP]."), ("x", "mail [EMAIL] or [IP]."), ("z", "")]
    assert [r["text"] for r in P.redact_documents(df).collect() if r["doc_id"] == 2] == [None]
    assert P.find_personal_data(df.where("false"), ["doc_id"]).collect() == []


def test_trees_and_thresholds_see_all_examples(spark, monkeypatch):
    """More right examples than any bound of a sample: all are fitted on, and both halves are scored by the other's trees."""
    rows = [(i, " ".join(f"host 10.{i % 250}.{k}.{(i * 7 + k) % 250} is" for k in range(40))) for i in range(300)]
    seen, real = [], P.GBTClassifier

    class Counted(real):
        def fit(self, dataset, params=None):
            seen.append(dataset.where("label = 1").count())
            return super().fit(dataset, params)

    monkeypatch.setattr(P, "GBTClassifier", Counted)
    got = P.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()
    assert sum(len(r["base"]) for r in got) == 12_000
    assert seen[:2] == [12_000, 12_000] and sum(seen[2:]) == 12_000 and len(seen) == 4
