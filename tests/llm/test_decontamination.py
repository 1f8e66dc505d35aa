"""Decontamination against all pairs of windows in plain Python, and its recall on re-parameterised questions."""

import random
import re
from collections import defaultdict

import pytest

from docframe.llm import decontamination as op

NAMES = "Tom Ann Bob Eve Max Lea Sam Ida Paul Rosa".split()
UNITS = "kg km hours dollars miles".split()
QUESTIONS = [
    "N has # apples and buys # more. How many apples does N have now?",
    "N walks # U in the morning and # U at night. How far does N walk in # days?",
    "A train leaves at # and travels # U. N waits # U for it. When does it arrive?",
    "If N pays # U for # books, how much does M pay for # books?",
    "N and M share # sweets in the ratio # to #. How many does M get?",
    "Compute # times # minus #.",
    "What is # U + # U + # U - # U?",
    "N is # years old. M is # years older than N. How old will M be in # years?",
    "M sold # tickets on Monday, # on Tuesday and # on Friday. What did M earn at # U each?",
    "How long does N need for # pages at # pages an hour?",
]


def filled(rng, question):
    n, m = rng.sample(NAMES, 2)
    u = rng.choice(UNITS)
    return re.sub(r"\bN\b|\bM\b|\bU\b|#", lambda x: {"N": n, "M": m, "U": u}.get(x[0]) or str(rng.randrange(2, 900)), question)


def template(text, initial):
    """[kind, value, counts as a word], by the docstring's rules."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9]+", text)]
    out = []
    for i, (a, _, w) in enumerate(found):
        inner = i > 0 and not re.search(r'[\n!".:?]', text[found[i - 1][1] : a])
        kind = "word"
        if w.isdigit():
            kind = "number"
        elif i and found[i - 1][2].isdigit() and w.lower() in op.UNITS:
            kind = "unit"
        elif (inner or initial) and len(w) > 1 and w[0].isupper() and w[1:] == w[1:].lower():
            kind = "name"
        if out and kind in ("number", "name") and out[-1][0] == kind and (kind == "number" or inner):
            out[-1][1] += (w.lower(),)
        else:
            out.append([kind, (w.lower(),), kind == "word" or kind == "name" and not inner])
    return out


def windows(tokens, n, initial):
    """(what must be equal, place, width)"""
    for at in range(len(tokens) - n + 1):
        own = tokens[at : at + n]
        shape = lambda x: tuple(t[1] if t[0] == "word" else t[0] for t in x)
        words = sum(t[2] for t in own)
        if (8 * words >= 5 * n if n == op.WINDOW else words >= 3 and 2 * words >= n) and 2 * sum(t[0] == "word" for t in own) >= n:
            yield ("shape", initial, n, shape(own)), at, n
            continue
        yield ("values", initial, n, tuple((t[0], t[1]) for t in own)), at, n
        end, words = at, 0
        while end < len(tokens) and words < -(-5 * n // 8):
            words += tokens[end][0] == "word"
            end += 1
        if words >= -(-5 * n // 8) and end > at + n:
            yield ("shape", initial, 0, shape(tokens[at:end])), at, end - at


def leaks(docs, items):
    out = {}
    for initial in (False, True):
        parsed = {k: template(t, initial) for k, t in items.items()}
        sizes = {min(len(t), op.WINDOW) for t in parsed.values() if len(t) >= op.LEAST}
        for d, text in docs.items():
            tokens, at = template(text, initial), defaultdict(list)
            for n in sizes:
                for key, place, width in windows(tokens, n, initial):
                    at[key].append((place, width))
            for i, own in parsed.items():
                if len(own) < op.LEAST:
                    continue
                runs = defaultdict(set)
                for key, place, width in windows(own, min(len(own), op.WINDOW), initial):
                    for there, wide in at[key]:
                        runs[there - place].add((place, wide))
                for shift, found in runs.items():
                    covered = {p for place, width in found for p in range(place, place + width)}
                    pairs = {(own[p][0], own[p][1], tokens[p + shift][1]) for p in covered if own[p][0] != "word"}
                    strict, numbers = {x for x in pairs if x[0] != "number"}, {x for x in pairs if x[0] == "number"}
                    values = lambda x: len({y[:2] for y in x})
                    if len(covered) >= min(len(own), op.COVER) and len(strict) == values(strict) and len(numbers) <= 2 * values(numbers):
                        differs = any(a != b for _, a, b in pairs)
                        out[d, i] = out.get((d, i), True) and differs
    return out


def run(spark, docs, items):
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in op.leaks(frame, bench).collect()}


def prose(rng, n):
    return " ".join(rng.choice("the a of house river seven green walk over under long Light bell 12 7 Mary kg".split()) for _ in range(n)) + "."


@pytest.mark.parametrize("most", [op.BROADCAST_WINDOWS, 0])
def test_against_all_windows(spark, monkeypatch, most):
    monkeypatch.setattr(op, "BROADCAST_WINDOWS", most)
    rng = random.Random(1)
    items = {i: filled(rng, rng.choice(QUESTIONS)) for i in range(40)} | {100 + i: prose(rng, rng.randrange(3, 25)) for i in range(30)}
    docs = {}
    for d in range(150):
        parts = [prose(rng, rng.randrange(1, 20)) for _ in range(rng.randrange(3))]
        for _ in range(rng.randrange(3)):
            parts.append(rng.choice([filled(rng, rng.choice(QUESTIONS)), rng.choice(list(items.values())), prose(rng, 12)]))
        rng.shuffle(parts)
        if rng.random() < 0.3:  # a word goes somewhere
            words = " ".join(parts).split()
            parts = [w for w in words if rng.random() > 0.03]
        docs[d] = rng.choice([" ", "\n"]).join(parts)
    want = leaks(docs, items)
    assert run(spark, docs, items) == want and len(want) > 60


def test_recall_on_reparameterised_questions(spark):
    """Every question, with all names, numbers and units drawn anew, amid other text; other questions are no leaks."""
    rng = random.Random(2)
    items = {i: filled(rng, q) for i, q in enumerate(QUESTIONS)}
    docs = {10 * i + k: f"{prose(rng, 30)}\n{filled(rng, q)}\n{prose(rng, 30)}" for i, q in enumerate(QUESTIONS) for k in range(10)}
    found = set(run(spark, docs, items))
    right = {(d, d // 10) for d in docs}
    missed = sorted({i for _, i in right - found})
    assert len(found & right) >= 0.9 * len(right), missed
    assert not found - right
    copies = {i: f"{prose(rng, 30)} {t} {prose(rng, 30)}" for i, t in items.items()}
    assert {(i, i) for i in items} <= set(run(spark, copies, items))
