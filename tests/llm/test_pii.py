"""Personal data against the patterns as the contract writes them, and the bootstrapping against dictionaries in plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hypotree.llm import pii, queries

DIR = "/root/testdata/sf0.001"
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _base(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, k != 1 or all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and _luhn(digits), 9 <= len(digits) <= 15)
            if good[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _told(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


TEXTS = [
    "", "no data here", "a@b.c_x@d.e", "x@y@z.org and q@r", ".@-.a@b.c.d. e%f@g-h.i..j", "1.2.3.4.5.6.7.8", "1.2.3.4.256.1.1.1.9.9.9.9", "0001.02.003.255 and 300.1.1.1", "1..2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5500 0000 0000 0004", "411111111111111", "card 4111  1111 1111 1111", "+49 (030) 123-4567", "+1 2", "+1 23456789", "++49 30 1234567+1 (555) 555-0100)",
    "ü4111111111111111é漢+493012345678漢a@b.de", "1" * 30, "token = \"4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e\"", "+1.2.3.4.5.6.7.8.9.0", "2001:db8:0:0:8:800:200C:417A ::1 12:30:45", "jane(at)x.org, joe [AT] mail [dot] com",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_is_that_of_the_patterns(text):
    assert pii.base_spans(text) == _base(text)


def test_base_on_random_strings():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@+- (9)é2%_" if rng.random() < 0.9 else "4111111111111111") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == _base(text), text
        found = [(a, a, b) for a, b, _ in pii.candidates(text, pii.base_spans(text))] + pii.base_spans(text)[:0]
        assert all(x[2] <= y[0] for x, y in zip(found, found[1:]))
        assert all(b <= c or d <= a for a, _, b in found for c, _, d in _base(text))


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "a@", "+1 ", ":", "a.b@", "(at)", "1:", "é1"])
def test_long_texts_take_time_in_proportion(unit):
    began = time.process_time()
    text = unit * (400_000 // len(unit))
    pii.candidates(text, pii.base_spans(text))
    assert time.process_time() - began < 8


def _made():
    """Cues that seeds share with strings of other forms, beside words that say nothing."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = []
    for i in range(60):
        rows.append(f"{some(9)} Tel: +49 30 {number(7)} {some(5)}.")
        rows.append(f"{some(4)} reached at u{i}@mail{i}.example.org by post {some(6)}")
        rows.append(f"{some(5)} host address {i}.{i + 1}.0.{i} is up {some(4)}")
    rows += [f"{some(3)} Tel: 030 {number(7)} {some(2)}" for _ in range(9)] + [f"{some(3)} reached at jane{i} (at) corp.example by post" for i in range(4)]
    rows += [f"{some(3)} host address 300.1.{i}.9 is up", "seen: 300.1.1.9 " + some(4), f"order {number(8)} of {some(3)}", f"{some(2)} {number(16)} {some(2)}", "kept 030 7777777 apart"]
    rows += [f"{some(6)} version 2.0.{i} of {some(3)}" for i in range(20)] + [f"phone {number(9)} or Tel: {number(9)} {some(2)}" for _ in range(6)] + [f"phone {number(9)} now" for _ in range(3)]
    rows += [rows[0]] * 40 + [f"{some(2)} Tel: {some(3)}" for _ in range(5)] + [None, ""]
    return [(i // 2, t) for i, t in enumerate(rows)] + [(None, "Tel: 030 5555555")]


def _bootstrapped(texts, support=3, sure_pattern=500, sure_instance=700, rounds=3):
    """(start, kind, end) added to each text."""
    token = re.compile(r"\w+|[^\w\s]")
    each, count = [], collections.Counter()
    for n, text in enumerate(texts):
        base = _base(text)
        words = [t.lower() for t in token.findall(text)]
        count.update((w,) for w in words)
        count.update(zip(words, words[1:]))
        for a, k, b, bits in [(a, k, b, 1 << k) for a, k, b in base] + [(a, None, b, bits) for a, b, bits in pii.candidates(text, base)]:
            left, right = ([t.lower() for t in token.findall(x)] for x in (text[:a], text[b:]))
            grams = [tuple(left[-1:]), tuple(left[-2:]) if len(left) > 1 else (), tuple(right[:1]), tuple(right[:2]) if len(right) > 1 else ()]
            each.append((n, a, k, b, bits, text[a:b].lower(), [(s, g) for s, g in enumerate(grams) if g and all(len(t) <= 40 for t in g)]))
    seed, kinds, has, seen = collections.defaultdict(int), collections.defaultdict(int), collections.defaultdict(set), collections.Counter()
    for *_, k, _, bits, value, grams in each:
        seed[value] |= bits if k is not None else 0
        kinds[value] |= bits
        for p in grams:
            has[p].add(value)
            seen[p] += 1
    has = {p: v for p, v in has.items() if len(v) >= support}
    fillers = {p: len(v) + max(count[p[1]] - seen[p], 0) for p, v in has.items()}
    found = {}
    for _ in range(rounds):
        sure = {}
        for p, v in has.items():
            for k in range(4):
                known = sum(1000 if seed[x] >> k & 1 else found[x][1] if not seed[x] and x in found and found[x][0] == k else 0 for x in v)
                if known >= support * 1000 and known // (fillers[p] + 1) >= sure_pattern:
                    sure[p, k] = known // (fillers[p] + 1)
        now = {}
        for x in (x for x in kinds if not seed[x]):
            scores = []
            for k in range(4):
                if kinds[x] >> k & 1:
                    l, r = (max([c for (p, q), c in sure.items() if q == k and (p[0] < 2) == left and x in has[p]], default=0) for left in (True, False))
                    scores.append((1000 - (1000 - l) * (1000 - r) // 1000, -k))
            if scores and max(scores)[0] >= sure_instance:
                now[x] = (-max(scores)[1], max(scores)[0])
        found = now
    added = [[] for _ in texts]
    for n, a, k, b, _, value, _ in each:
        if k is None and value in found:
            added[n].append((a, found[value][0], b))
    return added


def test_bootstrapping_is_as_by_dictionaries(spark):
    rows = _made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gram": F.lit(1), "value": F.lit("x"), "mentions": F.lit(2)}).repartition(5)
    found = pii.find(docs).select("doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("added")).alias("added"))
    texts = [t or "" for _, t in rows]
    told = [(k, _told(_base(t)), _told(more)) for (k, _), t, more in zip(rows, texts, _bootstrapped(texts))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(told, key=repr)
    new = [(texts[n][a:b], pii.KINDS[k]) for n, more in enumerate(_bootstrapped(texts)) for a, k, b in more]
    assert any(k == "phone" and t.startswith("030") for t, k in new) and any(k == "ip" and t.startswith("300.") for t, k in new) and any("(at)" in t for t, _ in new)
    assert ("030 7777777", "phone") not in new and not any("2.0." in t for t, _ in new)  # no context speaks for these


def test_occurrences_are_exact_however_small_the_filter(spark):
    docs = spark.createDataFrame([("a b a b c",), ("A  b.",), (None,), ("",), ("x" * 41 + " a b",)], "text string").repartition(2)
    h = {t: pii.token_hash(t) for t in "abcz"}
    grams = {pii._signed(h["a"]): 4, pii._grams(h["a"], h["b"]): 4, pii._grams(h["b"], h["a"]): 1, pii._signed(h["z"]): None}
    for log_words in (0, 4, 18):
        found = pii.occurrences(docs, spark.createDataFrame([(g,) for g in grams], "gram long"), log_words=log_words)
        assert {r.gram: r.n for r in found.collect()} == {g: n for g, n in grams.items() if n}


def test_query(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    added = _bootstrapped([r.text or "" for r in rows])
    df = queries.queries()["op12_pii"](spark, DIR)
    assert df.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    told = []
    for r, more in zip(rows, added):
        base = _base(r.text or "")
        told.append((r.doc_id, *[sum(k == x for _, k, _ in base) for x in range(4)], hashlib.sha256(_told(base).encode()).hexdigest(), _told(base + more)))
    assert sorted(tuple(r)[:7] for r in df.collect()) == sorted(told)


def test_nothing(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert pii.find(spark.createDataFrame([(1, "no data")], "doc_id long, text string")).collect() == [(1, [], [])]
