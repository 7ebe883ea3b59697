"""Learned operators: brute force where the contract fixes values, held-out figures elsewhere."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures import RAW, documents
from pyspark.sql import functions as F

from flowloom.llm import language, lm, pii, quality
from flowloom.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


# -- quality classifier


def test_label_model_finds_accuracies():
    """Votes drawn from known accuracies: EM gets them back, and one unreliable heuristic isn't trusted."""
    rng = np.random.default_rng(5)
    n, m = 40_000, len(quality.HEURISTICS)
    good = rng.random(n) < 0.8
    way = rng.integers(0, len(quality.ANCHORS), n)
    votes = np.full((n, m), quality.GOOD)
    for j in range(m):
        hit = np.where(good, rng.random(n) < 0.01, (way == j) & (rng.random(n) < 0.95) if j in quality.ANCHORS else rng.random(n) < 0.7)
        votes[hit, j] = quality.BAD
        votes[rng.random(n) < 0.2, j] = quality.NONE
    patterns, at, counts = np.unique(votes @ 3 ** np.arange(m - 1, -1, -1), return_inverse=True, return_counts=True)
    model = quality.fit_label_model(patterns, counts)
    assert abs(model.share[0] - 0.8) < 0.03
    assert np.abs(model.table[0, :, quality.BAD] - 0.01).max() < 0.02
    assert ((model.posterior(patterns)[at] > 0.5) == good).mean() > 0.95


def test_quality_against_labels(spark):
    labels = pq.read_table(f"{LARGER}/labels.parquet").to_pylist()
    got = {r["doc_id"]: r for r in QUERIES["op1_quality_classifier"](spark, LARGER).collect()}
    assert len(got) == 1000
    table = Counter((x["quality"], got[x["doc_id"]]["keep"]) for x in labels)
    assert table[1, True] >= 0.99 * (table[1, True] + table[1, False])
    assert table[0, False] >= 0.9 * (table[0, True] + table[0, False])


def test_quality_messy(messy, empty):
    got = quality.classify(messy).collect()
    assert len(got) == len(RAW)
    for r in got:
        assert 0 <= r["score"] <= 1 and len(r["votes"]) == len(quality.HEURISTICS) and set(r["votes"]) <= set("b-g")
        if r["doc_id"] in (4, 5, 6):
            assert r["score"] == 0 and not r["keep"]
    kept = quality.keep_good(messy)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["keep"])
    assert quality.classify(empty).collect() == [] and quality.keep_good(empty).collect() == []


@pytest.mark.parametrize("texts", [["one text and no other " * 20], ["a b c", "d e f " * 30], [None]])
def test_quality_of_repeated_rows(spark, texts):
    """Far more rows than are drawn, hardly any distinct text among them."""
    docs = spark.range(24_000).selectExpr("id AS doc_id", f"element_at(array({', '.join('NULL' if t is None else repr(t) for t in texts)}), CAST(id % {len(texts)} AS INT) + 1) AS text")
    got = quality.classify(docs.withColumn("text", docs["text"].cast("string")), fit_rows=10_000)
    scores = {r["score"] for r in got.select("score").distinct().collect()}
    assert got.count() == 24_000 and len(scores) <= len(texts) and all(0 <= s <= 1 for s in scores)


# -- language identification


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 40])
def test_codebook(n):
    code = language.codebook(n)
    assert code.shape[0] == n and (np.abs(code.sum(axis=0)) < n).all()
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 4)


def test_language_held_out(spark):
    got = QUERIES["op5_language_id"](spark, LARGER).collect()
    lang = {d: x for d, _, x, _ in documents(LARGER)}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_messy(messy, empty, spark):
    got = language.identify(messy).collect()
    assert len(got) == len(RAW)
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (4, 5, 6)) and 0 <= r["score"] <= 1
    assert language.identify(empty).collect() == []
    plain = spark.createDataFrame([(1, "text", None), (2, "12 !", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(plain).orderBy("doc_id").collect()] == ["und", "und"]


# -- personal data

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TRICKY = [
    "a@b.c%d@e.f x@y x@y. x@y.z..w a.b_c+d@e-f.g-h.i@j.k _@_._ %@-.-",
    "1.2.3.4.5.6.7.8 1.2.3.256 001.002.0255.0 1.2.3 9.9.9.9.9 300.1.2.3.4.5.6",
    "4111 1111-1111 1111 4111111111111112 4111  1111 5500000000000004 6011000990139424-1 12345678901234567890",
    "+1 (799) 555-3729 +1 ( 2 +12 +123456789012345 +1234567890123456 ++4912345678. +49-30 123 456.+1 22 333 44",
    "é é 10.0.0.1 \U0001f600 mail: ß@x.y ß.a@x.y ",
    "digits 555 123 4567 or (555) 123-4567 and john (at) example (dot) com or jane[at]example.org",
    "9" * 5000 + " " + "a" * 20000 + "@" + "." * 3000 + "1." * 4000,
]


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check_base(rows, texts):
    for r in rows:
        spans = base_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (r, joined)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        found = [x for x in r["spans"].split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(found) and len(found) == len(spans) + r["n_added"]
        keys = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in found)]
        assert keys == sorted(keys)


def test_personal_data_tricky(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    check_base(pii.personal_data(df).collect(), dict(enumerate(TRICKY)))


def test_op7_against_regex(spark, sf):
    check_base(QUERIES["op7_personal_data"](spark, sf).collect(), {d: t for d, t, *_ in documents(sf)})


def test_personal_data_messy(messy, empty, spark):
    rows = pii.personal_data(messy).collect()
    assert len(rows) == len(RAW)
    check_base([r for r in rows if r["doc_id"] is not None], {i: t for i, t, *_ in RAW})
    assert pii.personal_data(empty).collect() == []


def test_boosting_adds_what_looks_alike(spark):
    """Sixteen digits with a wrong digit sum, in the place where cards stand, are added; those in a code are not."""
    import random

    rng = random.Random(2)
    texts, kinds = [], []
    for i in range(1500):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        wrong = body + str((int(card[-1]) + 5) % 10)
        kind = ("code", "card", "wrong")[1 + (i % 50 == 0)] if i % 3 else "code"
        kinds.append(kind)
        texts.append(
            f'the key "{wrong}" is set' if kind == "code" else f"paid by card {card if kind == 'card' else wrong} at noon"
        )
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    added = Counter(k for i, k in enumerate(kinds) if got[i]["n_added"])
    assert added["wrong"] > 0.8 * kinds.count("wrong") and not added["code"] and not added["card"]
    cut = {r["doc_id"]: r["text"] for r in pii.redact(df, spark.createDataFrame(list(got.values()))).collect()}
    assert all(cut[i] == ("paid by card [card] at noon" if got[i]["spans"] else texts[i]) for i in cut)


def test_boosting_adds_local_phones_and_obfuscated_emails(spark):
    """The extra generators' finds lead to redactions; groups of twelve digits don't, ordinary addresses count once."""
    import random

    rng = random.Random(7)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    forms = {
        "phone": lambda: f"call ({n(3)}) {n(3)}-{n(4)} at noon",
        "plus": lambda: f"call +1 ({n(3)}) {n(3)}-{n(4)} at noon",
        "email": lambda: f"write to a{n(3)} (at) example{n(2)} (dot) com. Then wait",
        "spaced": lambda: f"write to a{n(3)} @ example{n(2)}.com. Then wait",
        "plain": lambda: f"write at once to a{n(3)}@example{n(2)}.com and wait",
        "code": lambda: f"order {n(4)} {n(4)} {n(4)} is out",
    }
    kinds = [list(forms)[i % 6] for i in range(1800)]
    df = spark.createDataFrame([(i, forms[k]()) for i, k in enumerate(kinds)], "doc_id long, text string")
    found = pii.personal_data(df).collect()
    added = Counter(kinds[r["doc_id"]] for r in found if r["n_added"])
    assert all(added[k] > 0.9 * 300 for k in ("phone", "email", "spaced"))
    assert not added["plus"] and not added["plain"] and not added["code"]
    cut = {r["doc_id"]: r["text"] for r in pii.redact(df, spark.createDataFrame(found)).collect()}
    assert cut[0] == "call [phone] at noon" and cut[2] == cut[3] == "write to [email]. Then wait"


# -- language model


def slow_base(docs):
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        yield i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)


def test_op8_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op8_lm_scores"](spark, sf).collect()}
    want = list(slow_base([(d, t) for d, t, *_ in documents(sf)]))
    assert len(got) == len(want)
    for i, held, n, known, total, base in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def slow_scores(docs):
    """The mixture by dictionaries, with the library's own weights for the EM's binned events."""
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in docs}
    part = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in docs}

    def counts(keep):
        one, two = Counter(), Counter()
        for i, ws in tokens.items():
            if keep(part[i]):
                one.update(ws)
                two.update(zip([b"", *ws], ws, strict=False))
        return one, two, sum(one.values())

    one, two, n = counts(lambda p: p != 2)
    fit1, fit2, fit_n = counts(lambda p: p not in (2, 3))
    events = Counter()
    for i, ws in tokens.items():
        if part[i] == 3:
            for a, b in zip([b"", *ws], ws, strict=False):
                p2, p1 = fit2[a, b] / max(fit1[a], 1), fit1[b] / max(fit_n, 1)
                bucket = 0 if not fit1[a] else int(np.floor(np.log2(fit1[a]))) + 1
                bins = [0 if not p else min(int(1 + np.floor(-4 * np.log2(p))), lm.BINS - 1) for p in (p2, p1)]
                events[(bucket * lm.BINS + bins[0]) * lm.BINS + bins[1]] += 1
    weights = lm.learn_weights(np.array(list(events)), np.array(list(events.values())), len(one))
    assert np.allclose(weights.sum(axis=1), 1)
    for i, ws in tokens.items():
        total = 0.0
        for a, b in zip([b"", *ws], ws, strict=False):
            w = weights[0 if not one[a] else int(np.floor(np.log2(one[a]))) + 1]
            total += np.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / max(n, 1) + w[2] / (len(one) + 1))
        yield i, total


@pytest.mark.parametrize("words", [300, 1 << 20])
def test_mixture_against_dictionaries(spark, sf, monkeypatch, words):
    """Whatever the blocks, counts and scores are those of one dictionary. Workers are forked with the patched size."""
    docs = [(d, t) for d, t, *_ in documents(sf)][:60]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "BLOCK_WORDS", words)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(df).collect()}
    for i, s in slow_scores(docs):
        assert abs(got[i] - s) < 1e-6 * max(1, -s)


def test_weights_of_buckets_without_events():
    """A context that is counted over a power of two only in all training documents keeps its bigram."""
    good, poor = 3, 40  # bins of the bigram's and the unigram's probability
    code = np.array([(b * lm.BINS + good) * lm.BINS + poor for b in (4, 9)] + [poor])
    w = lm.learn_weights(code, np.array([900, 500, 100]), 1000)
    assert w[4, 0] > 0.9 and w[9, 0] > 0.9 and w[0, 0] < 0.01
    assert (w[5] == w[4]).all() and (w[8] == w[4]).all() and (w[lm.BUCKETS - 1] == w[9]).all()
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all()


def test_long_runs_cost_linear_time(spark):
    """A page of a.a.a. before a blank must not stall a task; what follows it is still found."""
    import time

    text = "a." * 200_000 + " x@ b@c.de.f%g@h.i and then a." + "1." * 1000 + "@k.l"
    df = spark.createDataFrame([(1, text), (2, "q@r.st")], "doc_id long, text string")
    begun = time.perf_counter()
    found = df.select(F.size(pii._candidates(F.col("text"))).alias("n"), "doc_id").collect()
    assert {r["doc_id"]: r["n"] for r in found}[2] == 1 and max(r["n"] for r in found) >= 3
    assert time.perf_counter() - begun < 30  # session start and code generation included; quadratic time takes an hour


def test_lm_messy(messy, empty, spark):
    got = lm.lm_scores(messy).collect()
    assert len(got) == len(RAW)
    base = defaultdict(list)
    for r in got:
        base[r["doc_id"]].append((r["n_tokens"], r["base_score"], r["score"]))
    assert base[4] == base[5] == base[6] and base[4][0][0] == 1 and len(set(base[3])) == 1
    assert lm.lm_scores(empty).collect() == []
    none = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")], "doc_id long, text string")
    r = lm.lm_scores(none).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == 0


def test_pack_round_trip():
    for a in (np.zeros(0, np.int64), np.array([1, 2**60, -3]), np.arange(5, dtype=np.uint8)):
        assert lm.unpack(lm.pack(a), len(a), a.dtype.str).tolist() == a.tolist()
