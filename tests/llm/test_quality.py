from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexarium.llm import quality_model, quality_rules

from .helpers import ODD, documents, prose


def test_sum_of_squares_identity():
    machine = quality_model.Machine()
    r = np.random.default_rng(0)
    machine.w = r.normal(size=quality_model.WIDTH).astype(np.float32)
    first, index, value = quality_model.features(pa.array(["a b c a", None, "x\ny"]), pa.array(["en", None, "de"]), pa.array([None, "s", "t"]))
    got = machine.score(first, index, value)
    for d in range(3):
        i, x = index[first[d] : first[d + 1]], value[first[d] : first[d + 1]].astype(float)
        v = machine.v[i].astype(float)
        z = float(machine.w[i] @ x) + sum(float(v[a] @ v[b]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(got[d] - 1 / (1 + np.exp(-z))) < 1e-4


def small_problem(rows=40):
    r = np.random.default_rng(2)
    count = r.integers(3, 9, rows)
    first = np.concatenate([[0], np.cumsum(count)])
    index = np.concatenate([r.choice(30, n, replace=False) for n in count]).astype(np.int32)
    return first, index, r.normal(size=len(index)).astype(np.float32), r.random(rows) < 0.4


def plain_loss(w0, w, v, first, index, value, rows, good, weight):
    """Mean weighted log loss of some rows, pair by pair."""
    total = 0.0
    for d in rows:
        i, x = index[first[d] : first[d + 1]], value[first[d] : first[d + 1]].astype(float)
        z = w0 + w[i] @ x + sum(v[i[a]] @ v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        total += weight[d] * (np.log1p(np.exp(-z)) if good[d] else np.log1p(np.exp(z)))
    return total / len(rows)


def test_fit_against_finite_differences(monkeypatch):
    """The first step of every weight is that of AdaGrad on a gradient taken by differences of the plain loss."""
    first, index, value, good = small_problem()
    monkeypatch.setattr(quality_model, "DECAY", 0.0)
    monkeypatch.setattr(quality_model, "BATCH", len(good))
    machine, before = quality_model.Machine(), quality_model.Machine()
    machine.fit(first, index, value, good, epochs=1)
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    w, v = before.w.astype(float), before.v.astype(float)
    loss = lambda w0, w, v: plain_loss(w0, w, v, first, index, value, range(len(good)), good, weight)
    step = lambda g: -quality_model.RATE * g / np.sqrt(1e-3 + g**2)

    def slope(put):
        return (loss(*put(1e-5)) - loss(*put(-1e-5))) / 2e-5

    assert abs(machine.bias - step(slope(lambda e: (e, w, v)))) < 1e-4
    for i in range(0, 30, 3):
        def moved(e, i=i):
            x = w.copy()
            x[i] += e
            return 0.0, x, v

        assert abs(float(machine.w[i] - before.w[i]) - step(slope(moved))) < 2e-4
        for f in (0, quality_model.FACTORS - 1):
            def turned(e, i=i, f=f):
                x = v.copy()
                x[i, f] += e
                return 0.0, w, x

            assert abs(float(machine.v[i, f] - before.v[i, f]) - step(slope(turned))) < 2e-4


def test_fit_against_a_plain_loop():
    """Several epochs of mini-batches, feature by feature."""
    first, index, value, good = small_problem(150)
    machine = quality_model.Machine()
    machine.fit(first, index, value, good, epochs=2)
    start = quality_model.Machine()
    w, v, w0 = start.w[:30].astype(float), start.v[:30].astype(float), 0.0
    gw, gv, gb = np.full(30, 1e-3), np.full((30, quality_model.FACTORS), 1e-3), 1e-3
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    for epoch in range(2):
        order = np.random.Generator(np.random.PCG64(epoch)).permutation(len(good))
        for at in range(0, len(order), quality_model.BATCH):
            rows = order[at : at + quality_model.BATCH]
            dw, dv, db, seen = np.zeros(30), np.zeros_like(v), 0.0, set()
            for d in rows:
                i, x = index[first[d] : first[d + 1]], value[first[d] : first[d + 1]].astype(float)
                z = w0 + w[i] @ x + sum(v[i[a]] @ v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
                slope = weight[d] * (1 / (1 + np.exp(-z)) - good[d]) / len(rows)
                db += slope
                for a in range(len(i)):
                    dw[i[a]] += slope * x[a]
                    dv[i[a]] += slope * x[a] * sum(v[i[b]] * x[b] for b in range(len(i)) if b != a)
                    seen.add(int(i[a]))
            for i in seen:
                dw[i] += quality_model.DECAY * w[i]
                dv[i] += quality_model.DECAY * v[i]
                gw[i] += dw[i] ** 2
                gv[i] += dv[i] ** 2
                w[i] -= quality_model.RATE * dw[i] / gw[i] ** 0.5
                v[i] -= quality_model.RATE * dv[i] / gv[i] ** 0.5
            gb += db**2
            w0 -= quality_model.RATE * db / gb**0.5
    assert np.allclose(machine.w[:30], w, atol=2e-3) and np.allclose(machine.v[:30], v, atol=2e-3) and abs(machine.bias - w0) < 2e-3


def test_repeated_rows_are_rated_one_by_one(spark):
    texts = [prose(i, 60) for i in range(12)]
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    twice = docs.union(docs.filter("doc_id < 3")).union(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("bigint")))
    for judge in (lambda d: quality_model.rated(d, labels), quality_rules.judged):
        ids = [r["doc_id"] for r in judge(twice).collect()]
        assert len(ids) == 16 and [ids.count(i) for i in (0, 1, 2, 3, None)] == [2, 2, 2, 1, 1]


def test_held_out_accuracy(spark):
    texts = [prose(i, 120) if i % 2 else "BUY NOW!!! $$$ " * 12 + prose(i, 40).upper() for i in range(240)] + ODD
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_model.rated(docs, labels).collect()}
    assert len(rows) == len(texts)
    assert np.mean([rows[i]["keep"] == bool(i % 2) for i in range(160, 240)]) > 0.95
    again = {r["doc_id"]: r["quality"] for r in quality_model.rated(docs.repartition(5), labels).collect()}
    assert again == {k: r["quality"] for k, r in rows.items()}


def test_model_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r["keep"] for r in quality_model.rated(documents(spark, ["a", None]), none).collect())
    assert quality_model.rated(documents(spark, []), none).isEmpty()
    assert quality_model.rated(documents(spark, ["a"]).select("doc_id", "text"), none).count() == 1


def jensen(p, q):
    p, q = np.array(p, float) / max(sum(p), 1), np.array(q, float) / max(sum(q), 1)
    m = (p + q) / 2
    return np.sqrt(max(sum(a * np.log2(a / c) / 2 for a, c in zip(p, m) if a) + sum(b * np.log2(b / c) / 2 for b, c in zip(q, m) if b), 0))


def test_rules_against_plain_loops(spark):
    texts = [prose(i, 90) for i in range(30)] + ["#$%& " * 80, "12345 67890 " * 50, *ODD]
    docs = documents(spark, texts, extra=True).withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    refs = quality_rules.language_references(docs)
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    kinds = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:!?'\"()-")
    for i, t in enumerate(texts):
        t, ref = t or "", refs["" if i % 5 == 0 else "en"]
        counts = [sum(c in k for c in t) for k in kinds] + [sum(c > "\x7f" for c in t)]
        counts.append(len(t) - sum(counts))
        words = t.lower().split()
        hist = [sum(w == x for w in words) for x in ref["words"]] if len(words) < 10_000 else [words.count(x) for x in ref["words"]]
        char = round(jensen(counts, ref["chars"]), 4) if len(t) >= quality_rules.MIN_CHARS else None
        word = round(jensen([*hist, len(words) - sum(hist)], [*ref["words"].values(), ref["other"]]), 4) if len(words) >= quality_rules.MIN_WORDS else None
        assert (char is None and got[i]["char_distance"] is None) or abs(got[i]["char_distance"] - char) <= 1e-4
        assert (word is None and got[i]["word_distance"] is None) or abs(got[i]["word_distance"] - word) <= 1e-4
        assert got[i]["keep"] == ((char or 0) <= quality_rules.MAX_CHAR_DISTANCE and (word or 0) <= quality_rules.MAX_WORD_DISTANCE)
    plain = {r["doc_id"]: r["keep"] for r in quality_rules.judged(documents(spark, texts[:32])).collect()}
    assert plain == {i: i < 30 for i in range(32)}
    assert quality_rules.judged(documents(spark, [])).isEmpty()
