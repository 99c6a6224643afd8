from __future__ import annotations

from itertools import combinations

from lexarium.llm import jaccard

from .helpers import ODD, documents, edited, prose


def grams(text):
    w = (text or "").split()
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def brute(texts, t=jaccard.THRESHOLD):
    sets = {i: grams(x) for i, x in enumerate(texts) if grams(x)}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    out = {(first[s], i): 1.0 for i, s in sets.items() if first[s] < i}
    for a, b in combinations(sorted(first.values()), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= t:
            out[a, b] = round(j, 6)
    return out


def corpus():
    texts = list(ODD) + ["one", "one", "a b", "b a"]
    for i, n in enumerate([6, 15, 40, 90, 200, 500, 1200, 3000]):
        base = prose(i, n)
        texts += [base, base, *(edited(base, 100 * i + k, share) for k, share in enumerate((0.01, 0.03, 0.05, 0.08, 0.1, 0.13)))]
    return texts + [prose(1000 + i, 80) for i in range(60)]


def test_against_brute_force(spark):
    texts = corpus()
    docs = documents(spark, texts, extra=True)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.similar_pairs(docs).collect()}
    want = brute(texts)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want)


def brute_classes(texts, t=jaccard.THRESHOLD):
    """{document: (class, links)} by comparing every two documents."""
    sets, root, links = [grams(x) for x in texts], list(range(len(texts))), [0] * len(texts)
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return {i: (root[i], links[i]) for i in range(len(texts))}


def test_query_against_all_pairs(spark, tmp_path):
    base, near = prose(7, 150), edited(prose(7, 150), 1, 0.01)
    texts = [base, near, base, prose(8, 90), near, base, *ODD, "one", *(edited(base, k, 0.04) for k in range(9)), *(prose(70 + k % 3, 30) for k in range(40))]
    documents(spark, texts, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = jaccard.op4_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in rows} == brute_classes(texts) and len(rows) == len(texts)


def test_classes_of_odd_tables(spark):
    assert jaccard.document_classes(documents(spark, [])).isEmpty()
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a  b c"), (3, None), (4, ""), (5, "d e"), (5, "a b c"), (6, "d e")]
    got = {tuple(r) for r in jaccard.document_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # 5 has two texts: one links it to 1 and 2, the other to 6
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 1, 3), (6, 1, 1)}


def test_recall_of_sampled_sketches():
    """Pairs of an index of just over the threshold meet in a block at least as often as stated, at the ends of the bands."""
    import numpy as np

    rng, pairs = np.random.default_rng(5), 600
    for n in (30, 38, 97, 98, 170, 244, 245, 610):
        shared = int(np.ceil(2 * n * jaccard.THRESHOLD / (1 + jaccard.THRESHOLD)))
        sets = []
        for _ in range(pairs):
            pool = rng.integers(1, 2**63, 2 * n - shared, dtype=np.uint64)
            sets += [np.sort(pool[:n]), np.sort(pool[n - shared :])]
        keys, owner, _, _ = jaccard.signatures(np.concatenate(sets), np.arange(2 * pairs + 1) * n)
        held = [set() for _ in sets]
        for k, o in zip(keys.tolist(), owner.tolist()):
            held[o].add(k)
        met = sum(bool(held[2 * i] & held[2 * i + 1]) for i in range(pairs)) / pairs
        bound = jaccard.least_recall(n)
        assert bound > 0.98 and met >= (1 if bound == 1 else bound - 3 * (bound * (1 - bound) / pairs) ** 0.5), n


def test_large_groups(spark):
    base = prose(7, 150)
    texts = [edited(base, i, 0.01) for i in range(150)] + [base] * 100
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.similar_pairs(documents(spark, texts)).collect()}
    want = set(brute(texts))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_keep_one(spark):
    texts = corpus()
    docs = documents(spark, texts, extra=True)
    pairs = [(r["doc_a"], r["doc_b"]) for r in jaccard.similar_pairs(docs).collect()]
    root = {i: i for i in range(len(texts))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {find(i) for i in range(len(texts))}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in jaccard.components(spark, edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_empty_null_and_repeated(spark):
    assert jaccard.similar_pairs(documents(spark, [])).isEmpty() and jaccard.keep_one(documents(spark, [])).isEmpty()
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a  b c"), (3, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in jaccard.similar_pairs(docs).collect()] == [(1, 2, 1.0)]
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(docs).collect()) == ["1", "1", "3", "None"]


def test_sketch_bounds_the_difference():
    import numpy as np
    import pyarrow as pa

    a = prose(3, 12)
    g, f = jaccard.gram_sets(pa.array([a, edited(a, 5, 0.1)]))
    _, owner, _, sketch = jaccard.signatures(g, f)
    x, y = (sketch[np.flatnonzero(owner == i)[0]] for i in (0, 1))
    sets = [set(g[f[i] : f[i + 1]].tolist()) for i in (0, 1)]
    assert int(np.bitwise_count(x ^ y).sum()) <= len(sets[0] ^ sets[1])


def barely(pairs, n=97, first=0):
    """Texts 2i and 2i + 1 of n bigrams have an index of just the threshold and nothing in common with others."""
    shared = -int(-2 * n * jaccard.THRESHOLD // (1 + jaccard.THRESHOLD))
    out = []
    for i in range(first, first + pairs):
        words = [f"w{i}x{k}" for k in range(2 * n - shared + 1)]
        out += [" ".join(words[: n + 1]), " ".join(words[: shared + 1] + words[n + 1 :])]
    return out


def test_no_pair_at_the_threshold_is_lost(spark, tmp_path):
    texts = [x for n in (97, 244, 610) for x in barely(400, n, 1000 * n)]
    texts += [x for i in range(6000) for x in (f"a{i} b{i} c{i}", f"a{i} b{i} c{i} d{i}")]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = jaccard.op4_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in rows} == {i: (i // 2 * 2, 1) for i in range(len(texts))}


def test_prefixes_hold_what_every_pair_counts_on():
    assert all(jaccard.least_recall(n) == 1 for n in [*range(1, 700), 5000, 40_000])


def test_pipeline_stage_keeps_one_of_each_pair_at_the_threshold(spark):
    import corpus_pipeline

    docs = documents(spark, [x for i in range(9000) for x in (f"a{i} b{i} c{i}", f"a{i} b{i} c{i} d{i}")])
    kept = corpus_pipeline.join_near_duplicates(spark, docs, "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 18_000, 2))


def shuffled(spark, since=-1):
    """(bytes that stages after ``since`` wrote to shuffles, the last stage)."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    new = [s for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() > since]
    return sum(s.shuffleWriteBytes() for s in new), max([since, *(s.stageId() for s in new)])


def test_bigrams_of_one_set_are_not_shuffled_as_keys(spark):
    import random

    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(300)) for _ in range(1000)]
    docs = documents(spark, [*texts, *(edited(x, i, 0.05) for i, x in enumerate(texts[:20]))])
    _, last = shuffled(spark)
    rows = jaccard.document_classes(docs).collect()
    assert sum(x["links"] for x in rows) == 40 and len(rows) == 1020
    assert shuffled(spark, last)[0] < 1.5 * sum(map(len, texts))


def test_order_by_counts_loses_no_pair(spark):
    """Sets that share few bigrams with very many others, of which a scan partition passes on only some."""
    texts = [x for n in (5, 30, 97) for x in barely(30, n, 1000 * n)] + [edited(prose(5, 120), i, 0.08) for i in range(120)]
    texts += texts[:40] + ["the of and to in"] * 30
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.document_classes(documents(spark, texts)).collect()}
    assert got == brute_classes(texts)
