import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import ngram_join as J
from keelson.llm import repeats as R
from keelson.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_transform_against_counts():
    rnd = random.Random(5)
    for k in range(60):
        letters = (b"ab", b"abc\0\xff", bytes(range(256)))[k % 3]
        length = rnd.choice([2, 3, 5, 8])
        texts = sorted({bytes(rnd.choice(letters) for _ in range(rnd.randint(length, 40))) for _ in range(rnd.randint(1, 12))})
        transform = R.Transform(texts)
        got = transform.repeated(length)
        counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for start, t in zip(transform.starts, texts, strict=True):
            assert [bool(got[start + i]) for i in range(len(t) - length + 1)] == [counts[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]


def removed(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                step[i] += 1
                step[i + length] -= 1
        gone = np.cumsum(step[:-1]) > 0
        out.append((d, len(t), int(gone.sum()), len(R.runs_of(gone)[0]), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("rule", [R.RepeatRule(), R.RepeatRule(crowded=3), R.RepeatRule(length=40, gram=10, bucket_bytes=2000), R.RepeatRule(length=40, gram=10, crowded=2, part=4), R.RepeatRule(length=30, gram=9, crowded=0)])
def test_removal_against_brute_force(docs, rows, rule):
    got = [tuple(r) for r in R.removal_digests(docs, rule=rule).collect()]
    assert sorted(got, key=repr) == sorted(removed(rows, rule.length), key=repr)


def test_very_long_texts_are_cut_in_pieces_without_loss(monkeypatch):
    rnd = random.Random(2)
    data = np.frombuffer(bytes(rnd.choice(b"abcd ") for _ in range(3000)), np.uint8)
    offs = np.array([0, 900, 900, 3000])
    rule = R.RepeatRule(length=50, gram=10)

    def windows(parts):
        return [(int(h), int(d), s) for h, d, a, b, _ in zip(*parts, strict=True) for s in range(a, b + 1)]

    whole = windows(R.anchors(data, offs, rule))
    monkeypatch.setattr(R, "_PIECE", 700)
    assert windows(R.anchors(data, offs, rule)) == whole
    assert [s for _, _, s in whole] == [*range(0, 851), *range(900, 2951)]


def test_removal_edges(docs, empty):
    assert R.removal_digests(empty).count() == 0
    out = R.without_repeats(docs.withColumn("_KEY2", F.lit(1)).withColumn("spans", F.lit("s")))
    assert out.columns == ["doc_id", "text", "_KEY2", "spans"] and out.count() == docs.count()
    assert out.where("doc_id = 46").first()["text"] is None and out.where("doc_id = 51").first()["text"] == ""


def joined(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


@pytest.mark.parametrize("rule", [J.JoinRule(), J.JoinRule(n=4, percent=85, middling=3, frequent=4), J.JoinRule(n=2, percent=50, middling=3, frequent=8, salted=3), J.JoinRule(n=3, percent=60, listed=5, middling=3), J.JoinRule(n=2, percent=75, middling=3, frequent=3, block=2), J.JoinRule(n=3, percent=55, middling=3, block=3, block_bytes=2000), J.JoinRule(n=3, percent=75, few=1, block=4), J.JoinRule(n=2, percent=60, few=1), J.JoinRule(n=1, percent=55, few=0, block=5, salted=1)])
def test_join_against_brute_force(docs, rows, rule):
    got = [tuple(r) for r in J.linked(docs, rule=rule).collect()]
    assert sorted(got, key=repr) == sorted(joined(rows, rule.n, rule.percent), key=repr)


@pytest.mark.parametrize("few, block", [(0, 7), (1, 4096), (2, 40)])
def test_large_families_of_near_copies_against_brute_force(spark, monkeypatch, few, block):
    """Hundreds of copies with changes here and there: many components that share all signatures."""
    rnd = random.Random(few)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = base[: rnd.choice([40, 60, 60])]
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(words)))
    seen = []
    near = J._near
    monkeypatch.setattr(J, "_near", lambda *a: seen.append(near(*a)) or seen[-1])
    rule = J.JoinRule(n=3, percent=85, few=few, block=block)
    got = [tuple(r) for r in J.linked(spark.createDataFrame(rows, "doc_id long, text string"), rule=rule).collect()]
    want = joined(rows, 3, 85)
    assert sorted(got) == sorted(want) and 5 < len({r[2] for r in want}) < 150


def test_join_edges(empty, docs):
    assert J.linked(empty).count() == 0
    assert J.linked(docs.withColumn("node", F.lit("x")).withColumn("sig", F.lit(0))).count() == docs.count()


def test_pairs_of_frequent_shingles_leave_one_signature():
    """Two sets as far apart as the rule allows always share a signature, whatever the classes."""
    rnd = random.Random(7)
    for k in range(600):
        rule = J.JoinRule(n=1, percent=(75, 80, 85, 95)[k % 4])
        n = rnd.randint(2, (8, 70, 900)[k % 3])
        a = rnd.sample(range(1, 1 << 40), n)
        lost = n - -(-rule.percent * n // 100)
        keep = rnd.sample(a, n - rnd.randint(0, lost))
        more = len(keep) * 100 // rule.percent - n  # as many as the similarity allows, or fewer
        b = keep + [rnd.randrange(1 << 41, 1 << 42) for _ in range(rnd.randint(0, max(more, 0)))]
        if 100 * len(keep) < rule.percent * len(set(a) | set(b)) or set(a) == set(b):
            continue
        sets = np.array(sorted(a) + sorted(b), np.uint64)
        offs = np.array([0, len(a), len(sets)])
        every = sorted({*a, *b})
        known = np.array(sorted(rnd.sample(every, rnd.choice([len(every), rnd.randint(0, len(every))]))), np.uint64)
        df = np.array([rnd.choice([5, 500]) for _ in known], np.int64)
        sigs, _ = J.signatures(sets, offs, known, df, 100, rule)
        assert set(sigs[0].tolist()) & set(sigs[1].tolist())
        assert all(len(own) <= m + 1 for own, m in zip(sigs, np.diff(offs), strict=True))


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 3), (9, 8), (8, 9), (5, 5), (None, 1)] + [(i, i + 1) for i in range(20, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8} | {i: 20 for i in range(20, 61)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_raise_when_rounds_run_out(spark, monkeypatch):
    from keelson.llm import components as C

    monkeypatch.setattr(C, "_contracted", lambda batches: batches)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    with pytest.raises(RuntimeError):
        C.components(edges, rounds=1)
    assert {tuple(r) for r in C.components(edges).collect()} == {(i, 0) for i in range(21)}


def test_components_that_fit_one_union_find_take_no_steps(spark, monkeypatch):
    """Rounds of shuffles are for edges that one task cannot take, however many partitions the few are dealt to."""
    from keelson.llm import components as C

    names = random.Random(3).sample(range(10**6), 900)
    rows = [(a, b) for a, b in zip(names, names[1:], strict=False) if a % 50]
    edges = spark.createDataFrame(rows, "u long, v long").repartition(40)
    parent = {a: a for a in names}
    for _ in names:
        for a, b in rows:
            parent[a] = parent[b] = min(parent[a], parent[b])
    want = {a: parent[a] for row in rows for a in row}
    star, steps = C._star, []
    monkeypatch.setattr(C, "_star", lambda *a: steps.append(a) or star(*a))
    assert {r["node"]: r["component"] for r in C.components(edges).collect()} == want and not steps
    monkeypatch.setattr(C, "_HELD", 60)
    assert {r["node"]: r["component"] for r in C.components(edges).collect()} == want and steps
