import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import decontamination as D
from keelson.llm import quality as Q
from keelson.llm.suffixes import SuffixRanks

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def covered(words, k):
    counts = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if counts[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def quality(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    r5, r8 = covered(words, 5), covered(words, 8)
    failed = len(words) < 10 or 100 * r5 > 20 * len(words)
    long = len(words) > 101 and covered(words, 101) > 0
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r5, r8, failed, not failed and 100 * r8 <= 15 * len(words) and not long)


def test_quality_against_brute_force(docs, rows):
    got = Q.quality_rules(docs).drop("longest_repeat").collect()
    assert sorted(map(repr, (tuple(r)[2:] for r in got))) == sorted(map(repr, (quality(t) for _, t in rows)))
    assert sorted((r["text"] or "", r["n_words"]) for r in got) == sorted((t or "", quality(t)[0]) for _, t in rows)


def test_quality_edges(docs, empty):
    assert Q.quality_rules(empty).count() == 0
    clash = docs.select("doc_id", "text", F.lit("x").alias("N_Words"), F.lit(1).alias("other"))
    out = Q.quality_rules(clash)
    assert "N_Words" not in out.columns and "other" in out.columns and out.schema["n_words"].dataType.typeName() == "long"
    assert out.count() == docs.count()


def test_suffix_order():
    rng = np.random.default_rng(1)
    for size in (1, 2, 40):
        s = rng.integers(0, 3, size)
        ranks = SuffixRanks(s, size)
        want = sorted(range(size), key=lambda i: s[i:].tolist())
        assert ranks.order.tolist() == want
        lcp = [0] + [next((k for k in range(size) if a + k >= size or b + k >= size or s[a + k] != s[b + k]), size) for a, b in zip(want, want[1:], strict=False)]
        assert ranks.neighbour_lcp().tolist() == lcp


def contaminated(rows, items, window=13):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: split.findall((t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 150])
def test_decontamination_against_brute_force(spark, docs, rows, block_bytes):
    by = dict(rows)
    items = [(1, " ".join(SPACE.findall(by[3])[5:40])), (2, "x"), (3, None), (None, "two spaces"), (5, ""), (6, by[41][-90:]), (6, by[41][-90:]), (7, by[53][300:700])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = D.contamination(docs, benchmark, block_bytes=block_bytes)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    want = contaminated(rows, items)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[5] for w in want) > 2
    kept = D.decontaminated(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_decontamination_edges(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).where("contaminated").count() == 0
    assert D.contamination(empty, none).count() == 0
    item = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    doc = spark.createDataFrame([(1, "so Alpha beta, gamma delta alpha beta gamma")], "doc_id long, text string")
    m = D.matches(doc, item, least=3).first()["matches"]
    assert [(x["test_word"], x["start"], x["words"]) for x in m] == [(0, 1, 4), (1, 2, 3)]
