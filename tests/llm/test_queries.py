"""Registered queries against SQL on the smallest tables, and against rules written anew where SQL cannot say them."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import language, lm, ngram_join, queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall())


BASE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(list_append(w, NULL)) AS word FROM d),
h AS (SELECT doc_id, doc_id IN (SELECT unnest($held)) AS held_out FROM d),
t AS (SELECT word, count(*) AS c FROM k JOIN h USING (doc_id) WHERE NOT held_out GROUP BY 1),
s AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM t)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
FROM k JOIN h USING (doc_id) LEFT JOIN t ON t.word IS NOT DISTINCT FROM k.word, s GROUP BY 1, 2"""


def test_base_scores_equal_sql(spark, duck):
    ids = [r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall()]
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 7 == 2]
    want = {r[0]: r[1:] for r in duck.execute(BASE, {"held": held}).fetchall()}
    got = {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in queries.QUERIES["op5_log_bilinear"](spark, SF).collect()}
    assert set(got) == set(want)
    for d, row in want.items():
        assert got[d][:4] == row[:4] and math.isclose(got[d][4], row[4], rel_tol=1e-9)


def test_held_out_scores_beat_the_base(spark):
    """What the model gains over counts alone, in log10 a token of held-out text."""
    out = queries.QUERIES["op5_log_bilinear"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (out[0] - out[1]) / out[2] > 0.05


def log_of(model, context, target):
    """The model's log10 probability of one class after two others, from its definition and without batches."""
    d = model.p["r"].shape[1]
    x = model.p["r"][model.rank[context[0]]].astype(float) @ model.p["c"][:d] + model.p["r"][model.rank[context[1]]].astype(float) @ model.p["c"][d:]
    x = np.append(x, 1.0)

    def softmax(rows, prior, at):
        z = rows.astype(float) @ x + np.log(prior.astype(float))
        return z[at] - z.max() - math.log(np.exp(z - z.max()).sum())

    w = int(model.rank[target])
    g = int(model.group[w])
    low, high = int(model.low[g]), int(model.low[g + 1])
    out = softmax(model.p["g"], model.groups, g)
    return (out + softmax(model.p["q"][low:high], model.inside[low:high], w - low)) / math.log(10)


def test_scores_are_sums_of_single_probabilities(spark, monkeypatch):
    """score of each text = over its tokens, the class's probability in context times the word's share of its class."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 30}x" for k in range(12)) + (" Rare%dly" % i if i % 3 else "")) for i in range(80)] + [(90, None), (91, "unseen things entirely")]
    seen = {}

    def keep(*args, **options):
        seen["args"], seen["model"] = args, trained(*args, **options)
        return seen["model"]

    trained = lm._trained
    monkeypatch.setattr(lm, "_trained", keep)
    shape = lm.ModelShape(words=12, steps=30, size=6)
    got = {r["doc_id"]: r["score"] for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), shape=shape).collect()}
    _, classes, every, _, _ = seen["args"]
    model, size = seen["model"], len(every)
    train = [w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in (t or "").lower().split()]
    counts = {w: train.count(w) for w in set(train)}
    for i, text in rows:
        words = (text or "").lower().split()
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        hashes, starts, ends, _ = lm.textvec.word_hashes(data, np.array([0, len(data)]), lm.textvec.SPACE_WORDS)
        own = classes.of(hashes, lm.endings(data, starts, ends, shape.endings)).tolist() + [size - 2]
        total, before = 0.0, [size - 1, size - 1]
        for k, c in enumerate(own):
            total += log_of(model, before, c)
            before = [c, before[0]]
            if c >= len(classes.words) and c != size - 2:
                e = c - len(classes.words)
                total += math.log10((counts.get(words[k], 0) + 1) / (classes.tokens[e] + classes.distinct[e] + 1))
        assert math.isclose(got[i], total, rel_tol=1e-4, abs_tol=1e-4), i


def plain_spans(text):
    """The three base kinds by rules written anew: a character at a time, without the patterns of the operator."""
    out, word = [], "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    i = 0
    while i < len(text):
        name = next((n for n in names if text[i : i + len(n)].lower() == n and text[i : i + len(n)].isascii()), None)
        j = i + len(name or "")
        found = None
        if name:
            for quote in (1, 0):  # a quote is taken if what follows fits, else left
                k = j + (quote if text[j : j + 1] in ("'", '"') and text[j : j + 1] else 0)
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in ("'", '"') and text[k : k + 1]:
                    k += 1
                end = k
                while text[end : end + 1] and text[end] in word + "+/_.=-":
                    end += 1
                if end > k:
                    found = (k, end)
                    break
        if found:
            if found[1] - found[0] >= 6:
                out.append((i, 0, found[1]))
            i = found[1]
        else:
            i += 1
    for kind, head, letters, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            end = i + len(head)
            while text.startswith(head, i) and text[end : end + 1] and text[end] in letters:
                end += 1
            if text.startswith(head, i) and end > i + len(head):
                if end - i >= least:
                    out.append((i, kind, end))
                i = end
            else:
                i += 1
    return sorted(out)


CASES = [
    "Password : 'abcdef", 'api_key"="k=v/w+x.y-z_1 token:short secret= ', "passwd'=\"  x", "SECRET:::abcdefgh token==abcdef", "apikey=tokentoken=abcdefg",
    "AKIAAKIA" + "A" * 20, "AKIA" + "B" * 15, "AKIA", "x" + "0" * 24 + "g" + "f" * 23, "PASSWORD=ſecretſ token='", "password='secret=abcdefgh'", "é token = é", "", "api key=abcdef api-key=abcdef",
]


def test_secret_scan_against_rules_written_anew(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*CASES, None])], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.unionByName(more).collect()}
    got = secrets.digests(docs.unionByName(more), queries.SECRET_VOCABULARY, queries.PATTERN, keep=["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base) for k in range(3)), texts[r["doc_id"]]
        names = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == names  # the method adds, and takes nothing away
    assert sum(len(plain_spans(t)) for t in texts.values()) > 20


def plain_labels(text, model, penalty):
    """lang_pred and score by plain loops over words, and all paths' best by the recursion itself."""
    chars = text or ""
    words, at = [], 0
    while at < len(chars):
        if chars[at].isalpha():
            end = at
            while end < len(chars) and chars[end].isalpha():
                end += 1
            words.append((at, end))
            at = end
        else:
            at += 1
    if not words:
        return language.UNKNOWN, 0.0
    n = len(model.languages)
    scores = np.zeros((len(words), n))
    for k, (a, b) in enumerate(words):
        raw = chars[a:b].encode().translate(bytes(language.textvec.LOWER))
        padded = b" " + raw + b" "
        for i in range(len(raw)):
            code = (padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 0x9E3779B1 % (1 << 32) >> 16
            scores[k] += model.weights[:, code]
        point = ord(chars[a])
        script = next((language.SCRIPTS.index(s) for low, high, s in language.RANGES if low <= point <= high), 0)
        scores[k, ~model.allowed[script]] -= 1000
    best, back = scores[0].copy(), []
    for k in range(1, len(words)):
        change = best[:, None] - penalty * (1 - np.eye(n))
        back.append(change.argmax(0))
        best = change.max(0) + scores[k]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    mass = np.zeros(n)
    for (a, b), k in zip(words, reversed(path), strict=True):
        mass[k] += b - a
    return model.languages[int(mass.argmax())], mass.max() / mass.sum()


def test_languages_against_plain_loops(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    keys = sorted(texts)
    mixed = [(10**6 + i, (texts[a] or "")[:150] + " " + (texts[b] or "")[:150]) for i, (a, b) in enumerate(zip(keys, keys[1:], strict=False))]
    odd = [(-1, None), (-2, ""), (-3, "123 !"), (-4, "漢字 かな الله 12"), (-5, "ñ"), (-6, "a1b2c3")]
    rows = mixed[:80] + odd + [(k, texts[k]) for k in keys[:80]]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        lang, score = plain_labels(text, model, 12.0)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, (i, text, got[i], lang, score)


def test_held_out_is_by_the_rule(spark):
    for name, modulus, held in (("op5_log_bilinear", 7, 2), ("op6_language_id", 3, 1)):
        for r in queries.QUERIES[name](spark, SF).select("doc_id", "held_out").collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)


def test_words_of_the_benchmark_and_of_documents_are_cut_alike():
    assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ab1é-x_y") == ["ab1é", "x", "y"]


def test_links_survive_rows_with_one_identifier(spark):
    """Many texts under one identifier, and under none, keep their links."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "other")
    rows = [(1, base), (2, "a b c d e f g"), (2, near), (None, base + " more"), (None, "x y z"), (None, "p q r s t u"), (2, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0], r[1], r[2]) for r in ngram_join.linked(df).collect()), key=repr)
    assert got == sorted([(1, 56, 1), (2, 3, 2), (2, 56, 1), (None, 57, 1), (None, 1, 2), (None, 2, None), (2, 1, 2)], key=repr)
    kept = {tuple(r) for r in ngram_join.one_of_each(df).collect()}
    assert kept == {(1, base), (2, "a b c d e f g"), (2, "x y z"), (None, "p q r s t u")}
