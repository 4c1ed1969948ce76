"""Source divergence, quality rules and hard negatives against plain versions, on whole tables and on awkward rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlery.llm import divergence, negatives, rules
from candlery.llm.common import plain_names, table

DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{i % 997}" for i in range(40_000))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- 11


def plain_audit(rows, min_docs=10, top=10):
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        holders[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= min_docs]

        def shares(count):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // whole for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            over = [(-apart(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def audited(df, **more):
    rows = [tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_divergence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert audited(docs) == plain_audit([(r.text, r.lang, r.source) for r in docs.collect()])


def test_divergence_of_awkward_rows(spark, monkeypatch):
    rows = [("A b-c É2É x", "en", "s1"), ("a B", "en", "s2"), ("b b b", "en", None), (None, "en", "s4"), ("a a", None, None), ("", "fr", "s1"), ("c", "fr", "é"), ("c", "fr", "z"),
            ("a b", "en", "s1"), ("a b", "en", "s1"), ("9 _ @[`{", "de", "only"), (LONG, "en", "s3")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(4)
    for least in (1, 2, 99):
        assert audited(df, min_docs=least, top=3) == plain_audit(rows, least, 3)
    monkeypatch.setattr(divergence, "HELD_TERMS", 2)  # counted and handed on in many pieces
    odd = df.select("*", *(F.lit("x").alias(c) for c in ("term", "n", "docs", "I", "counts", "a.b", "v`w", "RANK")))
    assert audited(odd, min_docs=2, top=3) == plain_audit(rows, 2, 3)
    monkeypatch.setattr("candlery.llm.common.BROADCAST_BYTES", 0)  # nothing broadcast
    assert audited(df, min_docs=1) == plain_audit(rows, 1)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_of_large_counts(spark):
    got = spark.range(1).selectExpr(f"{divergence.share('(4000000000000000L)', '7999999999999999L')} as p", f"{divergence.share('2L', '3L')} as q").first()
    assert (got.p, got.q) == (1 + 10**9 * 4 * 10**15 // (8 * 10**15 - 1), 1 + 2 * 10**9 // 3)


# -- 12


def plain_rules(rows, min_docs=10, max_percent=1, left_percent=30):
    """By row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_cut, kept and the text left."""
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    norm = lambda line: " ".join(split(re.sub("[0-9]", "0", lower(line))))
    texts = defaultdict(set)
    for text, host in rows:
        texts[host or ""].add(text or "")
    count = Counter((h, n) for h, own in texts.items() for t in own for n in {norm(x) for x in t.split("\n")} if n)
    over = {k for k, n in count.items() if n > min_docs and 100 * n > max_percent * len(texts[k[0]])}
    out = []
    for text, host in rows:
        words, lines = split(text or ""), [x for x in (text or "").split("\n") if split(x)]
        places = defaultdict(list)
        for i in range(len(words) - 7):
            places[tuple(words[i : i + 8])].append(i)
        repeated = {i + k for own in places.values() if len(own) > 1 for i in own for k in range(8)}
        left = [x for x in lines if (host or "", norm(x)) not in over]
        cut = len(words) - sum(len(split(x)) for x in left)
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        kept = not failed and 100 * (len(words) - cut) >= left_percent * len(words)
        out.append((len(words), len("".join(words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed, cut, kept, "\n".join(left) if cut else text))
    return out


def test_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = docs.collect()
    want = plain_rules([(r.text, r.source) for r in rows])
    got = {r.doc_id: tuple(r[c] for c in rules.RESULTS) for r in rules.judge(docs).collect()}
    assert got == {r.doc_id: w[:-1] for r, w in zip(rows, want)}
    assert sum(w[7] for w in want) > len(rows) / 2
    assert {(r.doc_id, r.text) for r in rules.clean(docs).collect()} == {(r.doc_id, w[-1]) for r, w in zip(rows, want) if w[7]}


def awkward_pages():
    menu, rest = "Home | About 2024 | <b>", " ".join(f"own{i}" for i in range(25))
    rows = [(f"{menu}\n{rest} {i}\n  home | ABOUT 2025 | <b>\r\nfoot {i}", "h") for i in range(14)]
    notice = " ".join(chr(97 + k) * 3 for k in range(25))
    rows += [(f"{notice}\n{'x' * (i + 1)} left", "h") for i in range(12)] + [(f"{menu}\n{rest}", "other"), (f"{menu}\n{rest} twice", None)]
    rows += [(rows[0][0], "h")] * 30  # copies count once
    rows += [(None, "h"), ("", "h"), (" \n\t\n", None), ("a " * 50, "h"), ("a b c d e f g h i a b c d e f g h j k l m n o p q r s t u v w x y z", "h"), (LONG, "h"), ("é ü x\x1cy\x85z " * 9 + "\n\n\nA\nA\nA \nB", "h")]
    rows += [(f"line {i}\n" + " ".join(f"q{i}_{k}" for k in range(30)), "h") for i in range(12)]  # digits don't tell lines apart
    return rows


def test_rules_of_awkward_rows(spark, monkeypatch):
    rows = awkward_pages()
    want = plain_rules(rows)
    assert any(w[6] and w[7] for w in want) and any(w[6] and not w[7] and not w[5] for w in want)
    plain = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string").repartition(5)
    odd = plain.select("*", *(F.lit("own").alias(c) for c in ("N_Words", "KEPT", "host", "digest", "lines", "line", "words", "gone", "a.b", "v`w", "n")), F.struct(F.lit(1).alias("a-b")).alias("s t"))
    for docs in (plain, odd):
        got = rules.judge(docs).collect()
        assert {r["doc_id"]: tuple(r[c] for c in rules.RESULTS) for r in got} == {i: w[:-1] for i, w in enumerate(want)}
        cut = rules.clean(docs).collect()
        assert {(r["doc_id"], r["text"]) for r in cut} == {(i, w[-1]) for i, w in enumerate(want) if w[7]}
        assert docs is plain or all(r["a.b"] == r["v`w"] == r["host"] == r["lines"] == "own" and r["s t"]["a-b"] == 1 for r in [*got, *cut])
    monkeypatch.setattr("candlery.llm.common.BROADCAST_BYTES", 0)
    assert {r.doc_id: r.n_cut for r in rules.judge(plain).collect()} == {i: w[6] for i, w in enumerate(want)}
    loose = rules.judge(plain.withColumn("doc_id", F.lit(None).cast("long")))
    assert Counter(r.n_cut for r in loose.collect()) == Counter(w[6] for w in want)
    assert rules.judge(plain.limit(0)).count() == rules.clean(plain.limit(0)).count() == 0


def test_plain_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["Doc_ID", "a.b", "x`y", "SCORE", "c"])
    rows, back = plain_names(df, ("doc_id",), ("score",))
    out = back(rows.withColumn("score", F.lit(9)), ("score",))
    assert out.columns == ["Doc_ID", "a.b", "x`y", "c", "score"] and tuple(out.first()) == (1, 2, 3, 5, 9)


# -- 13


def plain_negatives(rows, step=100, n_positives=5, n_negatives=10, low=30, high=90):
    ok = {}
    for vec, label, x in rows:
        if None not in (vec, label, x) and all(c is not None and math.isfinite(c) for c in x):
            ok[vec] = min(ok.get(vec, (label, x)), (label, x))
    width = max((len(x) for _, x in ok.values()), default=0)
    ids = sorted(ok)
    x = np.array([[math.floor(256 * c) for c in ok[i][1]] + [0] * (width - len(ok[i][1])) for i in ids], np.int64).reshape(len(ids), width)
    out = set()
    for at, a in enumerate(ids):
        if a % step:
            continue
        scores = (x @ x[at]).tolist()
        order = sorted((-s, i) for s, i in zip(scores, ids) if i != a)
        near = [(-s, i) for s, i in order if ok[i][0] == ok[a][0]][:n_positives]
        for top, p in near:
            fits = [(-s, i) for s, i in order if ok[i][0] != ok[a][0] and low * top <= -100 * s <= high * top][:n_negatives]
            out |= {(a, p, k, i, top, s) for k, (s, i) in enumerate(fits, 1)}
    return out


def mined(df, **more):
    rows = [tuple(r) for r in negatives.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in vectors.collect()]
    out = negatives.op13_hard_negatives(spark, sf_dir)
    assert {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect()} == plain_negatives(rows)


SCHEMA = "vec_id long, label int, embedding array<float>"


def clustered(rng, n, width=6):
    """Vectors in tight groups of very different lengths, so that scans end before they have read everything."""
    means = rng.normal(0, 1, (8, width)) * rng.uniform(0.2, 4, (8, 1))
    return [(i, int(rng.integers(0, 4)), (means[i % 8] + rng.normal(0, 0.05, width)).astype(np.float32).tolist()) for i in range(n)]


def test_negatives_in_few_cells(spark, monkeypatch):
    """Small cells and blocks: scans grow in rounds, and most cells are never read."""
    for name, value in (("CELL_BYTES", 1), ("BLOCK", 3), ("FIRST", 0.02), ("GROWTH", 2.0)):
        monkeypatch.setattr(negatives, name, value)
    read, inner = [], negatives._scan
    monkeypatch.setattr(negatives, "_scan", lambda *a: read.append(1) or inner(*a))
    rows = clustered(np.random.default_rng(5), 600)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(4), anchors="vec_id % 60 = 0") == plain_negatives(rows, 60)
    assert len(read) > 3


def test_negatives_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(0, 1, 5).astype(np.float32).tolist()) for i in range(40)]
    same = rows[7][2]
    rows += [(100 + i, i % 3, same) for i in range(60)]  # copies: ties by vec_id
    rows += [(200, None, same), (300, 1, None), (400, 1, [1.0, None, 0.0, 0.0, 0.0]), (500, 1, [math.nan] * 5), (600, 1, [math.inf, 0.0]), (None, 1, same)]
    rows += [(700, 1, [1.0, -1.0]), (800, 2, []), (900, 2, [0.0] * 5), (1000, 9, [3.0] * 5), (-100, 0, same), (7, rows[7][1], same), (7, rows[7][1], same), (1100, 0, [-5.0] * 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain_negatives(rows)
    assert want and mined(df) == want
    odd = df.select("*", *(F.lit(7).alias(c) for c in ("id", "V", "cell", "anchor", "band", "a.b", "v`w", "RANK")))
    assert mined(odd) == want
    assert mined(df, anchors="vec_id % 7 = 0", positives=2, negatives=3, low=10, high=80) == plain_negatives(rows, 7, 2, 3, 10, 80)
    assert negatives.mine(df.limit(0)).count() == 0 and negatives.mine(df, anchors="vec_id = -1").count() == 0


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_products_are_exact(scale):
    rng = np.random.default_rng(3)
    a, b = (np.floor(256 * scale * rng.normal(0, 1, (4, 64))).astype(np.int64) for _ in range(2))
    assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
