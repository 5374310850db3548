"""Quality by neighbours, divergence of sources and periodic runs, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tempora.llm import divergence, neighbours, periods

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(c):
    found = []
    for q in range(1, len(c) // 4 + 1):
        i = 0
        while i + q < len(c):
            j = i
            while j + q < len(c) and c[j] == c[j + q]:
                j += 1
            part = c[i : j + q]
            if j > i and len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found)


@pytest.mark.parametrize("rare", [0, 0.5, 1, 50])
def test_runs(rare):
    r = random.Random(rare)
    for _ in range(400):
        c = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 70))]
        if c and r.random() < 0.6:
            a, p = r.randrange(len(c)), r.randint(1, 7)
            c = c[:a] + [c[a + (i - a) % p] if a + (i - a) % p < len(c) else 0 for i in range(a, len(c))]
        codes = np.array(c, dtype=np.int64)
        assert periods.runs(codes, rare) == brute_runs(c)
        most = len(c) // 4
        assert periods.lag_counts(codes, most, rare).tolist() == [0] + [sum(c[i] == c[i + q] for i in range(len(c) - q)) for q in range(1, most + 1)]


def test_a_text_of_one_word_takes_no_square_time():
    assert periods.runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]


def texts_with_runs():
    r, rows = random.Random(3), []
    for i in range(60):
        w = [r.choice(["a", "b", "cé", "D d", "x "]) for _ in range(r.randint(0, 90))]
        at = r.randint(0, len(w))
        rows.append((r.choice([i, i * 7919]), r.choice([" ", "\n", "\t "]).join(w[:at] + w[at : at + 3] * r.randint(0, 9) + w[at:]), 1))
    return [*rows, rows[0], (None, "z " * 40, 1), (90, None, 1), (91, "", 1), (92, " \n", 1), (None, None, 1), (93, "one two " * 5000, 1)]


def test_periodic_runs(spark):
    def brute(doc_id, text):
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w) if len(w) < 5000 else [(0, len(w), 2)]
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        best = min(found, key=lambda t: (-t[1] / t[2], t[0], t[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        return (doc_id, len(found), *top, sha("".join("%d,%d,%d\n" % t for t in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))

    rows = texts_with_runs()
    assert zlib.crc32(b"93") % 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, period int").repartition(3)
    got = list(map(tuple, periods.detect(docs).collect()))
    assert sorted(got, key=str) == sorted((brute(d, t) for d, t, _ in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20
    assert periods.detect(docs.where("false")).count() == 0
    kept = periods.deduplicated(docs.where("doc_id in (90, 91, 93)").withColumn("collapsed", docs.text)).collect()
    assert {r.doc_id: (r.collapsed, r.period) for r in kept} == {90: (None, 1), 91: ("", 1), 93: ("one two", 1)}


@pytest.mark.parametrize(("terms", "groups"), [(1024, 48), (5, 2)])
def test_divergence(spark, monkeypatch, terms, groups):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "HELD", 50)
    r = random.Random(5)
    words = ["The", "the", "of", "é", "É", "ab1cd", "naïve", "x", "日本", "zz-top", "Q"]
    rows = [(i % 90, " ".join(r.choices(words, weights=range(1, 12), k=r.randint(0, 30))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "é", None, "S"]), 7) for i in range(200)]
    rows += [(1, None, "en", "empty", 7), (2, "lonely words", "xx", "only", 7), (3, "nothing kept", "yy", "a", 7), (4, "", "yy", "b", 7), (5, "the " * 3000, "en", "s1", 7)]
    rows += [rows[0]] * 3

    def brute():
        n, docs, seen, out = defaultdict(Counter), defaultdict(Counter), set(), []
        for _, text, lang, source, _ in rows:
            lang, source = lang or "", source or ""
            found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            seen.add((lang, source))
            n[lang, source].update(found)
            n[lang].update(found)
            docs[lang].update(set(found))
        for lang in {x for x, _ in seen}:
            kept = [t for t, d in docs[lang].items() if d >= 10]
            share = lambda g: {t: 1 + 10**9 * (n[g][t] + 2) // (sum(n[g][k] for k in kept) + 2 * len(kept)) for t in kept}
            far = lambda p, q: (p - q) ** 2 // (p + q)
            p = {s: share((lang, s)) for x, s in seen if x == lang}
            q = share(lang)
            for s in p:
                pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
                own = [(far(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
                for part, items in (("pair", pairs), ("term", own)):
                    items.sort(key=lambda x: (-x[0], x[1].encode()))
                    out += [(lang, s, part, o, v, k) for k, (v, o) in enumerate(items, 1) if part == "pair" or k <= 10]
        return sorted(out)

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int").repartition(4)
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == brute()
    assert {(x[0], x[4]) for x in got if x[0] == "yy"} == {("yy", 0)}
    assert divergence.audit(docs.where("false")).count() == 0


def test_shares_are_exact_for_large_counts():
    n, total = np.array([0, 1, 5 * 10**14, 8 * 10**15 - 1]), np.int64(8 * 10**15)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * int(x) // int(total) for x in n]


def labelled_rows():
    r = random.Random(9)
    good = lambda: " ".join("".join(r.choices("aeiourstln", k=r.randint(2, 8))) for _ in range(r.randint(20, 80))).capitalize() + "."
    bad = lambda: " ".join("".join(r.choices("AEIOURSTLN", k=r.randint(2, 8))) + "!!" for _ in range(r.randint(20, 80)))
    rows = [(i, good() if i % 3 else bad(), "en", "s", 1.0) for i in range(600)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(600) if i % 2]
    rows += [(None, "some words of no number", "en", "s", 1.0), (700, None, "en", "s", 1.0), (701, "", "en", "s", 1.0), (702, "word " * 60_000, "en", "s", 1.0), rows[0], rows[1], (1, "another text of the same number", None, None, 1.0)]
    return rows, [*labels, (3, 1, 0), (None, 1, 0), (5, None, 0), (9999, 1, 0), labels[3]]


def test_quality_by_neighbours(spark):
    rows, labels = labelled_rows()
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = neighbours.score(spark, docs, told).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    hits = [r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert len(hits) > 90 and sum(hits) >= 0.99 * len(hits)

    # Brute force: the same model, every document against every labelled one in plain Python.
    model = neighbours.fit(docs, told)
    counts, y, stands = neighbours.sample(docs, told)
    assert 0.7 < len(y) / 300 < 0.9
    text_of = {}
    for d, t, *_ in rows:
        text_of[d] = min(text_of.get(d, t or ""), t or "")
    learned = sorted(d for d, q, _ in {x for x in labels if x[1] is not None and x[0] not in (None, 3, 9999)} if zlib.crc32(str(d).encode()) % 5)
    want = [neighbours.counts_of([text_of[d].encode()])[0] for d in learned]
    assert [(t.tolist(), n.tolist()) for t, n in counts] == [(np.flatnonzero(c).tolist(), c[c > 0].tolist()) for c in want]
    vector = lambda t: neighbours.weighed(neighbours.counts_of([t.encode()]), model.idf)[0] @ model.basis
    known = [vector(text_of[d]) for d in learned]
    for r in got[:: len(got) // 25]:
        for text in {t or "" for d, t, *_ in rows if d == r.doc_id}:
            v = vector(text)
            near = sorted((round(max(0.0, float(v @ k / (np.linalg.norm(v) * np.linalg.norm(k)))), 9), i) for i, k in enumerate(known))[::-1]
            voters = [(s, i) for s, i in near if s >= near[neighbours.NEAREST - 1][0] and s > 0]
            total = sum(s**neighbours.POWER * stands[i] for s, i in voters)
            want = sum(s**neighbours.POWER * stands[i] * y[i] for s, i in voters) / total
            if abs(want - r.score) < 1e-4:
                break
        else:
            raise AssertionError((r, want))


def test_quality_without_labels_or_texts(spark):
    rows, labels = labelled_rows()
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.score for r in neighbours.score(spark, docs.limit(5), told.where("false")).collect()} == {0.5}
    assert neighbours.score(spark, docs.where("false"), told).count() == 0


def test_counts_of_terms():
    for texts in ([b"one"], [b"", b"a b", b"ab " * 50, "é É á".encode()], [b"", b""]):
        both = neighbours.counts_of(texts)
        assert [r.tolist() for r in both] == [neighbours.counts_of([t])[0].tolist() for t in texts]
        assert both[:, : neighbours.WORDS].sum(axis=1).tolist() == [len(t.split()) for t in texts]
        assert both[:, neighbours.WORDS : neighbours.AGAIN].sum(axis=1).tolist() == [max(0, len(t) - 2) for t in texts]
