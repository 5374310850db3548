"""Corpus operators against brute force, on hand-made rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import struct
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tempora.llm import html_extract, huffman, jaccard, mixing, pii, quality, sentencepieces, sharding, topk, warc

WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing loudly near old mill ponds every single bright morning in may".split()
LONG = " ".join(WORDS[i * i % len(WORDS)] + str(i % 97) for i in range(3000))
BASE = [f"{w}{i}" for i, w in enumerate(WORDS * 4)]
NEAR = BASE[:50] + ["changed"] + BASE[51:]
DOCS = [
    (1, None, "a"), (2, "", "a"), (3, " ".join(BASE), "b"), (4, " ".join(BASE), None), (5, " ".join(NEAR).upper(), "b"), (6, LONG, "c"), (7, "two words", "a"), (7, "two words", "a"),
    (8, "same line here\n\nsame line here\n  \nother", "c"), (9, "well " * 40, "a"), (10, "mail bob.x@mail1.example.com now, +1 (454) 555-9913 or 4495114827612972 at 92.195.224.80", "d"),
    (11, "no: 999.1.1.1 and 1234567812345678 and +12 34 x a@b", "d"), (12, "é日本 𝒳y  double\tspace ▁ <|endoftext|>", "é"), (None, "a text without any number of its own", None), (13, "!! ## ** $$ || <> & " * 9, "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "xx", s, len(t or ""), 1) for d, t, s in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality(docs, empty):
    def brute(t):
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    got = quality.apply_policy(quality.ledger(docs, ["doc_id", "text"])).collect()
    assert sorted(map(str, (brute(r.text) for r in got))) == sorted(str((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got)
    assert {r.doc_id: r.kept for r in got}[13] is False and {r.doc_id: r.kept for r in got}[3] is True
    assert quality.ledger(empty, ["doc_id"]).count() == 0
    only = {r.rule: (r.failed, r.only_this) for r in quality.ablations(quality.ledger(docs, ["doc_id"])).collect()}
    assert only["few_words"][0] == sum(len(words(t)) < 20 for _, t, _ in DOCS)


@pytest.mark.parametrize("shards", [8, 3, 1])
def test_sharding(docs, empty, shards):
    """Against a heap over the groups one by one."""
    import heapq

    got = sharding.shard(docs, shards).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in DOCS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and sharding.shard(empty).count() == 0
    groups, where = Counter(), {}
    for _, t, _ in DOCS:
        groups[t or ""] += len((t or "").encode()) + 1
    heap = [(0, s) for s in range(shards)]
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, (heap[0][0] + size, heap[0][1]))
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert sorted(loads.values()) == sorted(n for n, _ in heap if n) and all(len(s) == 1 for s in where.values())
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_lpt_is_the_heap_over_single_groups():
    classes = [(100, 7), (40, 23), (3, 500), (1, 9)]
    loads = [0] * 8
    for size, n in classes:
        for _ in range(n):
            loads[loads.index(min(loads))] += size
    planned = [0] * 8
    for size, lo, hi, s in sharding.lpt_plan(classes, 8):
        planned[s] += size * (hi - lo)
    assert sorted(planned) == sorted(loads)


def test_token_ids(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    special = [(60, "a <|endoftext|> b"), (61, "<|endoftext|>"), (62, "x<|endoftext|>y <|endoftext|><|endoftext|>\n<|endo" + " word" * 300), (63, "<|endoftext| >")]
    more = docs.sparkSession.createDataFrame(special, "doc_id long, text string")
    want = Counter()
    for d, t in [*((d, t) for d, t, _ in DOCS), *special]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert tok.encode(special[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = huffman.round_trip(docs.select("doc_id", "text").unionByName(more), path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert huffman.round_trip(empty, path).count() == 0


def test_huffman_codes():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 20000) % 5000).astype(np.uint32)
    lengths = huffman.code_lengths(dict(Counter(ids.tolist())))
    assert max(lengths.values()) <= huffman.LIMIT and sum(2.0**-n for n in lengths.values()) <= 1
    code = huffman.Code(lengths)
    data, offsets = code.pack(ids)
    assert (code.unpack(data, offsets, len(ids)) == ids).all()
    assert huffman.code_lengths({7: 3}) == {7: 1} and huffman.code_lengths({}) == {}
    many = {i: 1 + (i % 1000 == 0) * 10**6 for i in range(150_000)}  # more ids than codes of LIMIT bits
    lengths = huffman.code_lengths(many)
    code, ids = huffman.Code(lengths), rng.permutation(150_000).astype(np.uint32)
    data, offsets = code.pack(ids)
    assert max(lengths.values()) > huffman.LIMIT and (code.unpack(data, offsets, len(ids)) == ids).all()


def test_sentencepiece(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepieces.encoded(docs, path).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(d), sp.encode(t or "")) for d, t, _ in DOCS)
    back = sentencepieces.decoded(sentencepieces.encoded(docs, path), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), (t or "").replace("▁", " ")) for d, t, _ in DOCS)
    assert sentencepieces.encoded(empty, path).count() == 0


def test_sentencepiece_cuts_no_piece_at_white_space(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello world.\r\nNext", "f();\r\n\r\n  g(a),\r\n};\r\n", "a\tb \t c.\r d\r\re", "one\x0b\x0ctwo \u3000\u2028three\x85\u00a0 \r", "\r\n", " \r \n x", LONG.replace("7 ", ".\r\n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in sentencepieces.encoded(docs, path).collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}
    fst, _ = sentencepieces.coder(path)
    assert not fst.spaced and not fst.lined  # what the cuts at spaces and line feeds stand on


def handmade_model(folder, kind, pieces, fallback=True, dummy=True):
    """A model file put together by hand; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = kind
    model.trainer_spec.byte_fallback = fallback
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = dummy, False, True
    model.pieces.add(piece="<unk>", score=0, type=2)
    if fallback:
        for b in range(256):
            model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for piece, score in pieces.items():
        model.pieces.add(piece=piece, score=score, type=1)
    path = folder / f"m{kind}{int(fallback)}{int(dummy)}.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_unigram_shortest_path(spark, tmp_path, fallback, dummy):
    """Equal to the library, with and without byte fallback and a dummy prefix."""
    import random

    import sentencepiece

    rng = random.Random(5)
    letters = "abcdé▁"
    pieces = {c: -6.0 - rng.random() for c in letters} | {"".join(rng.choice(letters[:-1]) for _ in range(n)): -2.0 * n - rng.random() for n in (2, 3, 4) for _ in range(40)}
    pieces |= {"▁" + p: -5.5 - rng.random() for p in list(pieces)[8:60:3]}
    path = handmade_model(tmp_path, 1, pieces, fallback, dummy)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(rng.choice("aaabbbccdé  x日") for _ in range(rng.randrange(0, 40))) for _ in range(300)] + ["", " ", "a", "日日x", "\n a\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in sentencepieces.encoded(docs, path).collect()}
    assert got == {i: sp.encode(t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in sentencepieces.decoded(sentencepieces.encoded(docs, path), path).collect()}
    assert back == {i: sp.decode(got[i]) for i in got}


def test_lattices_side_by_side():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, fst, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Transducer(path), random.Random(3)
    names = sorted(fst.ids)
    pieces = ["▁" + "".join(rng.choice(["a", "n", "in", "é", "日", "\n", "x" * 40, "𝒳", "0", rng.choice(names)]) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    sizes, ids = fst.runs(pieces)
    at = np.cumsum(sizes) - sizes
    assert [ids[a : a + n].tolist() for a, n in zip(at, sizes, strict=True)] == [sp.encode(p[1:]) for p in pieces]
    keys = np.array([rng.randrange(len(names)) for _ in range(8000)]).reshape(-1, 2)
    told = fst.many.stay_apart(np.array([fst.ids[names[a]] * fst.many.size + fst.ids[names[b]] for a, b in keys]))
    assert told.tolist() == [fst.merged(names[a] + names[b]) == [names[a], names[b]] for a, b in keys]


def spans(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 12 <= len(d := re.sub("[^0-9]", "", h)) <= 19 and luhn(d)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(re.sub("[^0-9]", "", h)) <= 15),
    ]
    found = sorted((m.start(), k, m.end()) for k, (_, p, fine) in enumerate(kinds) for m in re.finditer(p, t or "") if fine(m[0]))
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found)


def test_personal_data(spark, docs, empty):
    more = spark.createDataFrame([(50, "a@b.c_d@e.f +1-23 45.67.89 (0)1 " + "9" * 3000 + " 1.2.3.4.5.6.7.8 é𝒳 x@y.com"), (51, "1 " * 4000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = pii.find(both, ["doc_id", "text"]).withColumn("base", pii.listed(F.filter("spans", lambda s: s["base"]))).collect()
    assert len(got) == len(DOCS) + 2
    for r in got:
        assert r.base == spans(r.text), r.text[:80]
    assert pii.find(empty, ["doc_id"]).count() == 0
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert masked[10] == "mail <email> now, <phone> or <card> at <ip>" and masked[6] == LONG


def test_personal_data_model(spark, docs):
    """Texts without hits change no weight; wider spans are added where they pass the checks and touch no base span."""
    number = "4495114827612972"
    odd = [(70, "call (743) 555-3824 now"), (71, "ring (743) 555-3824 or 743 555 3825, fax 743.555.3826"), (72, "bob at 10[.]2[.]3[.]4 or 999[.]1[.]1[.]1"), (73, f"card {number[:4]}/{number[4:8]}/{number[8:12]}/{number[12:]}"),
           (74, f"pay with {number} 86 today"), (75, "write to ann.b (at) example (dot) org"), (76, "+1 (743) 555-3824"), (77, "1234/5678/1234/5678")]
    table = spark.createDataFrame([*odd, *((80 + i, f"+1 (743) 555-38{i} and c{i}@mail.example.com") for i in range(10, 30))], "doc_id long, text string")
    empty = spark.createDataFrame([(1000 + i, "words alone" if i % 3 else None) for i in range(600)], "doc_id long, text string")
    votes = lambda t: pii.vote(pii.candidates(t, ["doc_id"]))
    alone = pii.fit(votes(table))
    both = votes(table.unionByName(empty))
    assert pii.fit(both) == alone and both.where("detector IS NULL AND form IS NULL AND kind IS NULL AND NOT base").count() == 600
    got = {r.doc_id: [(pii.KINDS[s.kind], s.hit, s.base) for s in r.spans] for r in pii.find(table.unionByName(empty), ["doc_id"]).collect()}
    assert got[70] == [("phone", "(743) 555-3824", False)] and [x[1] for x in got[71]] == ["(743) 555-3824", "743 555 3825", "743.555.3826"]
    assert got[72] == [("ip", "10[.]2[.]3[.]4", False)] and got[73] == [("card", "4495/1148/2761/2972", False)] and got[74] == [("card", number, False)]
    assert got[75] == [("email", "ann.b (at) example (dot) org", False)] and got[76] == [("phone", "+1 (743) 555-3824", True)] and got[77] == [] == got[1001] and got[1000] == []
    counts = [((1, 1, 1, 1, 1), 50), ((0, -1, -1, -1, 1), 50), ((1, 1, 0, 0, 1), 20)]
    share, table_, believed = pii.estimate(counts)
    assert 0.4 < share < 0.75 and believed[counts[0][0]] > 0.95 and believed[counts[1][0]] < 0.05 and table_[1][1][0] > table_[1][1][1]
    weights = pii.train(counts, believed)
    assert weights[2] > 0 and weights[5] == 0.0  # the labeler that always votes the same has no part


def test_personal_data_beside_columns_of_the_same_names(spark):
    names = ["spans", "uid", "start", "stop", "hit", "kind", "before", "after", "kept", "detector", "base", "__uid", "__text"]
    docs = spark.createDataFrame([(1, "mail a@b.cd now", *names), (2, None, *names)], ", ".join(["doc_id long, text string", *(f"{n} string" for n in names)]))
    got = sorted(pii.masked(docs).collect())
    assert got == [(1, "mail <email> now", *names), (2, None, *names)]
    found = pii.find(docs, names, "a", "b").where("size(b) > 0").first()
    assert list(found)[: len(names)] == names and found.b[0].hit == "a@b.cd"


def test_warc(spark):
    page = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/1", page), (2, "http://a/2", page), (2, "http://a/2", page), (3, None, "small"), (4, "http://a/4", "small"), (5, "u", None), (None, "n", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(warc.round_trip(pages)).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and i != 2
        want.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0
    extra = pages.selectExpr("*", "1 AS row", "'x' AS head", "'y' AS digest", "'z' AS type").repartition(3)
    folder = warc.scratch_path(spark, "warc-test")
    names = warc.write_archives(warc.deduplicated(extra), folder)
    records = warc.read_archives(names, folder, with_payload=True)
    assert records.count() == 3 * len(rows) == records.select("record_id").distinct().count()  # ids of records differ, of equal rows too
    assert Counter(bytes(r.payload).decode() for r in records.where("type = 'response'").collect()) == Counter((h or "") for i, _, h in rows if i == 2 or len(h or "") < 1000)
    assert records.where("type <> 'response' AND type <> 'revisit'").join(records.selectExpr("record_id AS concurrent_to"), "concurrent_to", "left_anti").count() == 0
    # a second attempt's files that no task has committed are not read
    first = names.first().name
    with open(folder.removeprefix("file://") + "/" + first, "rb") as f, open(folder.removeprefix("file://") + "/" + first.replace(".warc", "9.warc"), "wb") as g:
        g.write(f.read())
    assert warc.read_archives(names, folder).count() == 3 * len(rows)


def filled(sizes):
    """Targets by the contract's words: stop at two times the size, the excess reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names), Fraction(3, 2) * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        target |= {s: Fraction(2 * sizes[s]) if full else weight[s] * unit for s in full or free}
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    return target


@pytest.mark.parametrize("sources", [4, 1, 60])
def test_mixing(spark, empty, sources):
    """Against queues served one document at a time: the next is the copy that finishes first."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), f"s{i * i % sources}" if i % 9 else None) for i in range(800)]
    rows += [(800, None, "s0"), (5, "w w", "s1"), (5, "w w", "s1"), (None, "w w w", "s1"), (801, "w " * 900, "s2"), (802, "", "nothing"), (803, "a b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    marked = docs.select("*", F.xxhash64(F.lit(7), "doc_id", "text").alias("at")).collect()
    queues, sizes = {}, Counter()
    for r in sorted(marked, key=lambda r: r.at):
        queues.setdefault(r.source, []).append((len(words(r.text)), r.at))
        sizes[r.source] += len(words(r.text))
    target = filled(dict(sizes))
    order = []
    for s, queue in queues.items():
        done = 0
        for n, at in queue * 2:
            done += n
            if n:
                order.append((done / float(target[s]), at, n))
    budget, want = sum(sizes.values()) * 3 // 2, Counter()
    for _, at, n in sorted(order):
        if n > budget:
            break
        budget -= n
        want[at] += n
    got = mixing.mix(docs, ["doc_id", "text", "source"]).select("*", F.xxhash64(F.lit(7), "doc_id", "text").alias("at")).collect()
    taken = Counter()
    for r in got:
        taken[r.at] += r.taken
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and r.target == float(target[r.source]) and r.taken <= 2 * r.size
    assert len(got) == len(rows) and +taken == want
    plan = mixing.schedule(docs, ["doc_id", "text"])
    assert plan.count() == sum(r.taken // r.size for r in got if r.size)
    again = mixing.mix(docs.repartition(2, "text"), ["doc_id", "text"]).select("doc_id", "text", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, (Row(doc_id=r.doc_id, text=r.text, taken=r.taken) for r in got)))
    assert mixing.mix(empty, ["doc_id"]).count() == 0 and mixing.mix(docs.where("source = 'nothing'"), ["doc_id"]).first().taken == 0


def test_html_extraction(spark):
    model = html_extract.train()
    right = 0
    for source in html_extract.sample_pages(120, seed=5):
        page, _, want = html_extract.labelled(source)
        right += page.decode(model.predict(page.features())) == want
    assert right >= 108
    page = "<html><body><nav><ul><li><a href='/a'>menu</a></ul></nav><div class='ad'>buy now</div><article><h1>A  title &amp; more</h1><p><b>First\n line<br><p>Second &eacute;</p><script>x<p>y</script></article><footer>&copy; me</footer>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {1: ("A title & more\nFirst line\nSecond é", 34), 2: ("", 0), 3: ("", 0)}


@pytest.mark.parametrize("split", [False, True])
def test_jaccard_join(spark, docs, empty, monkeypatch, split):
    if split:  # lists in blocks of a few rows, nearly all tokens frequent, no links before lists are compared
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", 6)
        monkeypatch.setattr(jaccard, "LOOKED", 2)
        monkeypatch.setattr(jaccard, "MANY", 2)
        monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", 1)
    rng = np.random.default_rng(1)
    bases = [[f"w{x}" for x in rng.integers(0, 5000, 60)] for _ in range(12)]
    rows = []
    for i in range(240):
        w = list(bases[i % 12])
        for j in rng.integers(0, 60, i // 12 % 4):
            w[j] = f"z{rng.integers(0, 9)}"
        rows.append((100 + i, " ".join(w)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [*((d, t) for d, t, _ in DOCS), *rows]
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words((t or "").translate(low))) else frozenset() for _, t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both_have = len(sets[i] & sets[j])
            if sets[i] and 100 * both_have >= 80 * (len(sets[i]) + len(sets[j]) - both_have):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(texts, label):
        least[x] = min((y for y in (least.get(x), d) if y is not None), default=None)
    want = Counter((d, len(s), least[x]) for (d, _), s, x in zip(texts, sets, label))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(both).collect()) == want
    assert jaccard.join(empty).count() == 0


def test_rows_in_parts(monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 50)
    rng = np.random.default_rng(4)
    h, k = rng.integers(0, 60, 900).astype(np.uint64), rng.integers(0, 99, 900).astype(np.uint64)
    parts = list(jaccard.in_parts(0, h, k))
    assert len(parts) > 9 and sorted(zip(*(np.concatenate(c) for c in zip(*parts)))) == sorted(zip(h, k))
    assert sum(len(set(p[0])) for p in parts) == len(set(h))
    blob = np.concatenate([h, k]).tobytes()
    hits = lambda: Counter({(int(k1), n) for b in jaccard.first_count(iter([pa.RecordBatch.from_pylist([{"data": blob}], jaccard._FIRST)])) for k1, n in zip(b.column("k1").to_pylist(), b.column("hits").to_pylist())})
    total = Counter()
    for (k1, n), times in hits().items():
        total[k1] += n * times
    monkeypatch.setattr(jaccard, "PART", 10**6)
    assert {k1 for k1, _ in hits()} == set(total)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK_ROWS", 200)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 16).astype(float).tolist()) for i in range(700)]
    rows += [(800, None), (850, [1.0, None]), (900, [float("nan")] * 16), (50, rows[0][1]), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for n, (i, q) in enumerate(fine):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(fine) if m != n)[:5]
            want.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(best))
    assert Counter((q, *x) for q, xs in got.items() for x in xs) == want
    assert topk.search(table.where("false")).count() == 0


def test_topk_of_odd_vectors(spark):
    """Ragged and empty vectors count as padded with zeros, null ids come last of equals, sums beyond 2^53 are exact."""
    big = 2.0**46  # times 256 and another such: no float64 holds the sum
    rows = [(0, [1.0, 2.0, 3.0], "x"), (50, [], "x"), (None, [1.0, 2.0], "x"), (None, [1.0, 2.0], "x"), (3, [1.0, 2.0, 0.0], "x"), (100, [big, 2.0**-8], "x"), (101, [2.0**-8, 1.0], "x"), (102, [2.0**-8], "x"), (103, [2.0**-8, 2.0], "x")]
    got = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vec = [[int(np.floor(256 * x)) for x in v] for _, v, _ in rows]
    for n, (i, _, _) in enumerate(rows):
        if i is not None and i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(vec[n], vec[m])), j is None, j or 0) for m, (j, _, _) in enumerate(rows) if m != n)[:3]
            assert sorted(got[i]) == [(rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(best)]


def test_one_row_of_a_component_stays(spark, docs, tmp_path):
    import corpus_pipeline

    other = [f"o{i}" for i in range(60)]
    rows = [
        (None, " ".join(BASE[::-1]), "x"), (None, " ".join(other), "x"), (None, " ".join(other), "x"), (None, " ".join(["new", *other]), "x"),  # components without an id
        (3, "some text that has nothing in common with the other one of this id", "y"), (20, " ".join(BASE[20:]), "z"), (21, " ".join(BASE[20:]), "a"), (21, " ".join(BASE[20:]), "b"),
        (30, "one row that stands here three times over and over", "b"), (30, "one row that stands here three times over and over", "a"), (30, "one row that stands here three times over and over", "a"),
        (31, None, "n"), (31, None, "n"), (None, "", "n"),
    ]
    extra = spark.createDataFrame([(d, t, "xx", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    every = [*DOCS, *rows]
    docs.select(*corpus_pipeline.COLUMNS).unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    low = [words((t or "").translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))) for _, t, _ in every]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in low]
    label = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    marks = [r.m for r in spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(every)], "i long, t string").orderBy("i").select(F.xxhash64("t").alias("m")).collect()]
    best = {}
    for i, (d, t, s) in enumerate(every):
        if sets[i]:
            best[label[i]] = min(best.get(label[i], (True, 1e30, 1e30, "~", i)), (d is None, d or 0, marks[i], s or "", i))
    want = Counter(every[x[-1]] for x in best.values()) + Counter(every[i] for i in range(len(every)) if not sets[i])
    got = corpus_pipeline.near_duplicates(spark, table, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == want
    assert corpus_pipeline.near_duplicates(spark, table.where("false"), str(tmp_path)).count() == 0


def test_html_embedded_elements_keep_the_article(spark):
    text = lambda i: f"Paragraph {i} " + " ".join(WORDS)
    for tag in sorted(html_extract.EMBEDDED | {"math"}):
        for begin in (f"<{tag} class=x>", f"<{tag}><{tag}>a</{tag}>"):  # never closed, and closed once of twice
            page = f"<html><body><nav><a href=/>menu</a></nav><article><h1>Title of it</h1><p>{text(1)}</p>{begin}<p>{text(2)}</p><p>{text(3)}</p></article></body></html>"
            runs = [t for _, t in html_extract.Page(page).runs]
            assert text(2) in " ".join(runs) and text(3) in runs, (tag, runs)
    formula = "<article><p>" + text(1) + " where <math><mi>x</mi><mo>=</mo><mn>5</mn></math> holds</p><noscript><p>" + text(2) + "</p></noscript><object data=a><p>" + text(3) + "</p></object><script>var a<p>b</script><p>" + text(4) + "</p><script>c<p>d</p></article>"
    pages = spark.createDataFrame([(1, "u", formula)], "page_id long, url string, html string")
    assert html_extract.extract(pages).first().text.split("\n") == [text(1) + " where x=5 holds", text(2), text(3), text(4)]


def test_html_without_block_elements(spark):
    text = "A page without any block of its own, " + " ".join(WORDS)
    bare = [text, f"<b>{text}</b>", f"<html>{text}</html>", f"{text[:40]}<br>{text[41:]}", f"<i>{text}</i><!-- no more -->"]
    for source in bare:
        page = html_extract.Page(source)
        assert [(page.tag[n], t) for n, t in page.runs] == [("#text", text)]
        assert page.decode(np.ones(len(page.tag))) == text == page.decode(np.zeros(len(page.tag)))
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(bare)], "page_id long, url string, html string")
    assert {(r.text, r.n_chars) for r in html_extract.extract(pages).collect()} == {(text, len(text))}


def test_html_of_odd_rows_and_long_pages(spark):
    """Null ids, repeated rows, columns with the names of the result, and tags that close nothing."""
    body = "<article>" + "".join(f"<p>Sentence {i} of a long enough paragraph, with words and a full stop.</p>" for i in range(8)) + "</article>"
    rows = [(None, "u", body, "x", 1), (2, None, body, "x", 1), (2, None, body, "x", 1), (3, "u", None, None, None), (4, "u", "", "x", 1), (5, "u", ("<div>" + "</p></td>") * 40_000 + body, "x", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id or 0) for r in got) == [0, 2, 2, 3, 4, 5]
    of = {r.page_id: r for r in got}
    want = "\n".join(f"Sentence {i} of a long enough paragraph, with words and a full stop." for i in range(8))
    assert of[None].text == of[2].text == want and of[None].n_chars == len(want)
    assert (of[3].text, of[3].n_chars, of[4].text, of[4].n_chars) == ("", 0, "", 0)


def test_html_parser_takes_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html_extract.Page("<div>" * n + "</p>" * n + "<body><li></td>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


def test_pipeline_from_end_to_end(spark, tmp_path):
    """run() on the smallest table: each stage against plain Python on what the stage before it left."""
    import corpus_pipeline
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = docs.collect()
    first = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def kept(t):
        w, t = words(t), t or ""
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = len({i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)})
        n, letters = len(w), [c for c in t if c.isascii() and c.isalpha()]
        bad = [
            n < 20, 100 * covered > 30 * n, 100 * sum(c in "#*$%&|<>" for c in t) > 20 * n, 100 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 25 * n,
            100 * sum(c.isupper() for c in letters) > 60 * len(letters), 100 * t.count("!") > 60 * n, sum(map(len, w)) > 40 * n,
        ]
        return not any(bad)

    assert Counter(map(tuple, left["quality_rules"])) == Counter(tuple(r) for r in first if kept(r.text))
    # One document of each group stays, and none of it is changed.
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    shingles = lambda t: frozenset(tuple(w[i : i + 5]) for w in [words(low(t))] for i in range(max(1, len(w) - 4)))
    before, sets = left["quality_rules"], [shingles(r.text) for r in left["quality_rules"]]
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for r, x in zip(before, label, strict=True):
        groups.setdefault(x, []).append(r.doc_id)
    assert sorted(r.doc_id for r in left["near_duplicates"]) == sorted(min(g) for g in groups.values())
    assert {tuple(r) for r in left["near_duplicates"]} <= {tuple(r) for r in before}
    # Personal data: every document stays, clean ones as they were, and no address of mail is left.
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    texts = {r.doc_id: r.text for r in left["near_duplicates"]}
    after = {r.doc_id: r.text for r in left["personal_data"]}
    assert set(after) == set(texts) and not any(mail.search(t) for t in after.values()) and any(mail.search(t) for t in texts.values())
    assert all(after[i] == t for i, t in texts.items() if not re.search(r"[0-9@+]", t))
    # The mix takes whole documents, none more than twice, and comes out the same again.
    times = Counter(r.doc_id for r in left["mixing"])
    assert set(times) <= set(after) and max(times.values()) <= 2 and all(after[r.doc_id] == r.text for r in left["mixing"])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = left["sentencepiece"]
    assert Counter(r.doc_id for r in last) == times
    assert all(list(r.ids) == library.encode(after[r.doc_id]) and r.n_tokens == len(r.ids) for r in last)
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == Counter((r.doc_id, tuple(r.ids)) for r in last)
