import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracelode.llm import chat_format, decontam, digest, ngram_join, packing, pii, ppm, quality, token_store, toxicity
from tracelode.llm.common import fold, materialise
from tracelode.llm.components import components
from tracelode.llm.textnum import Words
from tracelode.llm.tokens import ChunkedTokenizer, chunked, tokenizer_path

BPE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
rng = random.Random(1)
VOCAB = ["".join(rng.choices("abcdeghinorst", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(VOCAB, k=n))


LONG = prose(9000, 7)
ODD = [(1, prose(60, 1)), (2, None), (3, ""), (4, "one"), (5, LONG), (6, LONG), (None, "no id here at all"), (7, "é　 a  b\n\n c<|endoftext|>"), (7, prose(60, 1)), (8, prose(60, 1)[:-9] + " x y")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated ids and texts, and columns whose names clash with ours."""
    rows = [(i, t, 0.5, "x", 1, "s") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, node string, bucket int, spans string").withColumn("n_chars", F.length("text"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", [BPE, WORD])
def test_chunked_ids_are_the_library_s(name):
    t, library = ChunkedTokenizer(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    texts = [x or "" for _, x in ODD] + [" ", "a  b", "a   b\n\n c \n d", "it's O'Neil's", "\t a b c", "a\r\n b", "x\0 y", "foo.\nBar baz.\n", "a.. b", "x_. y", " , .", "Σας ΟΔΟΣ ok", "1,000. 2", "a b <|endoftext|> c", "x<|endoftext|>, y. <|startoftext|>\n z", " <|EndOfText|> "]
    flat, n = t.encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, x in enumerate(texts):
        assert library.encode(x, add_special_tokens=False).ids == flat[at[i] : at[i + 1]].tolist(), x


def test_token_store_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    token_store.write_tokens(docs, path, tokenizer_path(BPE), 2)
    got = token_store.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    t = Tokenizer.from_file(tokenizer_path(BPE))
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start = 0
    for r, (i, x) in zip(got, order, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_store.read_token(spark, path, start - 1) == 2
    empty = str(tmp_path / "e")
    token_store.write_tokens(docs.limit(0), empty, tokenizer_path(BPE), 2)
    assert token_store.read_documents(spark, empty).count() == 0


def test_direct_codes():
    ids = np.random.default_rng(0).integers(0, 70000, 3000).astype(np.uint32)
    codes = token_store.DirectCodes(*token_store.DirectCodes.encode(ids))
    assert [codes.get(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    assert codes.range(511, 1700).tolist() == ids[511:1700].tolist() and codes.range(5, 5).tolist() == []


def test_packing(spark, docs):
    got = packing.pack_documents(docs, tokenizer_path(WORD), 1, 512).orderBy("sequence_id", "offset").collect()
    at = {}
    for r in got:
        assert r.offset == at.get(r.sequence_id, 0) and r.length <= 512
        at[r.sequence_id] = r.offset + r.length
    assert len(at) <= -(-sum(r.length for r in got) // 512) + 1
    assert sum(len(r.ids) for r in packing.sequences(packing.pack_documents(docs, tokenizer_path(WORD), 1, 512)).collect()) == 4 * sum(r.length for r in got)
    assert packing.pack_documents(docs.limit(0), tokenizer_path(WORD), 1, 512).count() == 0


def test_plan_holds_every_piece():
    counts = np.bincount(np.random.default_rng(3).integers(1, 300, 20000), minlength=301)
    chosen = packing.plan(counts, 300)
    held = np.zeros(301, int)
    for lengths, n in chosen:
        assert sum(lengths) <= 300
        for x in lengths:
            held[x] += n
    assert (held == counts).all() and sum(n for _, n in chosen) <= 1.01 * (counts * np.arange(301)).sum() / 300 + 1


def test_few_equal_pieces_share_a_sequence(spark):
    for length, n in ((1, 3), (20, 203), (20, 205), (4096, 2), (1500, 3)):
        counts = np.zeros(4097, np.int64)
        counts[length] = n
        chosen = packing.plan(counts, 4096)
        assert sum(len(x) * r for x, r in chosen) == n and sum(r for _, r in chosen) == -(-n // (4096 // length))
    empty = spark.createDataFrame([(1, ""), (2, None), (3, "")], "doc_id long, text string")
    got = packing.pack_documents(empty, tokenizer_path(WORD), 1, 4096).collect()
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got) == [0, 1, 2]


def test_digest(docs):
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    texts = [t or "" for _, t in order]
    got = sorted(digest.fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    edits = sorted((i or -1, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, _), t, n in zip(order, texts, texts[1:] + texts[:1]))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == edits
    d = digest.digest(LONG.encode())
    assert digest.likeness(d, digest.parse(digest.text_of(d))) == 1.0 and digest.fingerprints(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    role = ["system", "user", "assistant", None]
    rows = [(c, t, role[0] if t == 0 else role[1 + (t + c) % 2], f"</s>[INST] {prose(5 + 7 * (t % 9), t)} <\\s><|end|>" if t % 5 else None) for c in (1, 2, 3) for t in range(90 if c == 1 else 4)]
    rows += [(4, None, None, "x"), (4, 1, "assistant", LONG), (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(1))
    w = chat_format.windows(df, tokenizer_path(BPE), 300, 80, 3)
    assert w.where("n_tokens > 300 and not over_budget").count() == 0 and w.where("over_budget and n_turns - n_repeated > 1").count() == 0
    got = {r.conv_id: r for r in chat_format.read_back(w).collect()}
    for c in (1, 2, 3, 4):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in own if r == "assistant").encode()).hexdigest()
    assert chat_format.read_back(chat_format.windows(df.limit(0), tokenizer_path(BPE))).count() == 0


def test_decontamination_against_brute_force(spark, docs):
    items = [(i, prose(n, 100 + i)) for i, n in enumerate((12, 20, 40, 41, 3))] + [(9, None), (10, prose(20, 101))]
    near = items[2][1].split()
    near[-1] = "changed"
    texts = [(20, f"{prose(30, 5)} {items[1][1].upper()}! {prose(9, 6)}"), (21, f"{prose(50, 8)} {' '.join(near)} tail"), (22, f"x {items[4][1]} y {prose(20, 9)}"), (23, prose(80, 10))]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(rows, bench).collect()}
    assert got == {(20, 1), (20, 10), (21, 2), (22, 4)}
    assert {r.doc_id for r in decontam.clean(rows, bench).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 23, None}
    assert decontam.leaks(rows, bench.limit(0)).count() == 0 and decontam.leaks(rows.limit(0), bench).count() == 0


def test_decontamination_against_every_window(spark, monkeypatch):
    """All windows of all texts held against all items, by counting shingles; the passages in tiny pieces, the items in blocks of three."""
    monkeypatch.setattr(decontam, "PIECE", 8)
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 3)
    r = random.Random(40)
    items = [(k if k % 5 else None, prose(n, 400 + k)) for k, n in enumerate((5, 6, 9, 14, 30, 31, 45, 60, 2, 30))]
    items += [(20, items[4][1]), (21, " ".join(["same"] * 12)), (22, " ".join(items[6][1].split()[:40] + ["a", "b"]))]

    def edited(words):
        out = list(words)
        for _ in range(r.randint(0, 1 + len(out) // 20)):
            out[r.randrange(len(out))] = r.choice(VOCAB)
        return out[r.choice((0, 0, 1, 3)) : len(out) - r.choice((0, 0, 2))]

    texts = []
    for k in range(160):
        parts = [w for _ in range(r.choice((1, 1, 2, 3))) for w in [*prose(r.choice((0, 0, 4, 30)), 900 + k).split(), *edited(r.choice(items)[1].split())]]
        texts.append((k // 2 if k % 9 else None, " ".join(parts)))
    texts.append((500, " ".join(["same"] * 40)))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]

    def similarity(x, y):
        a, b = Counter(grams(x)), Counter(grams(y))
        return (a & b).total() / (a | b).total()

    want, bad = {}, set()
    for i, t in texts:
        w = t.split()
        for j, u in items:
            v = u.split()
            n = len(v)
            spans = [(0, len(w))] if 5 <= len(w) < n else [(at, n) for at in range(len(w) - n + 1)]
            for at, n in spans:
                if (s := similarity(w[at : at + n], v)) >= 0.8:
                    bad.add((i, t))
                    want[i, j] = max((s, -at, n), want.get((i, j), (0, 0, 0)))
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for n in (1, 7):
        got = {(r.doc_id, r.item_id): (r.similarity, -r.first_word, r.n_words) for r in decontam.leaks(df.repartition(n), bench.repartition(n)).collect()}
        assert got == want and len(want) > 60
    assert sorted((r.doc_id or -1, r.text) for r in decontam.clean(df, bench).collect()) == sorted((i or -1, t) for i, t in texts if (i, t) not in bad)


def test_window_sums_need_no_whole_text():
    shingles = np.random.default_rng(6).integers(0, 2**63, 9000, dtype=np.uint64)
    starts = np.array([0, 3, 2047, 2048, 5000, 8990])
    signs = decontam._signs(shingles).astype(int)
    want = np.array([np.packbits(signs[a : a + 10].sum(0) > 0) for a in starts])
    assert (decontam.window_simhash(shingles, starts, 10) == want).all()
    long = np.packbits(signs[5:8005].sum(0) > 0)
    assert (decontam.window_simhash(shingles, np.array([5]), 8000) == long).all()


def test_decontamination_finds_items_cut_short(spark):
    item, short = prose(59, 300).split(), prose(3, 301)
    texts = [(1, item[:56]), (2, item[3:]), (3, item[:40]), (4, item), (5, prose(56, 302).split()), (6, short.split()[:2])]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 3), r.first_word, r.n_words) for r in decontam.leaks(rows, bench).collect()}
    assert got == {(1, 1): (0.945, 0, 56), (2, 1): (0.945, 0, 56), (4, 1): (1.0, 0, 59)}
    assert {r.doc_id for r in decontam.clean(rows, bench).collect()} == {3, 5, 6}


def test_hamming_index_finds_all_within_radius():
    r = np.random.default_rng(2)
    items = r.integers(0, 256, (40, 32), dtype=np.uint8)
    asked = np.repeat(items, 2, 0)
    for k, row in enumerate(asked):
        bits = r.choice(256, r.integers(0, 80), replace=False)
        np.bitwise_xor.at(row, bits // 8, (1 << (bits % 8)).astype(np.uint8))
    q, i = decontam.HammingIndex(items).search(asked)
    apart = np.bitwise_count(asked[:, None] ^ items[None]).sum(2, dtype=int)
    assert set(zip(q.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontam.RADIUS))))


def test_join_against_brute_force(spark, docs):
    base = prose(120, 50).split()
    rows = [(100 + k, " ".join([*base[: k % 7], "zz", *base[k % 7 + 1 :], f"t{k}"])) for k in range(60)] + [(i, t) for i, t in ODD if i != 7 and i is not None]
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles, b = Words([t or "" for _, t in rows]).shingles()
    sets = [set(shingles[x:y].tolist()) for x, y in zip(b[:-1], b[1:])]
    link = [[j for j, t in enumerate(sets) if j != i and s and len(s & t) / len(s | t) >= 0.8] for i, s in enumerate(sets)]
    for (i, _), near in zip(rows, link):
        assert got[i].n_links == len(near)
        assert {got[rows[j][0]].class_id for j in near} <= {got[i].class_id}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    # 6 is a copy of 5, one row of 7 and 8 are near copies of 1; texts without words stay.
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t or "") for i, t in ODD if i not in (6, 8) and (i, t) != (7, prose(60, 1)))
    assert ngram_join.keep_one(docs.limit(0)).isEmpty()
    assert ngram_join.classes(docs).count() == len(ODD) and ngram_join.classes(docs.limit(0)).count() == 0


def test_join_of_rows_that_repeat_an_id_or_have_none(spark):
    x, y, z = prose(60, 70), prose(60, 71), prose(60, 72)
    rows = [(7, x), (7, y), (8, x + " near"), (9, "near " + y), (None, z), (10, z + " near"), (None, prose(60, 73)), (None, prose(60, 73)), (11, ""), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in ngram_join.classes(df).collect())
    assert got == sorted([(7, 7, 1), (7, 7, 1), (8, 7, 1), (9, 7, 1), (-1, 10, 1), (10, 10, 1), (-1, -1, 1), (-1, -1, 1), (11, 11, 0), (11, 11, 0)])
    kept = sorted((r.doc_id or -1, r.text) for r in ngram_join.keep_one(df).collect())
    assert kept == sorted([(7, x), (7, y), (10, z + " near"), (-1, prose(60, 73)), (11, "")])


def test_join_recall_at_the_threshold(spark):
    """Pairs at similarity 0.8 to 0.85 in families whose members are half alike, so that most buckets are large: none is missed of those that all pairs give."""
    r, rows = random.Random(77), []
    for family in range(3):
        base = prose(220, 800 + family).split()
        for k in range(60):
            own = base[:130] + prose(90, 10_000 + 100 * family + k).split()
            twin = list(own)
            for at in r.sample(range(130, 215, 6), 4):
                twin[at] = "changed"
            rows += [" ".join(own), " ".join(twin)]
    shingles, b = Words(rows).shingles()
    sets = [set(shingles[x:y].tolist()) for x, y in zip(b[:-1], b[1:])]
    link = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(x & y) >= 0.8 * len(x | y)}
    assert len(link) > 150 and sum(v < 0.85 for v in link.values()) > 150
    got = {q.doc_id: q for q in ngram_join.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i].class_id == got[j].class_id for i, j in link)
    assert sum(q.n_links for q in got.values()) == 2 * len(link)


def test_join_compares_large_buckets_in_full(spark, monkeypatch):
    """Pairs of near copies that share only one bucket, with many documents of the same passage, from whose leader pruning parts them."""
    features = ngram_join._features
    monkeypatch.setattr(ngram_join, "_features", lambda d: features(d).withColumn("keys", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(ngram_join, "WIDE", 16, raising=False)
    passage, rows = prose(150, 60), []
    for k in range(60):
        own = prose(110, 1000 + k)
        rows += [(2 * k, f"{passage} {own}"), (2 * k + 1, f"{passage} {own[: len(own) * 4 // 5]} {prose(15, 5000 + k)}")]
    sets = [set(x.tolist()) for x in (Words([t]).shingles()[0] for _, t in rows)]
    near = [len(x & y) / len(x | y) >= 0.8 for x, y in zip(sets[::2], sets[1::2])]
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(near) > 50
    assert [got[2 * k].class_id == got[2 * k + 1].class_id and got[2 * k].n_links == 1 for k in range(60)] == near


def test_blocks_find_all_roots_that_meet(monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 7)
    r = np.random.default_rng(8)
    base = r.integers(0, 9, (12, 96))
    sig = np.where(r.random((80, 96)) < 0.85, base[r.integers(0, 12, 80)], r.integers(9, 60000, (80, 96))).astype(np.uint16)
    least, root = ngram_join.least_matches(0.8, 1e-5), [bytes([i // 2]) for i in range(80)]
    ok = np.all([(sig[:, None, : 16 * k + 16] == sig[None, :, : 16 * k + 16]).sum(2) >= f for k, f in enumerate(least)], 0)
    for left, right in ((np.arange(80),) * 2, (np.arange(30), np.arange(30, 80))):
        link = np.zeros((40, 40), bool)
        i, j = np.nonzero(ok[np.ix_(left, right)])
        link[left[i] // 2, right[j] // 2] = link[right[j] // 2, left[i] // 2] = True
        want = ngram_join._forest(link | np.eye(40, dtype=bool))
        got = ngram_join._met(root, sig, left, right, least)
        assert {(a[0], b[0]) for a, b in got} == {(i, w) for i, w in enumerate(want.tolist()) if i != w} and got


def test_components(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    assert {r.node: r.root for r in components(e).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_ppm_against_trie(spark, docs):
    got = ppm.score_pretrained(docs).collect()
    trie, held = ppm.Trie(), {(i, t): zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, t in ODD}
    for (i, t), out in held.items():
        if not out:
            data = bytes([ppm.END] * ppm.ORDER) + (t or "").encode().translate(ppm._UPPER) + bytes([ppm.END])
            for k in range(ppm.ORDER, len(data)):
                trie.learn(data[k - ppm.ORDER : k], data[k])
    want = sorted((i or -1, trie.score(t or "", False)) for i, t in ODD)
    assert np.allclose([s for _, s in sorted((r.doc_id or -1, r.score) for r in got)], [s for _, s in want], rtol=1e-4)
    assert len(got) == len(ODD) and ppm.score_pretrained(docs.limit(0)).count() == 0
    assert abs(ppm.score_adaptive(docs.where("doc_id = 4")).first().score - ppm.Trie().score("one", True)) < 1e-9


def test_ppm_probabilities_sum_to_one():
    t = ppm.Trie(2)
    for i in range(2, 12):
        t.learn(b"abracadabra!"[i - 2 : i], b"abracadabra!"[i])
    assert abs(sum(10 ** t.log10(b"ra", s) for s in range(256)) - 1) < 1e-9


def test_classifiers(spark, docs, labels):
    rows = [(i, prose(40, i) + (" idiot moron" if i % 2 else "") if i % 3 else prose(20, i).upper() + "!!! %%% " * 9) for i in range(1000, 1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 2 == 1 and i % 3 != 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    for f, column in ((quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")):
        got = f(df, known).where("held_out").join(known, "doc_id").collect()
        assert np.mean([r.predicted == r[column] for r in got]) > 0.95
        odd = f(docs, labels).collect()
        assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
        assert f(docs, labels.limit(0)).count() == len(ODD) and f(docs.limit(0), labels).count() == 0
    spans = toxicity.score_toxicity(df, known).where("doc_id = 1001").first()
    assert [rows[1][1][s.start : s.end] for s in spans.spans] == ["idiot", "moron"]


def test_chain_marginals_against_enumeration():
    r = np.random.default_rng(5)
    e, move = r.normal(size=6), r.normal(size=(2, 2))
    weight = {}
    for y in np.ndindex(*[2] * 6):
        weight[y] = np.exp(sum(e[t] * y[t] for t in range(6)) + sum(move[y[t], y[t + 1]] for t in range(5)))
    want = [sum(w for y, w in weight.items() if y[t]) / sum(weight.values()) for t in range(6)]
    got = toxicity.log_odds(np.concatenate([e, [0.3]]), np.array([0, 6, 7]), move)
    assert np.allclose(1 / (1 + np.exp(-got[:6])), want)


def test_pii(spark, docs):
    texts = [(1, "a@b.co_x@d.e.f y"), (2, "1.2.3.4.5 256.1.1.1 x 4111 1111 1111 1111 é+1 (555) 123-4567"), (3, "password=abc123def4567890ff 4111 1111 1111 1112")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id - 1][1][s.start : s.end]) for s in r.spans if s.base] for r in pii.detect(rows).collect()}
    assert got == {1: [("email", "a@b.co"), ("email", "_x@d.e.f")], 2: [("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")], 3: []}
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == len(ODD) and red.where("doc_id = 2").first().text is None
    assert pii.redact(docs.limit(0)).count() == 0
    post = pii.estimate([("ip", (1, 1, 1, 1), 50), ("ip", (-1, 0, 0, -1), 50), ("ip", (1, 0, 0, 1), 5)])
    assert post["ip", (1, 1, 1, 1)] > 0.9 and post["ip", (-1, 0, 0, -1)] < 0.1


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, rule in PLAIN.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            out += [(kind, m.start(), m.end())] if ok else []
    return out


def test_pii_against_the_plain_rules(spark):
    r = random.Random(31)
    pieces = ["a@b.co", "x._%@y-.de.z", "@", ".", "1.2.3.4", "256.1.1.1", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "12", "7", "+1 (555) 123-4567", "+", "++49 30 1234", "555-123-4567", "é", "\U0001f600", "\n", " ", " ", "-", "tok_9f8e7d6c5b4a3f2e1d", "password=", "+4", "word", "1.1", "日本"]
    texts = [(k, "".join(r.choices(pieces, k=r.choice((1, 5, 40, 400))))) for k in range(300)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {q.doc_id: q.spans for q in pii.detect(rows).collect()}
    red = {q.doc_id: q.text for q in pii.redact(rows).collect()}
    for i, t in texts:
        assert [(x.kind, x.start, x.end) for x in got[i] if x.base] == plain_spans(t), t
        out, pos = "", 0
        for a, b, kind in sorted((x.start, x.end, x.kind) for x in got[i]):
            if a >= pos:
                out += t[pos:a] + f"<{kind}>"
            pos = max(pos, b)
        assert red[i] == out + t[pos:]
        base = [x for x in got[i] if x.base]
        assert not any(x.start < b.end and b.start < x.end for x in got[i] if not x.base for b in base)
    assert any(not x.base for spans in got.values() for x in spans)


def test_pii_time_follows_the_text(spark):
    """A text of 60,000 numbers and one of 15,000 addresses."""
    long = [(1, " ".join(str(1000 + k % 7000) + "x" for k in range(60_000))), (2, " ".join(f"10.0.{k % 250}.{k // 250}" for k in range(15_000)))]
    start = time.time()
    got = pii.redact(spark.createDataFrame(long, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].text == long[0][1] and got[1].text == " ".join(["<ip>"] * 15_000) and time.time() - start < 90


def test_fold(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)


def test_chunks_have_the_librarys_ids():
    texts = ["", " ", "end ", "\nx", "x\n", "a b\nc. D, e.\nF it's 12,5 x-ý", "z .\n q , r", "two  blanks", "tab\there", "a\xa0b", "\x01", "...", "a 's b", "日本 語, 。x", "", "a b\nc. D, e.\nF it's 12,5 x-ý"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = chunked(tokenizer_path(name))
        for _ in range(2):
            flat, n = coder.encode(texts)
            want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
            assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
        assert len(coder.encode([])[0]) == 0


def test_messages_in_one_run_are_those_of_each_text():
    r = np.random.default_rng(4)
    sizes = np.array([3, 0, 1, 700, *r.integers(0, 40, 60), 0])
    bounds, move = np.concatenate([[0], np.cumsum(sizes)]), np.array([[0.3, -4.0], [-2.0, 1.5]])
    e = r.normal(-3, 8, bounds[-1])
    got = toxicity.log_odds(e, bounds, move)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            ahead, back = toxicity.forward_backward(e[a:b, None], np.array([b - a]), move)
            assert np.allclose(got[a:b], np.log(ahead * back)[:, 0])


def test_toxic_rows_go_by_their_own_text(spark, docs, labels):
    scored = toxicity.score_toxicity(docs, labels)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == scored.where("predicted = 0").count()
    assert kept.exceptAll(docs).isEmpty()
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_digest_against_a_plain_version(spark):
    def plain(data):
        counts = [0] * digest.BUCKETS
        for at in range(len(data)):
            for k, (i, j) in enumerate(digest.PAIRS):
                if at + j < len(data):
                    counts[int(digest._T[k, 0, data[at]]) ^ int(digest._T[k, 1, data[at + i]]) ^ int(digest._T[k, 2, data[at + j]])] += 1
        cut = [sorted(counts)[q * digest.BUCKETS // 4 - 1] for q in (1, 2, 3)]
        return [sum(c > q for q in cut) for c in counts] if any(counts) else [0] * digest.BUCKETS, min(255, round(8 * math.log2(1 + len(data))))

    def near(x, y):
        step = sum((0, 1, 2, 6)[abs(a - b)] for a, b in zip(x[0], y[0]))
        return 1 - (step + min(24, abs(x[1] - y[1]))) / (6 * 128 + 24)

    texts = [(i, t or "") for i, t in ODD if i not in (None, 7)]
    got = sorted(digest.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    for r, (_, t), (_, after) in zip(got, texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        own, edited, following = (plain(x.encode()) for x in (t, t[: len(t) - half] + after[:half], after))
        d = digest.parse(r.fingerprint).tolist()
        assert (d[:-1], d[-1]) == own and r.near_edited == pytest.approx(near(own, edited)) and r.near_next == pytest.approx(near(own, following))


def test_field_climbs_the_exact_likelihood():
    """One step from the start moves every weight the way that finite differences of the likelihood say."""
    r = np.random.default_rng(12)
    features, bounds, y = r.integers(0, 6, (9, 1)).astype(np.int32), np.array([0, 4, 9]), np.array([0, 1, 1, 0, 0, 0, 1, 1, 0])

    def likelihood(w, move):
        total = 0.0
        for a, b in ((0, 4), (4, 9)):
            def weight(path):
                return math.exp(sum(w[features[a + t, 0]] * z for t, z in enumerate(path)) + sum(move[p, q] for p, q in zip(path, path[1:])))
            total += math.log(weight(tuple(y[a:b])) / sum(weight(z) for z in np.ndindex(*[2] * (b - a))))
        return total

    start = np.array([[0.0, -2.0], [0.0, -2.0]])
    w, move = toxicity.train(features, bounds, y, epochs=1)
    for k in range(6):
        up = np.zeros(6)
        up[k] = 1e-5
        slope = (likelihood(up, start) - likelihood(-up, start)) / 2e-5
        assert np.sign(w[k]) == np.sign(slope) or abs(slope) < 1e-6
    for i, j in np.ndindex(2, 2):
        up = np.zeros((2, 2))
        up[i, j] = 1e-5
        slope = (likelihood(np.zeros(6), start + up) - likelihood(np.zeros(6), start - up)) / 2e-5
        assert np.sign(move[i, j] - start[i, j]) == np.sign(slope) or abs(slope) < 1e-6


def test_sample_is_of_documents_that_exist(spark, docs):
    known = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (990, 1), (991, 1), (None, 1)], "doc_id long, quality int")
    folds = 10_000
    sample, share = quality._sampled(docs, known, "quality", folds, -1, 5, 1000)
    rows = sorted((r.doc_id, r.text, r.y) for r in sample.collect())
    assert share == pytest.approx(2 / 3)
    # 7 has two texts, one of which is that of 1; 5 is too long.
    assert rows == sorted([(1, prose(60, 1), 1), (7, ODD[7][1], 1)])


def test_pipeline_against_plain_stages(spark, tmp_path):
    r = random.Random(90)
    item = prose(40, 91)
    clean = [(k, prose(50, 1000 + k)) for k in range(60)]
    toxic = [(100 + k, f"{prose(30, 1200 + k)} idiot {prose(5, 1300 + k)} moron") for k in range(60)]
    copies = [(200 + k, clean[k][1] + (" extra" if k % 2 else "")) for k in range(20)]
    leaks = [(300 + k, f"{prose(12, 1400 + k)} {item} {prose(9, 1500 + k)}") for k in range(5)]
    private = [(400, prose(40, 1600) + " mail me@example.com now"), (400, prose(40, 1601)), (401, None), (402, ""), (None, prose(40, 1602)), (403, LONG), (403, LONG)]
    rows = [*clean, *toxic, *copies, *leaks, *private]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, b"x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h int, node binary, spans int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, int(100 <= i < 200)) for i, _ in [*clean, *toxic]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = materialise(f(spark, stage, str(tmp_path)), "test")
        assert stage.columns == docs.columns
        seen[name] = sorted((q.doc_id or -1, q.text or "") for q in stage.collect())
    tell = lambda rows: sorted((i or -1, t or "") for i, t in rows)
    assert seen["toxicity"] == tell([*clean, *copies, *leaks, *private])
    assert seen["ngram_join"] == tell([*clean, *leaks, *private[:-1]])
    assert seen["decontamination"] == tell([*clean, *private[:-1]])
    redacted = [(i, (t or "").replace("me@example.com", "<email>")) for i, t in [*clean, *private[:-1]]]
    assert seen["pii"] == tell(redacted)
    library = Tokenizer.from_file(tokenizer_path(WORD))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = Counter()
    for i, t in redacted:
        sizes[i or -1] += len(library.encode(t, add_special_tokens=False).ids) + 1
    mine = Counter()
    for q in got:
        mine[q.doc_id or -1] += q.length
    assert mine == sizes and all(q.length <= 4096 for q in got)
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
