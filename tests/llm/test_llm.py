"""Text operators against brute force, library results and exact round trips."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratum.llm import bpe, kdshards, langid, lines, matroska, packing, sampling, shingles, suffixes, windows
from stratum.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
#: Extra columns named like the operators' own; none may matter.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kid bigint, h string, z binary, class string, pid int, ids string"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None, None, "x", b"z", "c", 1, "ids") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{i % 977}" for i in range(30000))
ODD = [None, "", " \n\t ", "a", "\x00\x01", LONG, LONG, "x" * 5000, "é日本 😀 text with <|endoftext|> inside", "same line one\nsame line two\nsame line three\nsame line four", "same line one\nsame line two\nsame line three\nsame line four", None, "Only punctuation: ... !!! ???"]


@pytest.fixture(scope="module")
def real():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []) if False else spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(spark, real, odd, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    own = bpe.load(vocabulary())
    rnd = random.Random(1)
    texts = [t for _, t, _ in real[:60]] + [t or "" for t in ODD if t is not LONG] + ["".join(rnd.choice("aeΣσς'stİÉé \n\t\x1d\x85.,!12½日😀ẞ<|>endoftextﬁÅ") for _ in range(rnd.randrange(40))) for _ in range(400)]
    newer = [0x88F, 0x1C89, 0xA7CB, 0xA7DC, 0x10D50, 0x11DB0, 0x16EA0, 0x16EBB, 0x1E6C0, 0x323B0]
    texts += ["".join(rnd.choice("ab é1.\x01" + "".join(map(chr, newer))) for _ in range(rnd.randrange(30))) for _ in range(100)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)
    got = bpe.encode_documents(odd, vocabulary()).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_documents(empty, vocabulary()).count() == 0


def test_bpe_long_words_match_short_ones():
    own = bpe.load(vocabulary())
    rnd = random.Random(2)
    for _ in range(50):
        parts = [own.inner[b] for b in bytes(rnd.choice(b"theanire") for _ in range(rnd.randrange(1, 80)))]
        assert own.merge_short(list(parts)) == own.merge_long(list(parts))


def test_words_are_merged_once_and_equal_the_library(real, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    rnd = random.Random(3)
    texts = [t for _, t, _ in real[:40]] + [t or "" for t in ODD if t is not LONG] + ["".join(rnd.choice("aeΣσς'stİÉé \n\t\x1d\x85.,!12½日😀ẞ<|>ﬁÅ\u088f") for _ in range(rnd.randrange(40))) for _ in range(300)]
    for memory in (8, 100_000):
        own = bpe.WordBpe(vocabulary(), memory, library=True)
        for t in texts:
            assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
    merged = []
    monkeypatch.setattr(own, "encode_piece", lambda piece, f=own.encode_piece: merged.append(piece) or f(piece))
    want = lib.encode("zyzzyvas zyzzyvas, zyzzyvas. Zyzzyvas!", add_special_tokens=False).ids
    assert own.encode("zyzzyvas zyzzyvas, zyzzyvas. Zyzzyvas!") == want
    assert merged.count("zyzzyvas") == 1


def test_suffixes_equal_brute_force(spark, empty):
    rnd = random.Random(4)
    configs = [suffixes.SuffixConfig(length=40, window=16, run_rows=50, block_rows=60, **hot) for hot in ({}, {"hot_rows": 3, "slices": 4}, {"hot_rows": 1, "slices": 16}, {"hot_rows": 8, "slices": 3})]
    base = ["".join(rnd.choice("abcdé \n") for _ in range(120)) for _ in range(4)]
    texts = [None, "", "short", "a" * 150, base[0], base[0]] + [rnd.choice(base)[rnd.randrange(40) :] + "".join(rnd.choice("xyz") for _ in range(9)) + rnd.choice(base)[: rnd.randrange(30, 120)] for _ in range(40)]
    for config in configs:
        got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.remove_repeats(docs_of(spark, texts), config).collect()}
        assert [got[i] for i in range(len(texts))] == suffixes.brute_force(texts, 40)
    assert suffixes.remove_repeats(empty, config).count() == 0


def test_few_repeats_do_not_put_two_workers_into_a_task(spark):
    passage = " ".join(f"again{i}" for i in range(60))
    docs = docs_of(spark, [f"one {passage}", f"two {passage}", "three"])
    for config in (suffixes.SuffixConfig(length=256, words=51, keep_one=True), suffixes.SuffixConfig()):
        left = suffixes.remove_repeats(docs, config)
        assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 3


def test_loser_tree_orders_and_measures(spark):
    rnd = random.Random(6)
    for _ in range(40):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(rnd.randrange(0, 15))) for _ in range(rnd.randrange(1, 7))]
        lcp = lambda a, b: next((k for k in range(12) if a[k] != b[k]), 12)
        tree = suffixes.LoserTree([(r, [0] + [lcp(a, b) for a, b in zip(r, r[1:], strict=False)]) for r in runs])
        out = [(runs[r][i], p) for r, i, p in tree.merged()]
        assert [k for k, _ in out] == sorted(k for r in runs for k in r)
        assert all(p == lcp(a, b) for (a, _), (b, p) in zip(out, out[1:], strict=False))


def test_shingle_components_equal_brute_force(spark, real, empty):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(30, 120))] for _ in range(6)]
    texts = list(ODD)
    for _ in range(90):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t))
    for rows in ([(i, t) for i, t in enumerate(texts)], [(d, t) for d, t, _ in real]):
        got = shingles.similarity_components(docs_of(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == shingles.brute_force(rows)
    assert shingles.similarity_components(empty).count() == 0


def test_count_tree_never_loses_a_pair():
    rnd = np.random.default_rng(3)
    config = shingles.ShingleConfig(leaf=4)
    sets = []
    for _ in range(30):
        base = rnd.integers(0, 1 << 40, 60).astype(np.uint64)
        sets += [np.unique(np.where(rnd.random(60) < 0.08, rnd.integers(0, 1 << 40, 60).astype(np.uint64), base)) for _ in range(5)]
    points = np.stack([shingles.count_vector(s, 64) for s in sets])
    sizes = np.array([s.size for s in sets])
    found = {tuple(sorted(p)) for u, v in shingles.CountTree(points, sizes, np.arange(len(sets)), config).pairs() for p in zip(u.tolist(), v.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            if config.linked(np.intersect1d(sets[i], sets[j]).size, sizes[i], sizes[j]):
                assert (j, i) in found


def test_lines_equal_brute_force(spark, real, odd, empty):
    rnd = random.Random(9)
    pool = [f"line {i} of the pool" for i in range(40)]
    texts = []
    for _ in range(60):
        s = rnd.randrange(30)
        texts.append("\n".join([rnd.choice(pool), *pool[s : s + rnd.randrange(2, 9)], rnd.choice(pool)]))
    rows = list(enumerate([*texts, *(t for _, t, _ in real)]))
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs_of(spark, [t for _, t in rows])).collect()}
    assert got == lines.brute_force(rows)
    assert lines.dedup_lines(odd).count() == len(ODD) and lines.dedup_lines(empty).count() == 0


def test_matroska_round_trip_and_lacings(spark, odd, empty):
    for t in ODD:
        payload = matroska.padded((t or "").encode())
        stored = matroska.mux(payload)
        media = matroska.parse(stored)
        assert media.error is None and len(payload) % 192 == 0 and payload
        assert matroska.read_back(stored, media) == payload
        assert [c for _, _, c in media.cues] == media.clusters and len(media.packets) == len(payload) // 192
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d"]
    xiph = bytes([3]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    steps = [len(b) - len(a) for a, b in zip(frames, frames[1:-1], strict=False)]
    two = lambda n: (n | 1 << 14).to_bytes(2, "big")
    ebml = bytes([3]) + two(len(frames[0])) + b"".join(two(s + (1 << 13) - 1) for s in steps)
    for kind, head in ((1, xiph), (3, ebml)):
        block = b"\x81" + struct.pack(">h", -3) + bytes([kind << 1]) + head + b"".join(frames)
        cluster = matroska.uint(matroska.TIMESTAMP, 10) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
        unknown = matroska.write_id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + matroska.TRACK_TABLE + matroska.write_id(matroska.CLUSTER) + b"\xff" + cluster + matroska.element(matroska.CUES, b"")
        media = matroska.parse(matroska.HEADER + unknown)
        data = matroska.HEADER + unknown
        assert media.error is None and [data[a : a + n] for _, _, a, n, _ in media.packets] == frames
        assert media.packets[0][1] == 7_000_000
    assert matroska.parse(None).error and matroska.parse(b"\x1a\x45\xdf\xa3\x80\x18").error
    table = matroska.packet_table(matroska.store_documents(odd))
    assert table.count() == sum(len(matroska.padded((t or "").encode())) // 192 for t in ODD)
    got = matroska.media_digests(odd).collect()
    assert all(r.tail_crc32 == zlib.crc32(matroska.padded((ODD[r.doc_id] or "").encode())[-16:]) for r in got)
    assert matroska.media_digests(empty).count() == 0


def test_language_of_held_out_texts(spark, real):
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(d, lang) for d, _, lang in real if got[d].held_out]
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.95 * len(held)


def test_language_edge_cases(spark, odd, empty):
    labelled = docs_of(spark, ["the cat and the dog"] * 4 + ["und der hund ist"] * 3).withColumn("lang", F.when(F.col("doc_id") < 4, "en").otherwise("de"))
    model = langid.fit(labelled, langid.LanguageConfig(bits=14))
    assert model.languages == ["de", "en"]
    got = [r.lang_pred for r in langid.identify(docs_of(spark, ["the dog", "der hund", None, "", "123 !", "日本"]), model).orderBy("doc_id").collect()]
    assert got == ["en", "de", "und", "und", "und", "en"]
    none = langid.fit(labelled.where("false"))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    kept = langid.keep_identified(docs_of(spark, ["the dog", None, "123"]), model)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == odd.columns


def test_filters_return_all_languages_of_a_gram():
    config = langid.LanguageConfig(bits=12)
    grams = {f"l{k:03}": np.arange(k * 10, k * 10 + 15, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(70)}
    model = langid.build(grams, dict.fromkeys(grams, 1), config)
    found = model.lookup(grams["l069"])
    assert found.shape[1] == 2 and all(f[1] >> np.uint64(5) & np.uint64(1) for f in found)


def test_shards_are_even_and_keep_groups(spark, odd, empty):
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("abc é\n") for _ in range(rnd.randrange(1, 400))) for _ in range(1500)] + ["copy of one text"] * 60 + [None, ""]
    got = kdshards.kd_shards(docs_of(spark, texts), leaves=16).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    assert len(got) == len(texts) and set(size) == set(range(16))
    assert max(size.values()) < 1.06 * sum(size.values()) / 16
    assert len({r.shard for r in got if texts[r.doc_id] == "copy of one text"}) == 1
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert kdshards.kd_shards(odd, leaves=5).count() == len(ODD) and kdshards.kd_shards(empty, leaves=16).count() == 0
    assert kdshards.kd_shards(odd, target_bytes=100_000).agg(F.max("shard")).first()[0] >= 3


def plain_tree(rows, leaves):
    """Shard of each row (size, keys by dimension, id) by sorting at every node."""
    if leaves == 1:
        return {r[2]: 0 for r in rows}
    spans = {d: max(r[1][d] for r in rows) - min(r[1][d] for r in rows) for d in kdshards.DIMENSIONS}
    by = max(kdshards.DIMENSIONS, key=lambda d: (spans[d], d))
    goal, below = sum(r[0] for r in rows) * (leaves // 2) / leaves, 0
    weight = Counter()
    for size, keys, _ in rows:
        weight[keys[by]] += size
    for key, n in sorted(weight.items()):
        if below + n >= goal:
            break
        below += n
    cut = key + (goal - below > n / 2)
    left, right = [r for r in rows if r[1][by] < cut], [r for r in rows if r[1][by] >= cut]
    return plain_tree(left, leaves // 2) | {k: s + leaves // 2 for k, s in plain_tree(right, leaves - leaves // 2).items()}


def test_shards_equal_a_plain_tree(spark, real):
    docs = docs_of(spark, [t for _, t, _ in real])
    rows = kdshards.keyed(kdshards.measured(docs)).collect()
    want = plain_tree([(r.size, {d: r[f"key_{d}"] for d in kdshards.DIMENSIONS}, r.doc_id) for r in rows], 7)
    assert {r.doc_id: r.shard for r in kdshards.kd_shards(docs, leaves=7).collect()} == want


def reference_fingerprint(text):
    """The same samples in plain Python."""
    import re

    mask = (1 << 64) - 1

    def hash_long(x, seed):
        return xxhash.xxh64_intdigest(struct.pack("<q", x), seed)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    words = Counter(w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w)
    out = []
    for k in range(sampling.SAMPLES):
        best = None
        for w, n in words.items():
            term = signed(xxhash.xxh64_intdigest(w.encode(), 42))
            first = xxhash.xxh64_intdigest(struct.pack("<i", k), hash_long(term, 42))
            second = xxhash.xxh64_intdigest(struct.pack("<i", 1), first)
            u = lambda h, p: ((h >> 21 * p & (1 << 21) - 1) + 0.5) / (1 << 21)
            r, c, beta = -math.log(u(first, 0) * u(first, 1)), -math.log(u(second, 0) * u(second, 1)), u(first, 2)
            t = math.floor(math.log(1 + math.log(n)) / r + beta)
            a = math.floor((math.log(c) - r * (t - beta + 1)) * sampling.STEPS)
            name = hash_long(t, hash_long(term, 42)) & mask & (1 << sampling.NAME_BITS) - 1
            best = min(best, (a, name)) if best else (a, name)
        out.append(f"{best[1]:06x}" if best else "")
    return "".join(out)


def test_counts_beyond_their_type_bound_nothing(spark):
    s = np.arange(70_000, dtype=np.uint64)
    tree = shingles.CountTree(np.stack([shingles.count_vector(s, 1)] * 2), np.array([s.size] * 2), np.arange(2), shingles.ShingleConfig())
    assert [(int(u[0]), int(v[0])) for u, v in tree.pairs()] == [(0, 1)]
    rnd = random.Random(18)
    texts = [" ".join(f"w{k}" for k in rnd.sample(range(10**6), 3000)) for _ in range(3)]
    texts += [t.replace(" ", " other ", 2) for t in texts] + [t + " last" for t in texts]
    config = shingles.ShingleConfig(groups=8, fine_groups=8, counter="u1")
    got = {r.doc_id: r.component_id for r in shingles.similarity_components(docs_of(spark, texts), config).collect()}
    assert got == {d: c for d, (_, c) in shingles.brute_force(list(enumerate(texts))).items()}


def test_sets_of_millions_of_shingles_meet():
    rnd = np.random.default_rng(28)
    base = np.unique(rnd.integers(0, 1 << 63, 4_400_000).astype(np.uint64))
    sets = [base, np.unique(np.concatenate((base[:4_300_000], rnd.integers(0, 1 << 63, 50_000).astype(np.uint64)))), rnd.integers(0, 1 << 63, 1000).astype(np.uint64)]
    config = shingles.ShingleConfig()
    for groups, counter in ((config.groups, config.counter), (config.fine_groups, config.fine_counter)):
        points = np.stack([shingles.count_vector(s, groups, counter) for s in sets])
        tree = shingles.CountTree(points, np.array([s.size for s in sets]), np.arange(3), config)
        assert [sorted((int(u[0]), int(v[0]))) for u, v in tree.pairs()] == [[0, 1]]
        assert tree.partnered().tolist() == [True, True, False]


def test_weighted_samples(spark, odd, empty):
    texts = ["the cat sat on the mat. The cat!", "a different text, with words and words", "", None, "one", "the cat sat on the mat. The cat!"]
    got = sampling.neighbour_fingerprints(docs_of(spark, texts)).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        t, nxt = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == reference_fingerprint(t) and r.edited_fingerprint == reference_fingerprint(edited)
    assert got[0].fingerprint == got[5].fingerprint and got[2].near_next == 1.0 and got[5].near_next == 1.0
    assert sampling.neighbour_fingerprints(odd).count() == len(ODD)
    assert sampling.neighbour_fingerprints(empty).count() == 0
    assert sampling.neighbour_fingerprints(docs_of(spark, ["alone here"])).first().near_next == 1.0


def test_packing_covers_every_id(spark, odd, empty, real):
    own = bpe.load(vocabulary())
    texts = [*ODD, *(t for _, t, _ in real)]
    for config in (packing.PackingConfig(), packing.PackingConfig(length=64, stretch=16, segment=900)):
        got = packing.pack_documents(docs_of(spark, texts), vocabulary(), config).collect()
        pieces, sequences = {}, {}
        for r in got:
            pieces.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append(r)
        assert set(pieces) == set(range(len(texts)))
        for d, rows in pieces.items():
            ids = np.array([*own.encode(texts[d]), config.end_id], "<u4")
            at = 0
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == ids.size and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == ids.size
        for rows in sequences.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at and r.length > 0
                at += r.length
            assert at <= config.length
    assert packing.pack_documents(empty, vocabulary()).count() == 0


def test_cuts_are_cheapest():
    rnd = random.Random(12)
    for _ in range(200):
        n = rnd.randrange(2, 14)
        gaps = [rnd.randrange(1, 8) for _ in range(n)]
        places = np.concatenate(([0], np.cumsum(gaps)))
        cost = np.array([0] + [rnd.randrange(0, 9) for _ in range(n)])
        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + 10 - int(places[j] - places[i]) + int(cost[j]) for i in range(j) if places[j] - places[i] <= 10)
        at = [0, *packing.cuts(places, cost, 10, True)]
        price = dict(zip(places.tolist(), cost.tolist(), strict=True))
        assert sum(10 - (b - a) + price[b] for a, b in zip(at, at[1:], strict=False)) == best[n]


def test_passages_shared_by_documents_are_found(spark, odd, empty):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    near = list(passage)
    near[30] = "changed"
    texts = []
    for k in range(40):
        body = [word() for _ in range(rnd.randrange(80, 300))]
        if k < 4:
            at = rnd.randrange(len(body))
            body[at:at] = near if k == 3 else passage
        texts.append(" ".join(body))
    texts.append(texts[10])
    got = windows.near_passages(docs_of(spark, texts)).collect()
    assert {r.doc_id for r in got} | {r.partner_id for r in got} == {0, 1, 2, 3, 10, 40}
    for r in got:
        w, p = texts[r.doc_id].split(), texts[r.partner_id].split()
        a, b = {tuple(w[i : i + 5]) for i in range(r.start_word, r.end_word - 4)}, {tuple(p[i : i + 5]) for i in range(r.partner_start, r.partner_end - 4)}
        assert len(a & b) / len(a | b) >= 0.75 and r.end_word - r.start_word >= 50
    assert windows.near_passages(empty).count() == 0
    assert {(r.doc_id, r.partner_id, r.kind) for r in windows.near_passages(odd).collect()} == {(6, 5, "copy")}


def planted(groups, size, words, seed):
    """Texts that hold one edited copy of their group's passage, and the pairs of texts whose copies
    reach the similarity, by brute force."""
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(20000)}"
    texts, sets = [], []
    for g in range(groups):
        passage = [word() for _ in range(words)]
        for k in range(size):
            copy = list(passage)
            copy[rnd.randrange(words)] = f"new{g}_{k}"
            body = [word() for _ in range(rnd.randrange(80, 300))]
            at = rnd.randrange(len(body))
            body[at:at] = copy
            texts.append(" ".join(body))
            sets.append({tuple(copy[i : i + 5]) for i in range(words - 4)})
    pairs = [(a, b) for b in range(len(texts)) for a in range(b - b % size, b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return texts, pairs


def test_near_passages_are_recalled(spark):
    for groups, size, words, least in ((150, 2, 100, 0.97), (30, 8, 60, 0.95)):
        texts, pairs = planted(groups, size, words, 27)
        up = list(range(len(texts)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for r in windows.near_passages(docs_of(spark, texts)).collect():
            up[find(r.doc_id)] = find(r.partner_id)
        assert len(pairs) > 100 and sum(find(a) == find(b) for a, b in pairs) >= least * len(pairs)


def test_all_texts_of_a_signature_group_meet():
    config, rnd = windows.WindowConfig(), random.Random(5)
    w = np.zeros(30 + 100, windows.WINDOW)
    w["h"], w["d"], w["l"], w["r"], w["c"] = [7] * 30 + [8] * 100, [*range(30), *range(100)], 60, 60, 100
    # no context is met twice
    w["p"], w["q"] = rnd.sample(range(1 << 20), 130), rnd.sample(range(1 << 20), 130)
    small, large = windows.ties(w[:30], config), windows.ties(w[30:], config)
    assert {tuple(sorted(x)) for x in zip(small["a"].tolist(), small["b"].tolist())} == {(a, b) for b in range(30) for a in range(b)}
    assert {0, *large["a"].tolist(), *large["b"].tolist()} == {*range(100)} and large.size < 500


def test_compact_windows_by_definition():
    rnd = np.random.default_rng(15)
    config = windows.WindowConfig(words=14, functions=2, near=3)
    x = rnd.integers(0, 40, 120).astype(np.uint64)
    got = windows.compact_windows(x, config)
    for f in range(2):
        v = shingles.mixed(x + np.uint64((f + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        key = [(int(h) >> 24, i) for i, h in enumerate(v)]
        want = {}
        for c in range(x.size):
            left, right = c, c
            while left and key[left - 1] > key[c]:
                left -= 1
            while right + 1 < x.size and key[right + 1] > key[c]:
                right += 1
            if right - left + 1 >= config.least:
                want[c] = (c - left, right - c)
        assert {int(w["c"]): (int(w["l"]), int(w["r"])) for w in got[got["f"] == f]} == want


def reaches(x, y, config):
    """Brute force: whether stretches of the least length or more reach the similarity."""
    least = config.least
    for b in range(x.size - least + 1):
        for c in range(y.size - least + 1):
            for n in range(least, min(x.size - b, least + 30) + 1):
                p = set(x[b : b + n].tolist())
                for m in range(max(least, n - 3), min(y.size - c, n + 3) + 1):
                    q = y[c : c + m].tolist()
                    if config.denominator * len(p & set(q)) >= config.numerator * len(p | set(q)):
                        return True
    return False


def test_passages_with_an_edit_anywhere_are_verified():
    rnd = random.Random(16)
    config = windows.WindowConfig()
    fresh = iter(range(10**9))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    for length in range(50, 71, 5):
        for at in range(length):
            passage = words(length)
            for edited in (passage[:at] + words(1) + passage[at + 1 :], passage[:at] + words(1) + passage[at:], passage[:at] + passage[at + 1 :]):
                texts = [" ".join(words(rnd.randrange(5, 40)) + p + words(rnd.randrange(5, 40))).encode() for p in (passage, edited)]
                x, y = (windows.shingles(t, config.width) for t in texts)
                got = windows.matching(x, y, config)
                assert len(got) == 1, (length, at)
                b, t, c, d, likeness = got[0]
                p, q = set(x[b:t].tolist()), set(y[c:d].tolist())
                assert min(t - b, d - c) >= config.least and likeness == len(p & q) / len(p | q) >= 0.75


def test_stretches_without_a_passage_are_not_searched(monkeypatch):
    config, rng, sought = windows.WindowConfig(), np.random.default_rng(23), []
    monkeypatch.setattr(windows, "chain", lambda j, chain=windows.chain: sought.append(j.size) or chain(j))
    x, y = (rng.integers(0, 1 << 63, 400, np.uint64) for _ in "xy")
    y[::3] = x[::3]
    assert windows.matching(x, y, config) == [] and not sought
    # what can be found is always searched
    for _ in range(300):
        near = rng.random(200) < rng.choice([0.6, 0.75, 0.9])
        i = np.flatnonzero(near)
        if windows.filled_up(x[:200], np.where(near, x[:200], y[200:]), i, i, (0, 200, 0, 200), config):
            sought.append(1)
            assert windows.promising(i, config)
    assert sought


def test_order_of_ties_does_not_matter():
    config, rng = windows.WindowConfig(), np.random.default_rng(24)
    t = np.zeros(300, windows.TIE)
    for name, most in (("a", 3), ("b", 3), ("x", 4), ("y", 200), ("n", 100), ("f", 4)):
        t[name] = rng.integers(0, most, t.size) + (config.least if name == "n" else 0)
    found = windows.overlapping(t, config)
    assert found and all(windows.overlapping(t[rng.permutation(t.size)], config) == found for _ in range(5))


def test_matching_agrees_with_brute_force():
    rnd = random.Random(17)
    config = windows.WindowConfig(words=16)
    fresh = iter(range(10**9))
    seen = Counter()
    for _ in range(300):
        passage = [f"w{next(fresh)}" for _ in range(rnd.randrange(14, 26))]
        edited = list(passage)
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(edited))
            edited[k : k + rnd.randrange(2)] = [f"w{next(fresh)}" for _ in range(rnd.randrange(2))]
        around = [[f"w{next(fresh)}" for _ in range(rnd.randrange(8))] for _ in range(4)]
        x, y = (windows.shingles(" ".join(u + p + v).encode(), config.width) for u, p, v in ((around[0], passage, around[1]), (around[2], edited, around[3])))
        want = reaches(x, y, config)
        seen[want] += 1
        assert bool(windows.matching(x, y, config)) == want
    assert min(seen[True], seen[False]) > 50


def test_hot_lists_are_dealt_in_blocks(spark):
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(80)]
    texts = []
    for k in range(70):
        t = list(base)
        for _ in range(rnd.randrange(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t))
    want = {d: c for d, (_, c) in shingles.brute_force(list(enumerate(texts))).items()}
    for config in (shingles.ShingleConfig(block=9, deal=7, hot=5, leaf=4), shingles.ShingleConfig(sample=30, hot=1, leaf=3, groups=4, fine_groups=4)):
        assert {r.doc_id: r.component_id for r in shingles.similarity_components(docs_of(spark, texts), config).collect()} == want


def test_tree_finds_everyone_with_a_partner():
    rnd = np.random.default_rng(22)
    config = shingles.ShingleConfig(leaf=4)
    base = [rnd.integers(0, 1 << 40, 60).astype(np.uint64) for _ in range(20)]
    sets = [np.unique(np.where(rnd.random(60) < rnd.choice([0.02, 0.1, 0.5]), rnd.integers(0, 1 << 40, 60).astype(np.uint64), base[k % 20])) for k in range(120)]
    points, sizes, roots = np.stack([shingles.count_vector(s, 32) for s in sets]), np.array([s.size for s in sets]), rnd.integers(0, 3, 120)
    tree = shingles.CountTree(points, sizes, roots, config)
    want = np.zeros(120, bool)
    for u, v in tree.pairs():
        want[u] = want[v] = True
    assert (tree.partnered() == want).all() and 0 < want.sum() < 120


def hashes_of(df):
    return {(r.doc_id, r.text): r.kid for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("kid")).collect()}


def test_one_copy_of_a_repeat_stays(spark):
    rnd = random.Random(23)
    config = suffixes.SuffixConfig(length=40, window=16, run_rows=50, block_rows=60, keep_one=True, hot_rows=6, slices=4)
    base = ["".join(rnd.choice("abcde \n") for _ in range(120)) for _ in range(4)]
    texts = [None, "", "a" * 150, base[0], base[0]] + [rnd.choice(base)[rnd.randrange(40) :] + "".join(rnd.choice("xyz") for _ in range(9)) + rnd.choice(base)[: rnd.randrange(30, 120)] for _ in range(40)]
    docs = docs_of(spark, texts)
    kid = hashes_of(docs)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.remove_repeats(docs, config).collect()}
    assert [got[i] for i in range(len(texts))] == suffixes.brute_force(texts, 40, [kid[i, t] for i, t in enumerate(texts)])


def test_hot_keys_are_joined_alike(spark, monkeypatch):
    from stratum.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rnd = random.Random(24)
    texts = ["".join(rnd.choice("abc") for _ in range(90))] * 8 + ["".join(rnd.choice("abcdef") for _ in range(90)) for _ in range(6)] * 2
    config = suffixes.SuffixConfig(length=40, window=16)
    got = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in suffixes.remove_repeats(docs_of(spark, texts), config).collect()}
    assert [got[i] for i in range(len(texts))] == [x[3] for x in suffixes.brute_force(texts, 40)]


def test_broken_files_give_an_error_text():
    rnd = random.Random(25)
    whole = matroska.mux(matroska.padded(b"some text of a file " * 60))
    for n in range(len(whole)):
        matroska.parse(whole[:n])
    for _ in range(2000):
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 6)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        matroska.parse(bytes(data))
    one = matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, b"\x81"))
    assert matroska.parse(matroska.HEADER + matroska.element(matroska.SEGMENT, one)).error


def test_rare_languages_are_learned(spark):
    rows = [("the cat and the dog sat on the mat", "en")] + [("qaptlhej wovbe chegh", "kl")] + [("zxzx yvyv wuwu", "zz")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), langid.LanguageConfig(bits=14))
    assert model.languages == ["en", "kl", "zz"]
    assert [model.predict(t)[0] for t, _ in rows] == ["en", "kl", "zz"] and model.predict("жук")[0] in model.languages
    many = spark.range(50_000).select(F.concat_ws(" ", F.lit("the cat and"), F.col("id"), F.lit("dogs")).alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(many.unionByName(spark.createDataFrame(rows[1:2], "text string, lang string")), langid.LanguageConfig(bits=14, sample_rows=500))
    assert model.predict("qaptlhej")[0] == "kl" and model.predict("the cats and dogs")[0] == "en"
    copies = spark.range(5000).select(F.lit("one and the same text").alias("text"), F.lit("en").alias("lang"))
    assert langid.fit(copies, langid.LanguageConfig(bits=14)).languages == ["en"]


def test_padding_does_not_depend_on_the_layout(spark, real):
    docs = docs_of(spark, [t for _, t, _ in real] * 3)
    config = packing.PackingConfig()
    for parts in (1, 16, 200):
        got = packing.pack_documents(docs.repartition(parts), vocabulary(), config).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
        assert sum(r.n for r in got) > 0.98 * config.length * len(got)
    for bad in ({"stretch": 600}, {"stretch": 0}, {"segment": 100}, {"tails": 0}):
        with pytest.raises(ValueError):
            packing.PackingConfig(length=512, **bad)


def test_ranges_are_even_for_any_ids(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGE_ROWS", 50)
    texts = [f"text number {i} of {i % 7}" for i in range(1000)]
    cases = {"sparse": [i for i in range(999)] + [1 << 60], "none": [None] * 1000, "one": [5] * 900 + [*range(100)], "steps": [i * 10**15 for i in range(1000)]}
    for name, ids in cases.items():
        rows = docs_of(spark, texts, ids).select("doc_id", "text")
        dealt = sampling.dealt(rows).where("not visitor")
        sizes = [r["count"] for r in dealt.groupBy("bin").count().collect()]
        assert sum(sizes) == 1000 and max(sizes) < 130, (name, max(sizes))
        order = dealt.orderBy("bin", "place").select("doc_id", "text", "lead").collect()
        assert all(a.lead == b.text for a, b in zip(order, [*order[1:], order[0]], strict=True)), name
        known = [r.doc_id for r in order if r.doc_id is not None]
        assert known == sorted(known)


def test_likeness_estimates_generalised_jaccard(spark):
    rnd = random.Random(26)
    texts = []
    for pair in range(150):
        # words of their own for each pair, as all texts share the random draws of a word
        words = [f"p{pair}w{i}" for i in range(60)]
        texts += [" ".join(rnd.choice(words[: rnd.randrange(20, 60)]) for _ in range(200)) for _ in range(2)]
    weights = [{w: 1 + math.log(n) for w, n in Counter(t.split()).items()} for t in texts]
    errors = []
    for r in sampling.neighbour_fingerprints(docs_of(spark, texts)).where("doc_id % 2 = 0").collect():
        a, b = weights[r.doc_id], weights[r.doc_id + 1]
        both = a.keys() | b.keys()
        errors.append(r.near_next - sum(min(a.get(w, 0), b.get(w, 0)) for w in both) / sum(max(a.get(w, 0), b.get(w, 0)) for w in both))
    assert abs(sum(errors)) / len(errors) < 0.02 and math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.1


def test_long_texts_keep_wide_windows():
    x = np.arange(70_000, dtype=np.uint64)
    w = windows.compact_windows(x, windows.WindowConfig(functions=1))
    assert int((w["l"].astype(int) + w["r"] + 1).max()) == 70_000


def test_repeated_and_missing_ids(spark):
    texts = ["one text of some words that are many enough for it"] * 3 + ["line a\nline b\nline c\nline d"] * 3 + [None, ""]
    docs = docs_of(spark, texts, [1, 1, None, 2, None, None, None, 3])
    n = len(texts)
    assert suffixes.remove_repeats(docs).count() == n and lines.dedup_lines(docs).count() == n
    assert shingles.similarity_components(docs).count() == n and sampling.neighbour_fingerprints(docs).count() == n
    assert kdshards.kd_shards(docs, leaves=4).count() == n and matroska.media_digests(docs).count() == n
    assert bpe.encode_documents(docs, vocabulary()).count() == n
    assert packing.pack_documents(docs, vocabulary()).agg(F.sum("length")).first()[0] == sum(len(bpe.load(vocabulary()).encode(t)) + 1 for t in texts)
    assert windows.near_passages(docs).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == n


def test_pipeline_removes_repeated_passages_of_short_words(spark):
    import corpus_pipeline

    rnd = random.Random(19)
    fresh = lambda n: [f"unlike{rnd.randrange(10**9)}" for _ in range(n)]
    short = [rnd.choice("abcdefgh") + rnd.choice("ijklmnop") for _ in range(60)]
    bodies = [fresh(30) + short[: 51 + k] + fresh(30) for k in (0, 9)] + [fresh(30) + short[:50][::-1] + fresh(5) for _ in range(2)]
    texts = [" ".join(b) for b in bodies]
    assert len(" ".join(short)) < corpus_pipeline.PASSAGE.length
    rows = docs_of(spark, texts).select("doc_id", "text", "lang", "source")
    rows = corpus_pipeline.materialize(spark, corpus_pipeline.dedup_passages(spark, rows, SF))
    kid = hashes_of(rows)
    first = min((0, 1), key=lambda d: kid[d, texts[d]])
    want = dict(enumerate(bodies))
    want[1 - first] = bodies[1 - first][:30] + bodies[1 - first][81:]
    got = {r.doc_id: r.text.split() for r in corpus_pipeline.without_repeats(rows, corpus_pipeline.SHORT_WORDS).collect()}
    assert got == want
    tokens = {}
    for r in corpus_pipeline.pack(spark, rows, SF).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    own = bpe.load(vocabulary())
    kept = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(rows, corpus_pipeline.SHORT_WORDS).collect()}
    assert tokens == {d: len(own.encode(x)) + 1 for d, x in kept.items()}


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in rows.collect()}
        kid = hashes_of(rows)
        rows = corpus_pipeline.materialize(spark, stage(spark, rows, SF))
        after = {r.doc_id: r.text for r in rows.collect()}
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "line_dedup":
            want = {d: t for d, t in lines.brute_force(list(before.items())).items() if t.strip(" ")}
        elif name == "ngram_jaccard_join":
            want = {d: before[d] for d, (_, c) in shingles.brute_force(list(before.items())).items() if c == d}
        elif name == "suffix_array_dedup":
            ids = list(before)
            order = [kid[d, before[d]] for d in ids]
            want = {d: n for d, (_, n, *_) in zip(ids, suffixes.brute_force([before[d] for d in ids], corpus_pipeline.PASSAGE.length, order), strict=True)}
            assert all(len(after[d].encode()) == len(before[d].encode()) - want[d] for d in after)
            continue
        else:
            want = before
        assert after == want
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert pieces.select("doc_id").distinct().count() == rows.count()
