"""Encoding, packing, near-duplicates, lines, passages, personal data and rules against plain versions."""

import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketlake.llm import bpe, lines, measures, packing, pii, rules, simhash, substring


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def library_cache(library):
    return library


def ids_of(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encode_any_text(library_cache, t):
    assert bpe.encode(t) == ids_of(library_cache, t)
    assert bpe.decode(bpe.encode(t)) == library_cache.decode(ids_of(library_cache, t), skip_special_tokens=False)


def test_encode_long_words(library):
    r, merges = random.Random(3), bpe.merges()
    parts = [k for k in merges.vocab if k.isascii() and k.isalpha()]
    for _ in range(10):
        t = "".join(r.choice(parts) for _ in range(2000))
        assert bpe.encode(t) == ids_of(library, t)
        encoder, out = bpe.Encoder(merges), []
        for at in range(0, len(t), 100):
            out += encoder.feed(t.lower().encode()[at : at + 100])
            assert len(encoder.kept) <= merges.lookahead + 2 * encoder.step
        assert out + encoder.close() == ids_of(library, t)


def test_streams_emit_what_is_stable(library):
    """Whatever the pieces, what a stream has given is a beginning of the library's ids, and little is kept."""
    r = random.Random(1)
    parts = ["hello", "World", "it's", "''s", "'", "élan", "z" * 50, "123", "4", "+", "<|endoftext|>", "<|start", "\u0301", "é", "İ", "日本", " ", "  ", "\n", "a_b", ",", "'ll", "'Re"]
    for _ in range(150):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 60)))
        want = ids_of(library, t)
        for size in (1, 5, 40):
            s, out, data = bpe.Stream(bpe.encoder()), [], t.encode()
            for at in range(0, len(data), size):
                out += s.feed(data[at : at + size]).tolist()
                assert out == want[: len(out)]
            assert out + s.close().tolist() == want


def test_long_runs_stream(library, monkeypatch):
    monkeypatch.setattr(bpe.Texts, "PIECE", 100)
    r = random.Random(2)
    for _ in range(60):
        t = "".join(r.choice(["q" * 150, "Hello" * 60, "a", "\u0301", "é", " ", "<|endoftext|>", "'s", "1", "+", "日", "zx" * 70]) for _ in range(r.randrange(1, 10)))
        assert bpe.encode(t) == ids_of(library, t)


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    r = random.Random(3)
    data = " ".join(r.choice(["alpha", "beta", f"gamma{i}"]) for i in range(6_000_000)).encode()[:40_000_000]
    coder = bpe.encoder()
    coder.of([b"warm up"])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    n = largest = 0
    for _, ids in coder.stream([data]):
        n, largest = n + len(ids), max(largest, len(ids))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert n > 10_000_000 and largest < 2 * bpe.Texts.PIECE and peak < 150_000_000


def test_equal_hashes_are_told_apart(library, monkeypatch):
    coder = bpe.Texts(bpe.merges())
    coder.table[:] = 1  # every pre-token of a length has one hash
    words = ["alpha", "gamma", "delta", "ab", "cd", "regulation"]
    for w in (*words, *words[::-1]):
        assert next(coder.of([f"{w} {words[0]} {words[3]}".encode()])).tolist() == ids_of(library, f"{w} {words[0]} {words[3]}")


def test_encode_documents_keep_other_columns(cluttered, library):
    out = bpe.encode_documents(cluttered)
    rows = out.collect()
    assert out.columns[-1] == "ids" and all(r["ids"] == ids_of(library, r["text"]) for r in rows)
    back = bpe.decode_documents(out.select("doc_id", "ids"), byte_level=False)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {r["doc_id"]: library.decode(r["ids"], skip_special_tokens=False) for r in rows}


def test_byte_level_round_trip():
    assert bpe.decode(bpe.encode("hello, wörld"), byte_level=True).split() == ["hello", ",", "wörld"]


def test_digests_of_nothing(empty, docs):
    assert bpe.round_trip_digests(empty).count() == 0
    row = bpe.round_trip_digests(docs.where("text IS NULL")).first()
    assert row["n_tokens"] == 0 and row["ids_sha256"] == row["decoded_sha256"] == brute.sha("")


def test_packing(docs, empty, library):
    pieces = packing.pack_documents(docs, capacity=512, open_bins=4).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    for d, ps in by_doc.items():
        ids = np.array([*ids_of(library, texts[d]), 1], "<u4")
        ps.sort(key=lambda p: p["piece"])
        assert [p["start"] for p in ps] == list(range(0, len(ids), 512))
        assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in ps)
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [sum(x["length"] for x in ps[:i]) for i in range(len(ps))] and sum(p["length"] for p in ps) <= 512
    assert packing.pack_documents(empty).count() == 0


def test_packing_repeated_ids(spark):
    rows = [(1, "a b c"), (1, "d e f g"), (1, "a b c"), (None, "x"), (2, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=8).collect()
    assert sorted(p["length"] for p in got) == sorted(len(bpe.encode(t)) + 1 for _, t in rows)
    again = packing.pack_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5), capacity=8).collect()
    key = lambda p: (p["ids_crc32"], p["sequence_id"], p["offset"])
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("open_bins", [2, 16, 4096])
def test_placement_is_that_of_a_plain_best_fit(open_bins):
    r = random.Random(open_bins)
    bins, plain, closed = packing.BestFit(64, open_bins), {}, 0
    for _ in range(2000):
        n = r.randrange(1, 65)
        fits = [x for x in plain.values() if x >= n]
        number, at = bins.place(n)
        if fits:
            assert plain[number] == min(fits) and at == 64 - plain[number]
            plain[number] -= n
        else:
            assert number not in plain and at == 0
            if len(plain) >= open_bins:  # the fullest has gone
                plain.pop(next(k for k, x in plain.items() if x == min(plain.values()) and not any(k in b for b in bins.by_space)))
            plain[number] = 64 - n
        if not plain[number]:
            del plain[number]
        assert sorted(plain) == sorted(k for b in bins.by_space for k in b)


def test_best_fit_is_best():
    bins = packing.BestFit(10, 3)
    assert [bins.place(n)[0] for n in (6, 5, 7, 4, 3)] == [0, 1, 2, 0, 2]
    assert bins.place(9)[0] == 3 and bins.n_open == 2


def test_bounded_bins_close_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_fingerprints(docs, shingle):
    for r in simhash.fingerprints(docs.select("doc_id", "text"), shingle).collect():
        assert r["_fp"] % (1 << 64) == brute.fingerprint(r["text"], shingle)


def test_near_duplicates(cluttered, empty):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(cluttered, 3, 2).collect()}
    fps = {r["doc_id"]: brute.fingerprint(r["text"]) for r in cluttered.collect()}
    roots = brute.components(fps)
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(cluttered, 3, 2)
    assert kept.columns == cluttered.columns and {r["doc_id"] for r in kept.collect()} == set(roots.values())


@pytest.mark.parametrize("budget", [1, 2, 3])
def test_trie_join_finds_all_pairs(budget):
    r = np.random.default_rng(budget)
    base = r.integers(0, 1 << 63, 40, np.uint64)
    near = base[r.integers(0, 40, 400)] ^ (np.uint64(1) << r.integers(0, 64, 400, np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 400, np.uint64))
    fps = np.unique(np.r_[base, near])
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= budget}
    got = [tuple(sorted(p)) for x, y in simhash.trie_pairs(fps, budget) for p in zip(x.tolist(), y.tolist())]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("n", "budget"), [(10, 2), (10**7, 2), (10**7, 3), (10**12, 2)])
def test_masks_cover_every_pair(n, budget):
    masks, r = simhash.block_masks(budget, n), random.Random(1)
    for _ in range(300):
        flips = sum({1 << r.randrange(64) for _ in range(budget)})
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("limit", [3, 40])
def test_large_deals_are_split(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "DEAL", limit)
    r = np.random.default_rng(limit)
    base = r.integers(0, 1 << 20, 30, np.uint64)  # all agree on most of their bits
    near = base[r.integers(0, 30, 200)] ^ (np.uint64(1) << r.integers(0, 64, 200, np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200, np.uint64))
    fps = dict(enumerate(np.unique(np.r_[base, near]).tolist()))
    nodes = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(), i) for i, x in fps.items()], "_fp long, doc_id long")
    from docketlake.llm.common import shared_folder

    shared_folder(spark)
    roots = brute.components(fps)
    got = {x["_fp"]: x["component_id"] for x in simhash.component_ids(nodes, 2).collect()}
    assert {i: got[np.uint64(x).astype(np.int64).item()] for i, x in fps.items()} == roots


def test_finer_masks_cover_every_pair():
    r = random.Random(4)
    for mask in simhash.block_masks(2, 1000):
        for finer in (simhash.finer_masks(mask, 2), [m for f in simhash.finer_masks(mask, 2) for m in simhash.finer_masks(f, 2)]):
            for _ in range(100):
                flips = sum({1 << r.randrange(64) for _ in range(2)}) & ~mask
                assert any(not flips & m for m in finer) and all(m & mask == mask for m in finer)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert {k: got.get(k, k) for k in range(31)} == dict.fromkeys(range(31), 0) and got[101] == 100


@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup(cluttered, empty, limit):
    out = lines.drop_frequent_lines(cluttered, broadcast_keys=limit)
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect())
    assert got == sorted(brute.line_dedup([(r["doc_id"], r["text"]) for r in cluttered.collect()]))
    assert lines.drop_frequent_lines(empty, broadcast_keys=limit).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup_counts_rows(spark, limit):
    rows = [(1, "same\nown")] * 6 + [(2, "same")] * 4 + [(None, "x\nsame"), (3, None)]
    out = lines.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_keys=limit).collect()
    if limit:  # rows without a doc_id are told apart by the broadcast path alone
        assert sorted((r["n_dropped"], r["text"] or "") for r in out) == sorted([(1, "own")] * 6 + [(1, "")] * 4 + [(1, "x"), (0, "")])
    assert len(out) == len(rows)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup_keeps_the_first(docs, limit):
    out = {r["doc_id"]: r["text"] for r in lines.drop_frequent_lines(docs, keep_first=True, broadcast_keys=limit).collect()}
    common = sorted(i for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()) if (t or "").startswith("common line"))
    assert out[common[0]].startswith("common line") and not any(out[i].startswith("common line") for i in common[1:])


def test_substring_dedup(cluttered, empty):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.drop_repeats(cluttered).collect())
    assert got == sorted(brute.substring_dedup([(r["doc_id"], r["text"]) for r in cluttered.collect()]))
    assert substring.drop_repeats(empty).count() == 0


@pytest.mark.parametrize("window", [3, 5, 20])
def test_substring_windows(spark, window):
    r = random.Random(window)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(0, 60)))) for i in range(30)]
    got = sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect())
    assert got == sorted(brute.substring_dedup(rows, window))


def test_large_shard_keys_are_counted(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    monkeypatch.setattr(substring, "HOT_PLACES", 3)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, f"{' '.join(f'a{i % 9}x{k}' for k in range(9))} {shared} {' '.join(f'b{i % 7}x{k}' for k in range(20))}") for i in range(90)] + [(1000, "the " * 90)]
    got = sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute.substring_dedup(rows))


def test_fm_index_counts():
    r = np.random.default_rng(5)
    text = np.r_[r.integers(1, 5, 500), 0]
    index = substring.FMIndex(text, 8)
    for _ in range(50):
        at = int(r.integers(0, 490))
        pattern = text[at : at + 6]
        lo, hi = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum(bool((text[i : i + 6] == pattern).all()) for i in range(len(text) - 5))


@pytest.mark.parametrize("least", [1, 32])
def test_hot_anchors_are_split(spark, monkeypatch, least):
    from docketlake.llm import lines as module

    monkeypatch.setattr(module, "OFTEN", least)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(9))} {shared} {' '.join(f'b{i % 7}x{k}' for k in range(20))}") for i in range(60)]
    got = sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute.substring_dedup(rows))


def test_personal_data(cluttered, empty):
    out = pii.personal_data(cluttered).select("doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", pii.joined(F.col("base_spans")).alias("b"), pii.joined(F.col("all_spans")).alias("s")).collect()
    for r in out:
        want = brute.pii(r["text"])
        assert r["b"] == ",".join(f"{k}:{a}:{e}" for k, a, e in want)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x[0] for x in want) for k in ("email", "ip", "card", "phone")]
        assert r["s"].startswith(r["b"])
    assert pii.personal_data(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_personal_data_on_noise(spark, seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("0123456789.+-() @ab\né😀") for _ in range(300))) for i in range(60)]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("text", pii.joined(F.col("base_spans")).alias("b"))
    for x in out.collect():
        assert x["b"] == ",".join(f"{k}:{a}:{e}" for k, a, e in brute.pii(x["text"]))


def test_redaction(spark):
    text = "write to a.b@c.de or +49 30 1234567 😀 from 10.0.0.1"
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert out == {1: "write to <email> or <phone> 😀 from <ip>", 2: None, 3: ""}


def test_redaction_of_many_spans(spark):
    texts = {0: " ".join(f"a{i}@b.org" for i in range(700)), 1: "+49 (0)30 4111 1111 1111 1111 x 10.0.0.1, 4111 1111 1111 1111", 2: "é" * 50 + "10.0.0.1😀10.0.0.2", 3: "no one"}
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[0] == " ".join(["<email>"] * 700) and got[2] == "é" * 50 + "<ip>😀<ip>" and got[3] == "no one" and got[1].endswith(" x <ip>, <card>")


def test_redact_keeps_columns(cluttered):
    rows = {r["doc_id"]: r for r in cluttered.collect()}
    out = pii.redact(cluttered)
    assert out.columns == cluttered.columns
    for r in out.collect():
        assert [r[c] for c in cluttered.columns if c != "text"] == [rows[r["doc_id"]][c] for c in cluttered.columns if c != "text"]
        assert (r["text"] == rows[r["doc_id"]]["text"]) or "<" in r["text"]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_running_sums_and_maxima(spark, n):
    r = random.Random(n)
    x = [r.randrange(100) for _ in range(n)]
    row = spark.createDataFrame([(x,)], "x array<bigint>")
    at = F.sequence(F.lit(0), F.lit(n))
    got = row.select(pii.prefixes(F.col("x"), lambda a, c: a + c, lambda f: F.transform(at, f)).alias("s"), pii.prefixes(F.col("x"), lambda a, c: F.greatest(a, c), lambda f: F.transform(at, f)).alias("m")).first()
    assert got["s"] == [sum(x[:i]) for i in range(n + 1)] and got["m"] == [max([0, *x[:i]]) for i in range(n + 1)]


def test_trees_keep_what_is_precise():
    zero = dict.fromkeys(pii.BINS, 0)
    rows = [({**zero, "kind": 1, "digits": 3}, 40, 40), ({**zero, "kind": 1}, 0, 60), ({**zero, "kind": 0}, 3, 30)]
    trees = pii.Trees(rows, rows)
    assert trees.score_of(rows[0][0]) >= trees.thresholds[1] > trees.score_of(rows[1][0]) and trees.thresholds[0] == float("inf")
    assert pii.Trees(rows, []).thresholds == [float("inf")] * 2  # without held-out documents nothing is taken
    assert trees.quality(rows) == (40, 40, 43)


def test_trees_table_is_that_of_the_candidates(spark, docs):
    held, (_, every, part) = pii.searched(docs, ["doc_id"], "text")
    fitted, judged = pii.count_table(held, every, part)
    plain = {}
    for r in held.select(every, part).collect():
        for c in r[0]:
            cell = plain.setdefault((r[1] == 0, tuple(c["bins"])), [0, 0])
            cell[0] += c["good"]
            cell[1] += 1
    assert plain == {(out, tuple(b.values())): [g, n] for out, rows in ((False, fitted), (True, judged)) for b, g, n in rows}
    assert not {"named"} & set(pii.BINS)  # the label's own words are no feature


def test_secrets_are_learnt_from_their_format(spark):
    r = random.Random(9)
    secret = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    docs = [(i, f'text {i} api_key = "{secret()}"') for i in range(200)] + [(1000 + i, f'plain "{secret()}" {i}') for i in range(4)] + [(2000 + i, f"a-very-long-hyphenated-word-{'xyz'[i % 3]} {i}") for i in range(80)]
    got = {x["doc_id"]: [s["kind"] for s in x["all_spans"]] for x in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[i] == ["secret"] for i, _ in docs if i < 2000) >= 0.8 * 204 and not any(got[i] for i, _ in docs if i >= 2000)
    assert any(got[1000 + i] == ["secret"] for i in range(4))  # without a name before it


def test_rules(cluttered, empty):
    trusted = cluttered.where("doc_id % 2 = 0").select("doc_id")
    for r in rules.quality_rules(cluttered, trusted).join(cluttered.select("doc_id", "text"), "doc_id").collect():
        n, *rest = brute.base_rules(r["text"])
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [n, *rest]
        assert r["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n) and not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(empty, trusted).count() == 0
    assert rules.quality_rules(cluttered, trusted.limit(0)).where("kept AND base_failed").count() == 0


def test_repeat_words_small():
    for t in ("a b c", "a b c a b c", "a a a a", "a b a b a b", "x y z q x y z"):
        assert measures.repeat_words(t.encode().split()) == brute.base_rules(t)[4]


def test_threshold():
    assert rules.threshold_of({1: 1, 2: 999}, 0.001) == 2 and rules.threshold_of({1: 2, 2: 998}, 0.001) == 1


def test_encoder_keeps_little():
    """What a worker holds on to after its task."""
    from docketlake.llm import bpe

    assert sum(x.nbytes for x in vars(bpe.encoder()).values() if isinstance(x, np.ndarray)) < 60e6
