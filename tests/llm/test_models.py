"""Classifiers, nearest neighbours, the pipeline and the registered queries."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from docketlake.llm import bpe, common, measures, neighbours, quality, queries, rules, simhash, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """Ordinary, noisy and abusive documents with labels."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice(["ra", "ti", "on", "el", "mo"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30, 120))]
        noisy, toxic = i % 5 == 0, i % 4 == 1
        if noisy:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["grukk", "vormel"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(not noisy), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, cut):
    got = scored.join(labels, "doc_id").where("doc_id % 3 = 0").select((F.col("score") >= cut).cast("int").alias("p"), label).collect()
    return sum(r["p"] == r[label] for r in got) / len(got)


def test_quality(labelled, cluttered, empty):
    docs, labels = labelled
    positives = labels.where("quality = 1 AND doc_id % 3 <> 0").select("doc_id")
    model = quality.fit_quality(docs, positives)
    assert accuracy(quality.score_quality(docs, model), labels, "quality", 0.5) > 0.95
    rows = quality.score_quality(cluttered, model).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and {r["score"] for r in rows if not (r["text"] or "").split()} == {0.0}
    assert quality.score_quality(empty, model).count() == 0
    untrained = quality.fit_quality(empty, positives.limit(0))
    assert quality.score_quality(cluttered, untrained).count() == cluttered.count()


def test_prior_is_near_the_truth(labelled):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels.where("quality = 1").select("doc_id"))
    assert 0.65 < model.prior < 0.95


def test_toxicity(labelled, cluttered, empty):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 3 <> 0").select("doc_id", "toxic"))
    assert accuracy(toxicity.score_toxicity(docs, model), labels, "toxic", 0.7) > 0.95
    rows = toxicity.score_toxicity(cluttered, model).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and {r["score"] for r in rows if not (r["text"] or "").strip()} == {0.0}
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_toxicity_without_labels(empty, labelled, cluttered):
    model = toxicity.fit_toxicity(empty, labelled[1].limit(0).select("doc_id", "toxic"))
    assert toxicity.score_toxicity(cluttered, model).count() == cluttered.count()


def test_shared_model_sums_to_one(spark):
    docs = spark.createDataFrame([("abra cadabra", 1), ("abra abra cad", 0)], "text string, toxic int")
    counts = toxicity.class_counts(docs).persist()
    rows = toxicity.shared_model(counts, 1)[0].collect()
    assert all(0 < r["p"] <= 1 for r in rows)


def test_toxicity_is_the_difference_of_two_likelihoods(spark):
    """Against plain Kneser-Ney models that back off for n-grams never met, in all words of a text."""
    docs = [("grukk grukk abra cadabra", 1), ("abra cadabra abra gruft", 0), ("cad grumm", 1)]
    common.shared_folder(spark)
    counts = toxicity.class_counts(spark.createDataFrame(docs, "text string, toxic int"))
    model = toxicity.ToxicityModel(*toxicity.ratio_tables(toxicity.with_shared(counts.checkpoint())))
    as_tuple = lambda g: tuple(int(g).to_bytes(8, "big")[-toxicity.ORDER :])
    plain = [Counter(as_tuple(g) for t, x in docs if x == wanted for g in toxicity.grams(t.encode())[0].tolist()) for wanted in (1, 0)]
    both = brute.KneserNey(*plain, toxicity.DISCOUNT, toxicity.SHRINK)
    for text in ("grukk abra", "abrakadabra grumz gru", "zzz cadgrukk"):
        g, word = toxicity.grams(text.encode())
        want = np.bincount(word, [both.log_p(as_tuple(x), 0) - both.log_p(as_tuple(x), 1) for x in g.tolist()])
        assert model.words(text.encode()) == pytest.approx(want, abs=2e-3)
    assert model.evidence(b"grukk")[0][0] > model.evidence(b"zzzz")[0][0]


def test_shared_model_is_kneser_ney(spark):
    docs = [("abra cadabra", 1), ("abra abra cad", 0)]
    counts = toxicity.class_counts(spark.createDataFrame(docs, "text string, toxic int"))
    as_tuple = lambda g: tuple(int(g).to_bytes(8, "big")[-toxicity.ORDER :])
    whole = Counter(as_tuple(g) for t, _ in docs for g in toxicity.grams(t.encode())[0].tolist())
    plain = brute.KneserNey(whole, {}, toxicity.DISCOUNT, toxicity.SHRINK)
    for r in toxicity.shared_model(counts, 1)[0].collect():
        assert r["p"] == pytest.approx(plain.shared(as_tuple(r["g"])))


def test_repeated_ids_displace_no_sample(spark, labelled):
    """One id on a thousand rows is one row of a sample."""
    docs, labels = labelled
    positives = labels.where("quality = 1").select("doc_id")
    first = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(1)
    many = docs.unionByName(first.crossJoin(spark.range(1000)).select("doc_id", "text"))
    a, b = quality.sample_features(docs, positives, 20, 20), quality.sample_features(many, positives, 20, 20)
    assert all(np.array_equal(x, y) for x, y in zip(a, b)) and len(a[0]) == 20
    marks = labels.select("doc_id", "toxic")
    repeated = marks.unionByName(marks.limit(1).crossJoin(spark.range(1000)).select("doc_id", "toxic"))
    want, got = (toxicity.fit_toxicity(docs, x, 50).calibration for x in (marks, repeated))
    assert got == pytest.approx(want)


def exact(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in ok if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return out


def test_neighbours(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(400)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400, 700)]
    rows += [(1000, None), (1001, [0.0] * 4), (1002, [float("nan")] * 4), (1003, [float("inf"), 0.0, 0.0, 0.0]), (1004, [None, 1.0, 1.0, 1.0]), (1005, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(x["vec_id"], x["embedding"]) for x in table.collect()]
    got = sorted(map(tuple, neighbours.search(table, table.where("vec_id % 100 = 0"), 10).collect()))
    want = sorted(exact(rows, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_neighbours_of_few(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (5, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.search(two, two.where("vec_id % 100 = 0")).collect()] == [(0, 1, 5, 1.0)]
    assert neighbours.search(two.limit(0), two.limit(0)).count() == 0


def test_recall(spark):
    r = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(6000, 4)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(g["query_id"], g["vec_id"]) for g in neighbours.search(table, table.where("vec_id % 100 = 0"), 10).collect()}
    want = {(w[0], w[2]) for w in exact(rows, 10)}
    assert len(got & want) >= 0.9 * len(want)


def test_walk_is_by_sum():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    walk = [a[i] + b[j] for i, j in neighbours.pairs_by_distance(a, b)]
    assert walk == sorted(walk) and len(walk) == 6


def test_stages_on_odd_documents(spark, cluttered, sf_dir, tmp_path):
    docs = cluttered
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, cluttered.drop(*set(cluttered.columns) - set(corpus_pipeline.COLUMNS)).limit(0), sf_dir).count() == 0


def test_near_duplicate_stage_keeps_one(spark, cluttered, sf_dir):
    kept = corpus_pipeline.near_duplicate_stage(spark, cluttered, sf_dir).collect()
    assert sum(r["text"] == "exactly the same document text again" for r in kept) == 1


def test_near_duplicate_stage_is_exact(spark, sf_dir):
    r = random.Random(5)
    docs = []
    for _ in range(40):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([8, 60, 300]))]
        for _ in range(5):
            copy = list(base)
            for _ in range(r.randrange(len(base) // 25 + 2)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(500)}"
            docs.append(" ".join(copy))
    r.shuffle(docs)
    table = dict(enumerate(docs)) | {1000: None, 1001: "", 1002: "two words", 1003: "Two  words"}
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(list(table.items()), "doc_id long, text string"), sf_dir)
    roots = brute.similar_roots(table)
    assert 40 < len(set(roots.values())) < 200
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(roots.values()))


def near_copies(n_bases, n_copies, sizes):
    r, out = random.Random(5), []
    for _ in range(n_bases):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice(sizes))]
        for _ in range(n_copies):
            copy = list(base)
            for _ in range(r.randrange(len(base) // 25 + 2)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(500)}"
            out.append(" ".join(copy))
    r.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize(("dealt", "at_once"), [(20, 10**6), (10**6, 12), (40, 25)])
def test_near_duplicates_in_deals_and_blocks(spark, sf_dir, monkeypatch, dealt, at_once):
    """Sets dealt by bits of their fingerprints, and deals compared in blocks and across them, lose no link."""
    monkeypatch.setattr(simhash, "DEALT", dealt)
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    table = near_copies(12, 5, [8, 60]) | {1000 + i: t for i, t in near_copies(1, 40, [200]).items()}
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(list(table.items()), "doc_id long, text string"), sf_dir)
    roots = brute.similar_roots(table)
    assert 10 < len(set(roots.values())) < 90
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(roots.values()))


def test_near_duplicates_meet_by_simhash(spark, sf_dir, monkeypatch):
    """Without room for differing bits no unequal sets meet: there is no other way to a candidate."""
    monkeypatch.setattr(simhash, "print_deals", lambda n, similarity: np.zeros((2, 0), np.int64))
    monkeypatch.setattr(simhash, "near_reach", lambda similarity: 0)
    table = near_copies(3, 4, [60])
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(list(table.items()), "doc_id long, text string"), sf_dir)
    assert got.count() == len(set(table.values())) > len(set(brute.similar_roots(table).values()))


def test_set_prints_are_simhashes():
    """Each bit is that of most mixed hashes; of sets at the similarity few bits differ, however small the sets are."""
    r = np.random.default_rng(3)
    found = np.unique(r.integers(0, 1 << 63, 701, np.uint64))
    bits = lambda x: np.unpackbits(x.view(np.uint8))
    one_by_one = sum(bits(simhash.set_prints(x[None])).astype(int) for x in found)
    assert np.array_equal(bits(simhash.set_prints(found)), 2 * one_by_one > len(found))
    assert not simhash.set_prints(found[:0]).any()
    for both, a, b in ((4, 0, 1), (8, 0, 2), (9, 1, 1), (80, 10, 10), (400, 0, 100)):
        far = []
        for _ in range(200):
            z = r.integers(0, 1 << 63, both + a + b, np.uint64)
            far.append(simhash.apart_by(simhash.set_prints(np.sort(z[: both + a])), simhash.set_prints(np.sort(np.r_[z[:both], z[both + a :]]))))
        assert np.mean(far) < simhash.PRINT_BITS * simhash.differing(0.8) + 3 and max(far) <= simhash.print_reach(0.8)


@pytest.mark.parametrize("n_nodes", [100, 40_000, 13_000_000])
def test_deals_of_sets_meet_similar_pairs(n_nodes):
    r, places = np.random.default_rng(4), simhash.print_deals(n_nodes, 0.8)
    for both, a, b in ((8, 0, 2), (80, 10, 10)):
        z = r.integers(0, 1 << 63, (600, both + a + b), np.uint64)
        x, y = (np.array([simhash.set_prints(np.sort(q)) for q in p]) for p in (z[:, : both + a], np.c_[z[:, :both], z[:, both + a :]]))
        met = np.zeros(len(z), bool)
        for (d, deal), (_, other) in zip(simhash.dealt_out(x, places), simhash.dealt_out(y, places)):
            two = [2 * d % simhash.PRINTS, (2 * d + 1) % simhash.PRINTS]
            met |= (deal == other) & (simhash.apart_by(x[:, two], y[:, two]) <= simhash.near_reach(0.8))
        assert met.mean() > 0.998


@pytest.fixture(scope="module")
def rows_of(spark, sf_dir):
    held = {}

    def get(name):
        if name not in held:
            held[name] = queries.QUERIES[name](spark, sf_dir).collect()
        return held[name]

    return get


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.mark.parametrize(("name", "cut"), [("op1_quality", 0.5), ("op2_toxicity", 0.7)])
def test_score_queries(rows_of, documents, name, cut):
    rows = rows_of(name)
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        assert r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_bpe_query(rows_of, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    for r in rows_of("op3_bpe"):
        ids = library.encode(documents[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))


def test_simhash_query(rows_of, documents):
    fps = {i: brute.fingerprint(t) for i, t in documents.items()}
    roots = brute.components(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of("op6_simhash")} == {i: (f"{x:016x}", roots[i]) for i, x in fps.items()}


def test_substring_query(rows_of, documents):
    want = sorted((i, n, gone, brute.sha(kept)) for i, n, gone, kept in brute.substring_dedup(list(documents.items())))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of("op8_substring")) == want


def test_pii_query(rows_of, documents):
    for r in rows_of("op9_pii"):
        want = brute.pii(documents[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{e}" for k, a, e in want)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == brute.sha(line) and r["spans"].startswith(line)


def test_rules_query(spark, sf_dir, rows_of, documents):
    """The verdict against plain counts, ratios and threshold over all documents."""
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] == 1 and not held_out(r["doc_id"])}
    half = {r["doc_id"]: r["h"] % 2 == 0 for r in spark.createDataFrame([(i,) for i in documents], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    target, raw, held = Counter(), Counter(), {}
    for i, t in documents.items():
        data = np.frombuffer((t or "").encode() + b"\n" * (rules.ORDER - 1), np.uint8)
        held[i] = measures.gram_buckets(data, rules.ORDER, rules.BITS).tolist() if t else []
        raw.update(held[i])
        if i in trusted and half[i]:
            target.update(held[i])
    size = 1 << rules.BITS
    weight = lambda b: np.log(target[b] + 0.5) - np.log(sum(target.values()) + 0.5 * size) - np.log(raw[b] + 0.5) + np.log(sum(raw.values()) + 0.5 * size)
    llr = {i: float(np.mean([weight(b) for b in x])) if x else 0.0 for i, x in held.items()}
    got = {r["doc_id"]: r for r in rows_of("op10_rules")}
    steps = Counter(int(np.floor(got[i]["llr"] / rules.STEP)) for i in trusted if i in got and not half[i] and not got[i]["base_failed"])
    threshold = rules.threshold_of(steps, rules.LOST_SHARE)
    for i, r in got.items():
        assert r["llr"] == pytest.approx(llr[i], abs=1e-4) and r["kept"] == (not r["base_failed"] and int(np.floor(r["llr"] / rules.STEP)) >= threshold)


def test_pipeline_removes_what_it_should(spark, sf_dir, documents):
    """The stages before packing, one after the other, against plain versions of each on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, sf_dir).collect()}
    scores = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op1_quality"](spark, sf_dir).collect()}
    assert kept == {i for i, p in scores.items() if p}
    lines_out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, sf_dir).collect()}
    for (i, _, n, text) in brute.line_dedup(list(documents.items())):
        assert n == 0 and (lines_out[i] or "") == text or n and len(lines_out[i]) >= len(text)
    roots = brute.similar_roots(documents)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()} == set(roots.values())
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} <= kept and all(0 < p["length"] <= 4096 for p in pieces)


def test_links_in_a_group_join_what_all_links_would():
    r = np.random.default_rng(7)
    sets = []
    for _ in range(12):
        base = r.integers(0, 1 << 62, 80, np.uint64)
        for _ in range(8):
            copy = base.copy()
            copy[r.integers(0, 80, r.integers(0, 14))] = r.integers(0, 1 << 62, 1, np.uint64)
            sets.append(np.unique(copy))

    def parts(pairs, n):
        up = list(range(n))
        for a, b in pairs:
            up = [up[a] if x == up[b] else x for x in up]
        return sorted(map(tuple, {x: [i for i in range(n) if up[i] == x] for x in up}.values()))

    every = [(i, j) for i in range(len(sets)) for j in range(i) if simhash.alike(sets[i], sets[j], 0.8)]
    got = simhash.linked(sets, list(range(len(sets))), 0.8)
    assert 0 < len(got) < len(every) and parts(got, len(sets)) == parts(every, len(sets))
    assert simhash.linked(sets, [5] * len(sets), 0.8) == []
