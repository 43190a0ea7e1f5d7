"""Each operator against a brute-force version, on odd rows and empty tables."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rewardlake.llm import (
    blocks, caps, components, licenses, mix, pack, quality, queries, secrets, shards, simhash, sketch, toxicity,
)
from rewardlake.llm.common import quantile_bounds, range_chunk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


def _roots(n, pairs):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# -- shards ------------------------------------------------------------------
def test_shards(spark, odd_docs, no_docs):
    for d in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows, n = shards.shard_documents(d).collect(), d.count()
        assert len(rows) == n
        for s in range(8):
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots)))
        assert all(r.grown_shard in (r.shard, 8) for r in rows)
        for r in rows:
            if r.doc_id is not None:
                draws = [(-math.log((int(hashlib.md5(f"{r.doc_id}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52), i)
                         for i in range(8)]
                assert r.shard == min(draws)[1]
    assert shards.shard_documents(no_docs).count() == 0


def test_shard_sizes_and_hot_record(spark):
    text = "äb"
    d = spark.range(3000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    rows = shards.shard_documents(d).collect()
    assert {(r.size, r.text_crc32, r.shard) for r in rows} == {(4, zlib.crc32(text.encode()), rows[0].shard)}
    assert sorted(r.slot for r in rows) == list(range(3000))


def test_weighted_shards(spark):
    d = spark.range(6000).withColumn("s", shards.rendezvous(F.col("id").cast("string"), (1, 2, 0, 3)))
    n = {r["s"]: r["count"] for r in d.groupBy("s").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[3] / 6000 - 0.5) < 0.03 and abs(n[0] / 6000 - 1 / 6) < 0.03


def test_range_chunk(spark):
    d = spark.range(1000)
    bounds = quantile_bounds(d, "id", 7)
    got = d.select("id", range_chunk(F.col("id"), bounds).alias("c")).collect()
    assert all(r.c == sum(b <= r.id for b in bounds) for r in got)
    assert spark.sql("select cast(null as bigint) x").select(range_chunk(F.col("x"), bounds)).first()[0] == -1


# -- fingerprints --------------------------------------------------------------
def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, SF).collect()}
    order = sorted(docs, key=lambda r: -r.doc_id)
    for at, r in enumerate(order):
        t, nxt = r.text or "", order[(at + 1) % len(order)].text or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = _shingles(t), _shingles(edited)
        if len(a) < sketch.K:
            assert g.distinct_shingles == len(a)
        if len(a | b) <= sketch.K:
            assert g.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        else:
            assert abs(g.near_edited - len(a & b) / len(a | b)) < 0.25
    for t in {r.text for r in docs}:
        assert len({got[r.doc_id].fingerprint for r in docs if r.text == t}) == 1


def _shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_sketches_merge(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(400)))), (1, " ".join(map(str, range(300, 700)))),
                               (2, " ".join(map(str, range(700))))], "g int, text string")
    s = sketch.with_sketch(d, "text", "s")
    both = sketch.merge_groups(s, ["g"], "s").where("g = 1").first()["s"]
    parts = [r["s"] for r in s.where("g = 1").collect()]
    assert both == sorted(set(parts[0]) | set(parts[1]))[:sketch.K]
    row = s.where("g = 2").select(sketch.distinct_shingles(F.col("s")).alias("n")).first()
    assert abs(row["n"] - 696) < 250


def test_fingerprint_edges(odd_docs, no_docs):
    rows = sketch.fingerprint_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.next_sketch is not None for r in rows)
    assert {tuple(r.sketch) for r in rows if r.doc_id in (2, 3, 4)} == {()}
    assert sketch.fingerprint_documents(no_docs).count() == 0


# -- licences ------------------------------------------------------------------
def test_licenses(spark, docs):
    got = {r.doc_id: r for r in queries.op6_licenses(spark, SF).collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    extra = [(r.doc_id, r.text) for r in docs]
    for i, t in extra:
        _check_license(got[i], t, phrases)


def _check_license(g, t, phrases):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, p) for p in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    assert (g.n_words, g.n_base) == (len(w), len(places))
    assert (g.first_word, g.last_word) == ((min(starts), max(starts)) if starts else (None, None))
    assert g.base_labels == ",".join(sorted({phrases[p] for _, p in places}))
    assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_license_places(spark, odd_docs, no_docs):
    d = spark.createDataFrame([(1, "CC-BY cc by NC 4.0; ALL rights\nreserved, all  rights reserved"),
                               (2, "the gnu general public licenſe; general PublicKicense"), (3, None), (4, "é" * 100_000)],
                              "doc_id int, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert [(p.start, p.label) for p in rows[1].places if p.base] == [(0, "cc-by"), (2, "cc-by"), (7, "reserved"), (10, "reserved")]
    assert "cc-by-nc" in {p.label for p in rows[1].places} and rows[2].places == [] and rows[3].n_words == 0 and rows[4].n_words == 1
    out = licenses.scan_licenses(odd_docs)
    assert out.count() == odd_docs.count() and "_words" in out.columns and out.columns.count("score") == 1
    assert licenses.scan_licenses(no_docs).count() == 0


# -- secrets -------------------------------------------------------------------
def _base(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A)
        if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(spark, docs, odd_docs, no_docs):
    got = {r.doc_id: r for r in queries.op2_secrets(spark, SF).collect()}
    for r in docs:
        assert got[r.doc_id].base_sha256 == hashlib.sha256(_base(r.text).encode()).hexdigest()
    out = secrets.scan_secrets(odd_docs)
    spans = {r.doc_id: r for r in out.select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect() if r.s}
    assert "assign:0:49,hex:9:49,access:53:73" == spans[8].s and out.count() == odd_docs.count()
    assert secrets.scan_secrets(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0
    red = secrets.redact(odd_docs)
    assert red.columns == odd_docs.columns
    assert {r.text for r in red.where("doc_id = 8").collect()} == {'[SECRET]" é [SECRET]', "twice the same id"}


def test_runs_of_mixed_signs_and_beside_base_spans_are_judged():
    key = "9f8A7sQ2kLmZ0xYvB4nT6cRpW3eHj5Ud"
    for text, want in ((f"svc-name/{key}", key), (f"sk-live/{key} x", key), (f"a/b+c/{key}-x", f"a/b+c/{key}"),
                       (f"x_y/{key}==", key + "=="), (key, key)):
        base, more = secrets.find(text.encode())
        assert not base and [text[s:e] for s, e, *_ in more] == [want]
    text = f"{key}/token={key}Zz9"                                  # the value is the base span's, the head is judged alone
    base, more = secrets.find(text.encode())
    assert [b[:3] for b in base] == [("assign", 33, len(text))] and base[0][3] is not None
    assert [text[s:e] for s, e, *_ in more] == [key + "/"]
    assert secrets.parts("a-b_c/d", 0, 7) == [(0, 5), (6, 7)] and secrets.parts("a-b/c", 0, 5) == [(0, 1), (2, 3), (4, 5)]


def test_base_values_are_judged_and_stay(spark):
    rng = np.random.default_rng(12)
    chars = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    texts = [f'password = "{"".join(rng.choice(chars, 40))}"' for _ in range(60)] + [f"token={'xy01' * 12}" for _ in range(60)] + ["secret: short-one"]
    rows = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    rows.sort(key=lambda r: r.doc_id)
    assert all(len(r.spans) == 1 for r in rows) and [r.base_judged for r in rows] == [1] * 120 + [0]
    assert sum(r.base_random for r in rows[:60]) >= 54 and sum(r.base_random for r in rows[60:]) == 0


IDENTIFIERS = ["com.example.service.v2.UserAccountControllerTest2024", "getUserProfileByAccountId2InternalHandler", "node_modules/react-dom/cjs/react-dom.development.js",
               "iso8859encodingtable1234", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "aaaaaaaaaaaaaaaaaaaa1111111111111111", "the-quick-brown-fox-jumps-over-13-lazy-dogs-again",
               "release-2024-05-17-build-000123-linux-x86_64", "00000000000000000000000000000001", "/usr/local/lib/python3/site-packages/numpy/core",
               "0123456789abcdef0123456789abcdef", "test_case_number_17_of_the_second_suite_for_parsing"]


def test_precision_and_recall_on_planted_tokens(spark):
    """What the README states: random tokens found, structured ones kept."""
    rng = np.random.default_rng(13)
    keys = [(a, n) for _, a, n in secrets.ENCODINGS if n < 40]
    planted = ["".join(rng.choice(list(a), 44)) for a, _ in keys for _ in range(40)]
    planted = [t for t in planted if any(c.isdigit() for c in t) and any(c.isalpha() for c in t)]
    rows = secrets.scan_secrets(spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate([*planted, *(IDENTIFIERS * 20)])],
                                                      "doc_id int, text string")).collect()
    rows.sort(key=lambda r: r.doc_id)
    recall = np.mean([bool(r.spans) for r in rows[:len(planted)]])
    false = {IDENTIFIERS[i % len(IDENTIFIERS)] for i, r in enumerate(rows[len(planted):])
             if any(s.kind == secrets.KINDS.index("random") for s in r.spans)}
    assert recall > 0.9 and false <= {"iso8859encodingtable1234", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}, (recall, false)


def test_battery_tells_random_from_structured():
    rng = np.random.default_rng(1)
    alphabet = secrets.ENCODINGS[5][1]
    random = [secrets.battery("".join(alphabet[i] for i in rng.integers(0, 62, 40)), alphabet) for _ in range(400)]
    assert 0.01 < np.mean(np.array(random) < 0.05) < 0.12
    assert secrets.battery("aaaaaaaaaabbbbbbbbbb1111111111cccccccccc", alphabet) < 1e-4
    assert secrets.infer_encoding("deadbeef00")[0] == "hex" and secrets.infer_encoding("a b") is None


def test_rejection_covers_the_corpus(spark):
    rng = np.random.default_rng(2)
    chars = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    texts = ["key " + "".join(rng.choice(chars, 48)) for _ in range(200)] + [f"id {'xy01' * 12}" for _ in range(200)]
    rows = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    found = [len(r.spans) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert sum(found[:200]) > 180 and sum(found[200:]) == 0


# -- SimHash -------------------------------------------------------------------
def test_simhash_sets_cover():
    from itertools import combinations
    for size in (3, 5):
        sets = [set(s) for s in simhash.index_sets(5, size)]
        assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), 5))


def test_simhash_components(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2 ** 63, 40)]
    for k in range(260):
        x = fps[rng.integers(0, len(fps))]
        for b in rng.choice(63, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    d = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id bigint, fingerprint bigint")
    want = _roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for block in (2048, 7):
        got = {r.doc_id: r.component_id for r in simhash.fingerprint_components(d, 3, block=block).collect()}
        assert [got[i] for i in range(len(fps))] == want
    rows = simhash.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert simhash.simhash_components(no_docs).count() == 0


def test_simhash_null_bridges_and_shared_ids(spark):
    """Rows without an id hold a component together; unlike rows of one id
    do not weld theirs."""
    rows = [(1, 0), (None, 7), (2, 63)]
    d = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint")
    got = {r.fingerprint: r.component_id for r in simhash.fingerprint_components(d).collect()}
    assert got == {0: 1, 7: 1, 63: 1}
    f1, f2 = 0x0F0F0F0F0F0F0F0F, 0x7FFF000000000000
    rows = [(5, f1), (5, f2), (3, f1 ^ 1), (9, f2 ^ 1), (None, 0x00FF00FF00FF00FF)]
    got = {r.fingerprint: r.component_id for r in simhash.fingerprint_components(
        spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint")).collect()}
    assert got == {f1: 3, f1 ^ 1: 3, f2: 5, f2 ^ 1: 5, 0x00FF00FF00FF00FF: None}


def test_simhash_query(spark, docs):
    """The registered query against brute force over whole texts."""
    import xxhash
    fps = {}
    for r in docs:
        w = (r.text or "").encode().lower().split()
        shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        ones = np.zeros(64, int)
        for x in shingles:
            h = xxhash.xxh64_intdigest(x, 42)
            ones += [h >> b & 1 for b in range(64)]
        fps[r.doc_id] = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))
    ids = sorted(fps)
    root = _roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {ids[i]: (f"{fps[ids[i]]:016x}", ids[root[i]]) for i in range(len(ids))}


def _biggest_task(df):
    """Share of rows in the fullest partition under small skew-join limits."""
    spark = df.sparkSession
    counts = [r["c"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("x").alias("c")).collect()]
    return max(counts) / sum(counts), sum(counts)


def test_hot_buckets_and_stars_are_split(spark):
    """A third of the rows under one key: the joins with the key's own
    aggregate are split."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    d = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 20_000).alias("k"), F.col("id").alias("m"),
                                    F.sha2(F.col("id").cast("string"), 512).alias("x"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        units = blocks.bucket_units(d, ["k"], "m", 1 << 20)
        share, n = _biggest_task(units)
        assert n == 300_000 and share < 0.25
        facts = d.groupBy("k").agg(F.min("m").alias("least"))
        share, n = _biggest_task(blocks.on_keys(d, facts, ["k"]).withColumn("x", F.concat("x", "least")))
        assert n == 300_000 and share < 0.25
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_simhash_bits(spark):
    import xxhash
    assert spark.sql("select xxhash64('a b c') x").first()["x"] % 2 ** 64 == xxhash.xxh64_intdigest(b"a b c", 42)
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d e")]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 1.5)
    assert simhash.text_fingerprint(b"A b  c\nd E", 3) % 2 ** 64 == want


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19] + [(5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert all(got.get(i, i) == i // 20 * 20 for i in range(61))
    assert components.connected_components(e.where("a = 5 and b = 5")).count() == 0


# -- near vectors ---------------------------------------------------------------
def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 16))
    vecs = np.vstack([base, *[base[:60] + 0.12 * rng.standard_normal((60, 16)) for _ in range(4)], base[:10]])
    label = [i % 120 % 2 for i in range(120)] + [i % 60 % 2 for i in range(240)] + [i % 2 for i in range(10)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0] * 16, None),
           (904, [1.0, None] * 8, 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0)]
    rows = [(i, [float(x) for x in v], n) for i, (v, n) in enumerate(zip(vecs, label, strict=True))] + odd
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :]) & ~np.eye(len(vecs), dtype=bool)
    want = _roots(len(vecs), list(zip(*np.nonzero(near), strict=True)))
    for block in (1024, 8):
        got = {r.vec_id: r for r in caps.near_vectors(d, block=block).collect()}
        links = np.array([got[i].n_links for i in range(len(vecs))])
        assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum()
        assert np.mean([got[i].component_id == want[i] for i in range(len(vecs))]) > 0.98
        assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))
        assert (got[906].n_links, got[907].component_id, got[907].kept) == (1, 906, False)
    assert caps.near_vectors(d.where("vec_id < 0")).count() == 0


def _pairs_at(rng, n, dim, cosine):
    u, v = rng.standard_normal((2, n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(axis=1, keepdims=True) * u
    return u, cosine * u + math.sqrt(1 - cosine ** 2) * v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("rows", [20_000, 300_000, 3_000_000])
def test_near_vectors_recall_at_large_labels(rows):
    code = caps.plan_code(rows, 64, 0.93)
    u, v = _pairs_at(np.random.default_rng(8), 1500, 64, 0.93)
    books = code.books(64)
    met = [bool(np.intersect1d(a, b).size) for a, b in zip(caps.decode(u, code, books), caps.decode(v, code, books), strict=True)]
    assert np.mean(met) > 0.99


def test_near_vectors_whole_label_and_filters(spark):
    u, v = _pairs_at(np.random.default_rng(9), 1500, 24, 0.932)
    d = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(np.vstack([u, v]))], "vec_id bigint, embedding array<double>, label int")
    x = np.vstack([u, v]) / np.linalg.norm(np.vstack([u, v]), axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    # by filters, by filters and whole labels in about equal parts, and all of it by whole labels
    code = caps.plan_code(len(x), 24, 0.93)
    mean = int(np.mean([len(h) for h in caps.decode(x, code, code.books(24))]))
    for few, least in ((caps.LEAST, 0.99), (mean, 0.99), (10 ** 6, 1.0)):
        got = {r.vec_id: r.n_links for r in caps.near_vectors(d, least=few, block=700).collect()}
        links = np.array([got[i] for i in range(len(x))])
        assert (links <= want).all() and links.sum() >= least * want.sum()


def test_near_vectors_query(spark, tmp_path):
    """The registered query over a table of near copies against all pairs,
    and how many of its vectors go through filters."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rng = np.random.default_rng(11)
    rows = [(r.vec_id, r.embedding, r.label) for r in given]
    for k in range(1500):
        i, v, n = rows[rng.integers(0, 200)]
        w = np.array(v) + rng.normal(size=len(v)) * rng.choice([0.0, 0.01, 0.035, 0.045])
        rows.append((10_000 + k, [float(c) for c in w], n))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in e], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r.label for r in e]), np.array([r.vec_id for r in e])
    order = np.argsort(ids)
    x, label, ids = x[order], label[order], ids[order]
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    root = _roots(len(x), list(zip(*np.nonzero(near), strict=True)))
    got = {r.vec_id: r for r in queries.op8_near_vectors(spark, str(tmp_path)).collect()}
    links = np.array([got[i].n_links for i in ids])
    assert near.sum() > 5000 and (links <= near.sum(axis=1)).all() and links.sum() >= 0.999 * near.sum()
    assert np.mean([got[ids[k]].component_id == ids[root[k]] for k in range(len(ids))]) >= 0.999
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    code = caps.plan_code(int(np.bincount(label).max()), x.shape[1], 0.93)
    assert np.mean([len(h) >= caps.LEAST for h in caps.decode(x, code, code.books(x.shape[1]))]) > 0.9


@pytest.mark.parametrize("rows", [1, 20, 200, 2000, 16_384, 16_385])
def test_near_vectors_plan_of_every_label_size(rows):
    code = caps.plan_code(rows, 64, 0.93)
    u, v = _pairs_at(np.random.default_rng(rows), 800, 64, 0.93)
    hits = [caps.decode(m, code, code.books(64)) for m in (u, v)]
    met = [bool(np.intersect1d(a, b).size) for a, b in zip(*hits, strict=True)]
    few = [len(a) < caps.LEAST or len(b) < caps.LEAST for a, b in zip(*hits, strict=True)]
    assert np.mean(np.array(met) | np.array(few)) > 0.995


def test_near_vectors_null_and_shared_ids(spark):
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [(5, at(0), 0), (None, at(15), 0), (None, at(15), 0), (3, at(30), 0), (9, at(100), 0), (9, at(200), 0), (8, at(205), 0),
            (None, at(300), 0)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for few in (caps.LEAST, 0, 1000):
        got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in caps.near_vectors(d, least=few).collect())
        assert got == [(0, 0, 0, True), (0, 3, 3, False), (0, 3, 3, False), (3, 2, 3, True), (5, 2, 3, False),
                       (8, 1, 8, True), (9, 0, 9, True), (9, 1, 8, False)]


def test_near_vectors_plan_of_short_vectors():
    assert caps.plan_code(100_000, 1, 0.93) is None
    code = caps.plan_code(100_000, 3, 0.93)
    assert code is None or caps.miss_rate(code, 3, 0.93)[0] < 0.01


# -- mixing --------------------------------------------------------------------
def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 40}
    d = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size bigint, n bigint")
    got = {r.source: r.target for r in mix.source_targets(d).collect()}
    want, weights, left = {}, {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * sum(sizes.values())
    open_ = set(sizes)
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        open_ -= over
    want |= {s: level * weights[s] for s in open_}
    assert got == pytest.approx(want)


def test_mix(spark, odd_docs, no_docs):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for bucket in (50_000, 100):
        got = mix.mix_plan(d, bucket=bucket).collect()
        assert len(got) == 3000 and all(0 <= r.copies <= 2 for r in got)
        taken, target = Counter(), {}
        for r in got:
            taken[r.source] += r.copies * r["size"]
            target[r.source] = r.target
        assert all(abs(taken[s] - t) <= 20 for s, t in target.items())
    again = {(r.doc_id, r.copies) for r in mix.mix_plan(d, bucket=100).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    plan = mix.mix_plan(odd_docs).collect()
    assert len(plan) == odd_docs.count() and all(r.copies == 0 for r in plan if r["size"] == 0)
    mixed = mix.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mix.mix_plan(no_docs).count() == 0 and mix.mix_documents(no_docs).count() == 0


def test_pivot_keeps_words():
    for u in (0.0, 0.3, 0.99):
        p1, p2 = mix.pivot(0.3, 10, 0.6, 25, u)
        assert 10 * p1 + 25 * p2 == pytest.approx(18) and any(abs(p - round(p)) < 1e-9 for p in (p1, p2))


def test_mix_of_a_row_repeated_over_a_third_of_the_table(spark):
    rows = [(7, "s", "one two three", 1)] * 400 + [(7, "s", "six five four", 1)] * 5 + [(None, "s", "a b c", 2)] * 3
    rows += [(100 + i, "t" if i % 2 else "s", "w " * (1 + i % 5), i) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, n int")
    want = Counter()
    for r in mix.mix_plan(d).collect():
        want[(r.doc_id, r.source, r.size)] += r.copies
    once, again = (Counter((r.doc_id, r.source, r.text, r.n) for r in mix.mix_documents(d).collect()) for _ in range(2))
    assert once == again
    got = Counter()
    for (i, source, text, _), n in once.items():
        got[(i, source, len(text.split()))] += n
    assert got == +want
    assert max(n for (i, *_), n in once.items() if i is not None and i >= 100) <= 2


# -- packing -------------------------------------------------------------------
def _packed(rows, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(pack.default_tokenizer())
    want = Counter()
    for i, text in docs:
        want[(i, *t.encode(text or "", add_special_tokens=False).ids, 1)] += 1
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= pack.WINDOW
    pieces = {}
    for r in sorted(rows, key=lambda r: r.start):
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    if max(want.values(), default=0) == 1 and len({k[0] for k in want}) == len(want):
        got = Counter((i, *np.frombuffer(b"".join(bytes(r.ids) for r in p), "<u4").tolist()) for (i, _), p in pieces.items())
        assert got == want
    assert sum(r.length for r in rows) == sum((len(k) - 1) * n for k, n in want.items())
    return seqs


def test_pack(spark, docs, odd_docs, no_docs):
    d = spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id bigint, text string").repartition(40)
    seqs = _packed(pack.pack_documents(d).collect(), [(r.doc_id, r.text) for r in docs])
    full = sum(sum(r.length for r in s) for s in seqs.values())
    assert full / (pack.WINDOW * len(seqs)) > 0.97
    _packed(pack.pack_documents(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert pack.pack_documents(no_docs).count() == 0


def test_words_equal_the_tokenizer(docs):
    words = pack.Words(pack.default_tokenizer(), cache=500)        # emptied many times
    assert not words.whole
    texts = ["İstanbul ŉ ſ ÀÉ x y z \x1c\x1d á Σας <|endoftext|> it's I'M 12345", "日本語 emoji 😀👍🏽 tab\tand\x0bvt\x85nel",
             "don''t '''s 's'S ﬁ ½ ²", "combining ́ alone ẹ́ <|startoftext|>x", "", " ", None, " lead trail ", *(r.text for r in docs)]
    for part in (texts[:9], texts, texts[5:7], []):
        ids, ends = words.ids(pa.array([None if t is None else t.encode() for t in part], pa.binary()))
        got = [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        assert got == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
    broken = [b"ab\xff \xc3 x\xe4\xb8", b"\xf0\x9f\x98"]
    ids, ends = words.ids(pa.array(broken, pa.binary()))
    assert ids[:ends[0]].tolist() == words.tokenizer.encode(broken[0].decode("utf-8", "replace"), add_special_tokens=False).ids


def test_words_fall_back_to_whole_texts():
    class Joined:                                                  # a tokenizer that looks across white space
        def encode_batch_fast(self, texts, add_special_tokens):
            return [type("E", (), {"ids": [len(t)]})() for t in texts]
    words = pack.Words(pack.default_tokenizer())
    words.tokenizer = Joined()
    assert not words.agrees(["two words"])
    words.whole = True
    ids, ends = words.ids(pa.array([b"two words", None, b"x"], pa.binary()))
    assert ids.tolist() == [9, 0, 1] and ends.tolist() == [1, 2, 3]


def test_text_slices_are_bounded():
    texts = pa.array([b"x" * n for n in (0, 10, 9 << 20, 3, 2 << 20, 3 << 20)] + [None], pa.binary())
    got = [(at, len(t)) for at, t in pack.text_slices(texts)]
    assert got == [(0, 2), (2, 1), (3, 2), (5, 2)]
    assert list(pack.text_slices(texts.slice(0, 0))) == []


# -- classifiers ---------------------------------------------------------------
def test_toxicity(spark, odd_docs, no_docs, labels):
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.01")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.join(y, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.toxic for r in got]) > 0.93
    model = toxicity.fit_toxicity(odd_docs, labels)
    scored = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    empty = toxicity.fit_toxicity(no_docs, labels.limit(0))
    assert toxicity.score_toxicity(no_docs, empty).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd_docs, empty).collect())


def test_label_model_finds_rates_and_ties():
    rng = np.random.default_rng(5)
    y = rng.random(40_000) < 0.15
    on, off = np.array([0.6, 0.4, 0.5, 0.3, 0.3]), np.array([0.05, 0.02, 0.1, 0.03, 0.03])
    x = rng.random((len(y), 5)) < np.where(y[:, None], on, off)
    x[:, 4] = x[:, 3] ^ (rng.random(len(y)) < 0.01)
    known = np.array([np.corrcoef(x[:2000, i], y[:2000])[0, 1] for i in range(5)])
    m = toxicity.fit_label_model(len(y), (x.astype(int).T @ x.astype(int)).astype(float), 0.15, known)
    assert np.abs(m.on - on).max() < 0.12 and np.abs(m.off - off).max() < 0.04
    assert (3, 4) in m.pairs and m.weight[4] < 0.75 < m.weight[0]


def test_quality(spark, odd_docs, no_docs, labels):
    rows = queries.op4_quality(spark, "/root/testdata/sf0.01")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.join(y, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    chain = quality.fit_quality(odd_docs, labels, 100)
    scored = quality.score_quality(odd_docs, chain).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(no_docs, quality.fit_quality(no_docs, labels)).count() == 0


def test_quality_trains_on_all_lines(spark, labels):
    rng = np.random.default_rng(11)
    clean = lambda n: "\n".join("The " + " ".join(rng.choice(["river", "house", "green", "walks", "near"], 9)) + "." for _ in range(n))
    junk = lambda n: "\n".join("BUY | " * 4 + "!!! 99$$ 000" for _ in range(n))
    rows = [(r.doc_id, r.quality) for r in labels.collect()]
    docs = spark.createDataFrame([(i, clean(600) if q else clean(300) + "\n" + junk(300)) for i, q in rows], "doc_id bigint, text string")
    for most in (quality.ROWS, 6000):
        scored = quality.score_quality(docs, quality.fit_quality(docs, labels, most=most)).collect()
        want = dict(rows)
        assert all((r.score > 0.5) == bool(want[r.doc_id]) for r in scored)


def test_quality_bound_takes_whole_documents():
    rows = [("a", 1, 5), ("b", 1, 9), ("c", 1, 2), ("d", 0, 50), ("e", 0, 1)]
    assert quality.whole_documents(rows, 10) == ["a", "c", "e"]
    assert quality.whole_documents(rows, 1) == ["e", "c"] and quality.whole_documents([], 5) == []
    assert quality.whole_documents(rows, 10 ** 6) == ["a", "b", "c", "d", "e"]


def test_marginals_of_a_long_document():
    rng = np.random.default_rng(12)
    step, score = 2 * rng.standard_normal((2, 2)), 8 * rng.standard_normal(3001)
    counts = np.array([1, 2500, 500])
    good, pairs = quality.marginals(score, counts, step)
    at, both = 0, 0.0
    for n in counts:
        s, trans = np.stack([np.ones(n), np.exp(score[at:at + n])], axis=1), np.exp(step)
        f, b = s / s.sum(axis=1, keepdims=True), np.ones((n, 2))
        for k in range(1, n):
            f[k] = (f[k - 1] @ trans) * s[k]
            f[k] /= f[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = trans @ (s[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        m = f * b
        assert good[at:at + n] == pytest.approx(m[:, 1] / m.sum(axis=1))
        for k in range(1, n):
            p = f[k - 1][:, None] * trans * (s[k] * b[k])[None]
            both = both + p / p.sum()
        at += n
    assert pairs == pytest.approx(both)


def test_marginals_are_exact():
    from itertools import product
    rng = np.random.default_rng(6)
    counts, step = np.array([4, 1, 3]), rng.standard_normal((2, 2))
    score = rng.standard_normal(counts.sum())
    good, pairs = quality.marginals(score, counts, step)
    at, want, both = 0, [], np.zeros((2, 2))
    for n in counts:
        s, w = score[at:at + n], {}
        for path in product((0, 1), repeat=int(n)):
            w[path] = math.exp(sum(s[k] * v for k, v in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(w.values())
        want += [sum(v for p, v in w.items() if p[k]) / z for k in range(n)]
        for p, v in w.items():
            for a, b in zip(p, p[1:], strict=False):
                both[a, b] += v / z
        at += n
    assert good == pytest.approx(want) and pairs == pytest.approx(both)
