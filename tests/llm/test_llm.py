"""Operators of strata.llm against brute force and planted edge cases: nulls,
empty and long texts, repeated rows, ties, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from strata.llm import (bpe, mixing, packing, posting_lists, quality, rp_forest, secret_scans, simhash,  # noqa: E402
                        suffix_dedup, token_counts, url_filters)
from strata.llm.queries import tokenizer_path  # noqa: E402
from strata.llm.suffix_groups import suffix_array  # noqa: E402

RNG = random.Random(5)
WORDS = ["the", "of", "Ärger", "ciónja", "token", "x1", "night", "and", "été"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = prose(9000)
TEXTS = [None, "", " \t\n", LONG, LONG, "<|endoftext|> a  b", "日本 ١٢\x1c x", prose(40), prose(40) + " tail", "It's 5 o'clock!!"]
DOCS = [(i, t, "s%d" % (i % 3) if i % 4 else None) for i, t in enumerate(TEXTS)] + [(3, LONG, "s0"), (None, "no id", None)]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def test_ids_by_pieces_equal_the_library():
    with open(tokenizer_path(), encoding="utf-8") as f:
        enc = bpe.Encoder(f.read())
    texts = [t or "" for t in TEXTS] + ["a" * 500, "don't  we'll\r\n\t end ", "–—… ¡hola! naïve"]
    want = [np.asarray(e.ids, dtype="<u4").tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want


def test_token_counts_and_cache(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    clash = docs.withColumn("n_tokens", F.lit("old"))
    first = sorted(map(tuple, token_counts.token_counts(clash, tokenizer_path(), cache).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, _ in DOCS})
    again = token_counts.token_counts(docs, tokenizer_path(), cache)
    assert sorted(map(tuple, again.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == first
    assert spark.read.parquet(cache).count() == stored          # nothing left to encode
    assert (1, 0, 0, False) in first and len(first) == len(DOCS)
    assert token_counts.token_counts(docs.limit(0), tokenizer_path(), cache).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/1?x=/de/", "https://a.example.org/en/17#t", "http://org/", "http://org",
            "http://myorg/", "ftp://x.com/fr/?q", "http://x.com/de/", "http://a.net/login", "http://a.net/x?utm_source=feed",
            "http://a.net/blogin", "http://a.net/x?utm_source=feeds", "http://org/", "x://y://z/es/"]
    rows = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(rows).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("a.example.org", "/en/17", "example.org/en/1", "block")
    assert got[5] == got[14] == ("org", "/", "org/", "allow") and got[6] == ("org", "", None, "allow")
    assert got[7][2] is None and got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block")
    assert [got[k][3] for k in (10, 11, 12, 13)] == ["block", "block", "allow", "allow"] and got[15][0] == "y:"
    assert len(got) == len(urls) and url_filters.filter_urls(rows.limit(0)).count() == 0


def brute_spans(t):
    found = []
    for k, (kind, pattern, least) in enumerate((
            ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
            ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, t)
                  if len(m.group(2) if kind == "assign" else m.group()) >= least]
    for m in re.finditer(secret_scans.CANDIDATE, t):
        x = m.group()
        if re.search("|".join(secret_scans.ALLOWED), x):
            continue
        kind = "entropy_hex" if re.search(secret_scans.HEX_ONLY, x) else "entropy_base64"
        x = x.lower() if kind == "entropy_hex" else x
        w, bits = secret_scans.WINDOW, secret_scans.CLASSES[kind][1]
        if max(-sum(c / w * np.log2(c / w) for c in Counter(x[i:i + w]).values()) for i in range(len(x) - w + 1)) >= bits - 1e-9:
            found.append((m.start(), secret_scans.KINDS.index(kind), m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def test_secrets(spark):
    key = "".join(RNG.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(60))
    texts = [None, "", "é token=abc", "PASSWORD: 'hunter2222'", "secret:token:abcdefgh", "x AKIA" + "Z9" * 9, "é " + key + " " + key,
             "ab12" * 10 + " " + hashlib.md5(b"x").hexdigest(), "example" + key, "aaaa" * 10,
             " ".join("token=%06d" % i for i in range(700)), "token==abcdef token=secret=abcdef", "Api_Key \"=\" x"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in secret_scans.scan_secrets(rows).collect():
        assert [tuple(s) for s in r.spans] == brute_spans(texts[r.doc_id] or ""), r.doc_id
    for r in secret_scans.redact(rows).collect():
        t, out, at = texts[r.doc_id], "", 0
        for a, b, _ in brute_spans(t or ""):
            if a > at or not out:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == (None if t is None else out + t[at:]) and r.spans == 1
    assert secret_scans.scan_secrets(rows.limit(0)).count() == 0


def test_redact_long_texts(spark, monkeypatch):
    monkeypatch.setattr(secret_scans, "PIECE", 7)
    key = "token=" + "a1B2c3" * 3
    texts = {"é😀 " * 40 + "x".join(f" {key}{k} 😀" for k in range(150)): True, key: True, key + " " + key: True,
             "😀" * 50: False, "AKIA" + "Q7" * 12 + "0123456789abcdef" * 3: True}
    for r in secret_scans.redact(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("old", F.col("text"))).collect():
        out, at = "", 0
        for a, b, _ in brute_spans(r.old):
            if a > at or not out:
                out += r.old[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + r.old[at:] and ("[SECRET]" in r.text) == texts[r.old]


def test_entropy_of_the_pieces_of_a_candidate(spark):
    key, upper = "q7Zx2Lw9Vb4Nt8Rk1Hs6Yd3Fg5Jm0Pc", "0A1B2C3D4E5F60718293A4B5C6D7E8F9"
    texts = {f"sample/dir/{key}": key, f"id is example_id={key}, so": key, f"sig={upper}": upper, f"see v1/{upper}/x": upper,
             f"sample/{upper}": upper, f"x sample{key}": None, "example_of_a_long_name_without_any_key_2": None, f"é dummy_{upper}_dummy": upper}
    df = spark.createDataFrame(list(texts.items()), "text string, want string")
    for r in secret_scans.scan_secrets(df).collect():
        found = [r.text[s.start:s.end] for s in r.spans if s.kind.startswith("entropy")]
        assert len(found) == (r.want is not None) and all(r.want in f and "sample" not in f and "example" not in f for f in found), (r, found)
    for r in secret_scans.redact(df).collect():
        assert r.want is None or r.want not in r.text


def test_quality_long_texts_teach(spark, monkeypatch):
    # every text of class 1 is long; its bytes tell the place they come from
    long = "".join(f"{k:07d} " for k in range(9000))
    rows = [(i, long if i % 2 else "junk ##", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    seen = []
    plain = quality.train
    monkeypatch.setattr(quality, "train", lambda texts, labels, **kw: seen.append((texts, labels)) or plain([], []))
    quality.fit(df, df, rows=15)
    texts, labels = seen[0]
    assert Counter(labels) == {0: 15, 1: 15}
    for t, y in zip(texts, labels):
        if y == 0:
            assert t == b"junk ##"
            continue
        n, wide = quality.SAMPLE_BYTES // quality.CHUNK, len(long) // (quality.SAMPLE_BYTES // quality.CHUNK)
        assert len(t) == quality.SAMPLE_BYTES
        for k in range(n):
            part = t[k * quality.CHUNK:(k + 1) * quality.CHUNK]
            at = long.encode().find(part)
            assert k * wide <= at <= (k + 1) * wide - quality.CHUNK
    assert len({t for t, y in zip(texts, labels) if y}) > 1       # places differ from text to text
    # documents of one class only, or none: a constant network, no error
    for some in (df.filter("quality = 0"), df.limit(0)):
        assert 0 < quality.fit(some, df).score("x") < 1


def test_quality_scores_against_plain_convolution(spark):
    rng = np.random.default_rng(8)
    net = quality.ByteNet(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS),
                          rng.normal(0, 0.5, 2 * quality.FILTERS), 0.2)
    texts = [None, "", "a", "Ärger " * 3, prose(100), prose(400), "x" * quality.CHUNK, "y" * (quality.CHUNK + 1)]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(df, net).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        tops = []
        start = 0
        while not tops or start + quality.CHUNK - quality.STRIDE < len(data):
            chunk = [data[start + j] if start + j < len(data) else 0 for j in range(quality.CHUNK + quality.WIDTH - 1)]
            tops.append([max(sum(net.conv[j, chunk[p + j], f] for j in range(quality.WIDTH)) for p in range(quality.CHUNK))
                         for f in range(quality.FILTERS)])
            start += quality.STRIDE
        act = np.maximum(np.array(tops) + net.bias, 0)
        want = 1 / (1 + math.exp(-float(np.concatenate([act.max(0), act.mean(0)]) @ net.out + net.shift)))
        assert got[i][0] == pytest.approx(want, abs=1e-5) and got[i][1] == int(got[i][0] >= 0.5)


def test_quality_learns_and_scores_whole_texts(spark):
    good = [prose(30 + k) for k in range(120)]
    bad = [t.replace(" ", "!! ").upper() for t in good]
    net = quality.train(good + bad, [1] * 120 + [0] * 120, epochs=3)
    assert np.mean([net.score(t) > .5 for t in good]) > .95 and np.mean([net.score(t) < .5 for t in bad]) > .95
    late = prose(9000)
    assert net.score(late) > .5 and net.score(late + " " + prose(300).replace(" ", "!! ").upper()) < net.score(late)
    x = np.concatenate([np.frombuffer(late.encode(), np.uint8), np.zeros(2000, np.uint8)])
    want = max(sum(net.conv[j][x[p + j], 2] for j in range(quality.WIDTH)) for p in range(len(late.encode()))) + net.bias[2]
    assert abs(net.responses(late.encode())[:, 2].max() - max(want, 0)) < 1e-4
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b")], "doc_id long, text string, score string")
    got = quality.score(rows, net).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(rows, none).score("x") == 0.5
    assert quality.fit(rows.limit(0), spark.createDataFrame([(2, 1), (None, 0)], "doc_id long, quality int")).score("x") == 0.5
    ids = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", quality.held_out())
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in ids.collect())


def test_simhash_against_brute_force(spark):
    base = prose(60)
    texts = [None, "", base, base, base + " one", base.replace("the", "The"), prose(60), "a", "A", "a b"]
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(4, base), (None, "a"), (None, "lonely words"), (None, "lonely words")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    fp = {t: simhash._fingerprint(t, 3) for _, t in rows}
    marked = simhash.with_fingerprints(df).cache()
    got = [(r.doc_id, r.text, r.component_id) for r in simhash.simhash_components(marked).collect()]
    ids = sorted({i for i, _ in rows if i is not None})
    near = lambda a, b: bin((fp[a] ^ fp[b]) & (1 << 64) - 1).count("1") <= 2
    comp = {i: i for i in ids}
    for _ in ids:
        for i, t in rows:
            for j, u in rows:
                if i is not None and j is not None and near(t, u):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert len(got) == len(rows)
    assert all(c == comp[i] for i, _, c in got if i is not None)
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(i for i, _ in kept if i is not None) == sorted(set(comp.values()))
    assert [t for i, t in kept if i is None] == ["lonely words"]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("width, long_list", [(1, 4), (2, 3), (3, 5), (4, 2), (6, 1), (None, 64), (None, 2)])
def test_pairs_by_tally_against_all_pairs(spark, width, long_list):
    rnd = random.Random(9)
    mask = (1 << 64) - 1
    # centres that share many bytes, neighbours at 1 to 4 bits, in one byte or in several
    centre = [rnd.getrandbits(64)]
    centre += [centre[0] ^ (rnd.getrandbits(8) << (8 * rnd.randrange(8))) for _ in range(12)] + [0, mask]
    fps = set(centre)
    for c in centre:
        for k in (1, 2, 2, 3, 4):
            fps.add(c ^ sum(1 << b for b in rnd.sample(range(64), k)))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long").repartition(3)
    want = {(x, y) for (x, a), (y, b) in combinations(enumerate(fps), 2) if ((a ^ b) & mask).bit_count() <= 2}
    got = [(r.nodea, r.nodeb) for r in simhash.pairs(nodes, 2, width, long_list).collect()]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


def test_sets_of_positions(spark):
    sets = simhash._sets(6, None)
    assert len(sets) == 14 and all(sum(set(t) <= set(s) for s in sets) == 1 for t in combinations(range(8), 3))
    assert min(sum(set(s) <= set(w) for s in sets) for w in combinations(range(8), 6)) == 3
    rnd, start = random.Random(4), 0x0123456789ABCDEF
    fps = [start, *{start ^ sum(1 << b for b in rnd.sample(range(64), 1 + k % 5)) for k in range(60)}]
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    for bits in (0, 1, 3, 4, 5):
        want = {(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= bits}
        assert {tuple(sorted((r.nodea, r.nodeb))) for r in simhash.pairs(nodes, bits, None, 8).collect()} == want


def test_fingerprint_written_out():
    from xxhash import xxh64_intdigest
    for text in ("", None, "One", "a B c d a b C", "ÄRGER ist  Ärger\u00a0hier\x0b\x0cund dort", LONG):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(g.encode(), seed=42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash._fingerprint(text, 3) % (1 << 64) == want


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = [rng.normal(size=8).round(2).tolist() for _ in range(700)]
    v[100:160] = [v[0]] * 60
    rows = [(i, x) for i, x in enumerate(v)] + [(900, None), (1000, [0.0] * 8), (1100, [float("nan")] * 8), (None, v[3]), (1200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(dict)
    for r in posting_lists.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    x = np.array(v, np.float32).astype(np.float64)
    assert sorted(got) == list(range(0, 700, 100))
    hit = 0
    for q, ranks in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        assert sorted(ranks) == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for i, s in ranks.values())
        hit += len(set(order) & {i for i, _ in ranks.values()})
    assert hit >= 0.9 * 10 * len(got)
    assert [got[100][k][0] for k in range(1, 11)] == [0, *range(101, 110)]
    few = posting_lists.nearest(df.filter("vec_id < 4"), df.filter("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert posting_lists.nearest(df.limit(0), df).count() == 0


def test_nearest_reads_on_where_its_lists_hold_too_few(spark):
    rng = np.random.default_rng(4)
    x, y = np.array([1.0] * 4 + [0.0] * 4), np.array([0.0] * 4 + [1.0] * 4)
    v = np.concatenate([x + rng.normal(size=(640, 8)) / 1000, y + rng.normal(size=(384, 8)) / 1000,
                        [x + (y - x) * t for t in (0.4, 0.5, 0.55, 0.6)]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in posting_lists.nearest(df, df.filter("vec_id >= 1024 or vec_id in (0, 700)")).collect():
        got[r.query_id].append(r.vec_id)
    assert {q: len(set(ids)) for q, ids in got.items()} == dict.fromkeys([0, 700, *range(1024, 1028)], 10)
    # k beyond what most lists hold, and beyond the table
    for k in (700, 2000):
        n = posting_lists.nearest(df, df.filter("vec_id in (0, 700, 1025)"), k=k).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in n} == dict.fromkeys([0, 700, 1025], min(k, len(v) - 1))


def test_mixing(spark, docs):
    weights, seen = (5, 2, 1), {}
    for _ in range(2):
        rows = mixing.mix_sources(mixing.sized(docs.withColumn("target", F.lit("x")))).collect()
        now = sorted((str(r.doc_id), r.size, r.taken, str(r.pieces)) for r in rows)
        assert seen.setdefault("rows", now) == now          # reruns agree
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken <= 3 * r.size
    names = sorted(size, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        rest, total = sum(size.values()) - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        share = {s: rest * w[s] / total for s in names if s not in fixed}
        over = {s: 3 * size[s] for s in share if share[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        fixed |= over
    for s, t in {**fixed, **share}.items():
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 0.5
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert 0 <= r.shard < 32
    assert got == +taken and mixing.mix_sources(mixing.sized(docs.limit(0))).count() == 0


def test_shard_quotas_are_exact(spark):
    plan = spark.createDataFrame([(1, 1000), (2, 17), (3, 0), (4, 1)], "rn int, blocks long")
    rows = mixing.shard_quotas(plan, 5, 3).collect()
    assert sorted(r.shard for r in rows) == [0, 1, 2, 3, 4]
    assert np.array([r.quotas for r in rows]).sum(axis=0).tolist() == [1000, 17, 0, 1]
    assert min(min(r.quotas) for r in rows) >= 0 and max(sum(r.quotas) for r in rows) - min(sum(r.quotas) for r in rows) <= 3


@pytest.mark.parametrize("rest, held, need", [(40, 15, 12), (9, 9, 4), (9, 0, 4), (7, 3, 7), (300, 2, 150), (60, 50, 40)])
def test_draws_follow_the_hypergeometric_law(spark, rest, held, need):
    n = 4000
    long = lambda x: F.lit(x).cast("long")
    got = [r.x for r in spark.range(n).select(mixing.hypergeometric(
        long(rest), long(held), long(need), (F.col("id") + 0.5) / n).alias("x")).collect()]
    law = {x: math.comb(held, x) * math.comb(rest - held, need - x) / math.comb(rest, need)
           for x in range(max(0, need - rest + held), min(held, need) + 1)}
    count = Counter(got)
    assert set(count) <= set(law)
    # evenly spread units: each outcome as often as the law says, but for its ends
    assert all(abs(count[x] - n * p) <= 1.01 for x, p in law.items())


@pytest.mark.parametrize("blocks", [1, 2, 7, 1000])
def test_blocks_are_permuted(spark, blocks):
    rows = spark.range(blocks).select("id", mixing.permuted(
        F.col("id"), F.lit(blocks).cast("long"), F.lit(3), F.lit(1)).alias("place")).collect()
    assert sorted(r.place for r in rows) == list(range(blocks))
    if blocks == 1000:
        # neighbours part: a run of a tenth of the places draws from the whole stream
        mean = np.mean([r.id for r in rows if r.place < 100])
        assert abs(mean - 500) < 100 and sum(abs(r.place - r.id) < 10 for r in rows) < 60


def test_packing(spark, docs):
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    with open(tokenizer_path(), encoding="utf-8") as f:
        enc = bpe.Encoder(f.read())
    seq, count = defaultdict(list), Counter()
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in DOCS:
        ids = enc.encode([t or ""])[0] + bytes(4)
        n = len(ids) // 4
        at = 0
        for k in range(-(-n // 2048)):
            stop = n - (-(-n // 2048) - 1 - k) * 2048
            count[(i, k, at, stop - at, zlib.crc32(ids[4 * at:4 * stop]))] += 1
            at = stop
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == count
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [1, 50, 4000])
def test_plan_uses_every_piece_once(n):
    counts = Counter(min(2048, int(RNG.lognormvariate(5.5, 1)) + 1) for _ in range(n))
    used, bins = Counter(), 0
    for lengths, times in packing.plan(dict(counts), 2048):
        assert sum(lengths) <= 2048 and times > 0
        bins += times
        for x in lengths:
            used[x] += times
    assert used == counts and bins <= 1.12 * sum(k * c for k, c in counts.items()) / 2048 + 1


def test_index_of_sums_against_all_combinations():
    rnd = random.Random(4)
    for _ in range(40):
        counts = {x: rnd.randint(1, 2) for x in rnd.sample(range(1, 40), 9)}
        stock, pool = packing._Stock(counts, 40), sorted(x for x, c in counts.items() for _ in range(c))
        while pool:
            for gap in range(1, 40):
                # single before pair before triple, the largest members first
                want = next((max(tuple(sorted(c, reverse=True)) for c in found) for k in (1, 2, 3) if (
                    found := [c for c in combinations(pool, k) if sum(c) == gap])), None)
                assert stock.complement(gap) == want
            gone = rnd.choice(pool)      # the index is kept up as lengths run out
            stock.n[gone] -= 1
            pool.remove(gone)


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 16))
    v = [(centre[k % 30] + rng.normal(size=16) * 0.1).tolist() for k in range(600)] + [centre[0].tolist()] * 40
    rows = [(i, x, i % 2) for i, x in enumerate(v)] + [(800, None, 0), (801, [0.0] * 16, 0), (802, [float("inf")] * 16, 0),
                                                      (803, v[0], None), (None, v[0], 0)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rp_forest.link_vectors(df, leaf=64).collect()}
    x = np.array(v, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(v)) % 2
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(v))
    for _ in range(20):
        comp = np.array([min(comp[i], *comp[link[i]]) if link[i].any() else comp[i] for i in range(len(v))])
    assert [got[i] for i in range(len(v))] == [(int(link[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(v))]
    assert all(got[i] == (0, i, True) for i in (800, 801, 802, 803)) and len(got) == len(rows)
    assert rp_forest.link_vectors(df.limit(0)).count() == 0


def test_suffix_array_of_small_alphabets():
    for n in (0, 1, 2, 7, 30, 300):
        for s in (1, 2, 4, 200):
            for _ in range(30):
                t = [RNG.randrange(s) for _ in range(n)]
                assert suffix_array(t) == sorted(range(n), key=lambda i: t[i:])


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            if i is not None:
                first[t[k:k + 50]] = min(i, first.get(t[k:k + 50], i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if i is not None and first[t[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(
            bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [4096, 2, 1])
def test_repeats_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    passage, other = prose(25), prose(60)
    texts = [None, "", "x" * 49, "x" * 50, passage, prose(20) + passage + prose(9), passage + passage, "é" + other, other + "é",
             other[:200] + "!" + other[200:], "ab" * 90, "ab" * 70 + "c", other, "x" * 300, prose(12) + other[50:120] + passage[-60:]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, passage), (4, other), (None, passage)]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256)
           for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute_repeats([(i, (t or "").encode()) for i, t in rows])
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_places_in_long_texts():
    """The last smallest of each run of values, in parts and as a whole."""
    rng = np.random.default_rng(6)
    h = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    h[rng.integers(0, 3000, 900)] = 5 << 24        # many equal ones
    for span in (1, 2, 35):
        got = suffix_dedup._last_smallest(h, span)
        top = h >> np.uint64(24)
        want = [i + span - 1 - int(np.argmin(top[i:i + span][::-1])) for i in range(len(h) - span + 1)]
        assert got.tolist() == want
    long = np.tile(h, (1 << 24) // 3000 + 40)
    got = suffix_dedup._last_smallest(long, 35)
    assert len(got) == len(long) - 34
    inside = suffix_dedup._last_smallest(long[:6100], 35)
    for k in range(0, (1 << 24) + 60_000, 1_500_000):      # the same places in every repetition, borders of parts included
        at = k // 3000 * 3000
        assert (got[at:at + 3000] - at == inside[:3000]).all()
    border = (1 << 24) - 35 - ((1 << 24) - 35) % 3000
    assert (got[border:border + 3000] - border == inside[:3000]).all()


def test_suffix_dedup_common_parts():
    group = [(b"1", b"aaXXXXXXXXXXXXXXXXbb" + b"c" * 40, 1, 2), (b"2", b"zaXXXXXXXXXXXXXXXXbb" + b"c" * 33 + b"d" * 9, 2, 2),
             (b"3", b"qqXXXXXXXXXXXXXXXXqq" + b"c" * 40, 3, 2)]
    assert suffix_dedup._common_parts(group) == [(1, 53), (1, 53), (0, 0)]
