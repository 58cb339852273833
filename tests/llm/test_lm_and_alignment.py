"""The suffix tree's scores and the tokenizer alignment against plain versions
over dictionaries and loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from strata.llm import alignment, blocks, queries, suffix_tree_lm  # noqa: E402

RNG = random.Random(3)
WORDS = ["The", "cat", "sat", "on", "a", "mat", "été", "ÄB", "x1", "dog", "ran"]
PHRASES = ["the cat sat on a mat", "a dog ran on the mat and the cat"]
SCHEMA = "doc_id long, text string"


def prose(n):
    out = []
    while len(out) < n:
        out += RNG.choice(PHRASES).split() if RNG.random() < .4 else [RNG.choice(WORDS)]
    return " ".join(out[:n])


def texts():
    long = prose(6000)
    return [None, "", " \t\n", "\x0b tail ", "unknownword" * 3, "one\xa0word", long, long] + [prose(RNG.randrange(1, 60)) for _ in range(120)]


def plain_scores(rows, depth, min_count, min_gain, strength):
    toks = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0,
             [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w)
              for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]) for i, t in rows]
    n = Counter()
    for _, held, ws in toks:
        if not held:
            for i in range(len(ws)):
                for k in range(min(i, depth) + 1):
                    n[tuple(ws[i - k:i + 1])] += 1
    total = sum(c for g, c in n.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in n)

    def prob(ctx, w):
        if not ctx:
            return (n[(w,)] + .1) / (total + .1 * (distinct + 1))
        return (n[(*ctx, w)] + strength * prob(ctx[1:], w)) / (n[ctx] + strength)

    gain = defaultdict(float)
    for g, c in n.items():
        ctx, w = g[:-1], g[-1]
        if ctx and n[ctx] >= min_count:
            p = prob(ctx[1:], w)
            gain[ctx] += c * math.log((c - 1 + strength * p) / (n[ctx] - 1 + strength) / p)
    kept = {()}
    for k in range(1, depth + 1):
        kept |= {s for s, x in gain.items() if len(s) == k and x >= min_gain and s[1:] in kept}
    out = []
    for i, held, ws in toks:
        score = base = 0.0
        for j, w in enumerate(ws):
            best = max((ws[j - k:j] for k in range(min(j, depth) + 1) if tuple(ws[j - k:j]) in kept), key=len)
            score += math.log10(prob(tuple(best), w))
            base += math.log10(prob((), w))
        out.append((i, held, len(ws), sum(n[(w,)] > 0 for w in ws), total, base, score))
    return out, kept


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[5]))


def check_scores(got, want):
    got, want = by_id(map(tuple, got)), by_id(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_equal_the_plain_tree(spark, depth):
    rows = list(enumerate(texts())) + [(9, "the cat sat"), (None, "no id the cat")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).repartition(3)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    want, kept = plain_scores(rows, depth, 4, 2.0, 5.0)
    assert {len(s) for s in kept} == set(range(depth + 1))       # contexts of every length are kept
    check_scores(suffix_tree_lm.score_texts(df, held, depth=depth, min_count=4, min_gain=2.0, strength=5.0).collect(), want)


def test_score_query(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_lm_scores"](spark, f"file://{tmp_path}").collect()
    check_scores(got, plain_scores(rows, 2, 8, 4.0, 50.0)[0])
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)      # the tree predicts better


def test_many_blocks_give_the_same_scores(spark):
    """Blocks are cut by size; the result does not depend on them."""
    rows = list(enumerate(texts()))
    held = F.col("doc_id") % 7 == 0
    some = [suffix_tree_lm.score_texts(spark.createDataFrame(rows, SCHEMA).repartition(n), held, min_count=3).collect() for n in (1, 7)]
    assert by_id(map(tuple, some[0])) == by_id(map(tuple, some[1]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_tree_lm.score_texts(none, F.lit(False)).count() == 0
    rows, pairs = alignment.align_tokenizers(none, queries.tokenizer_path(), P.path(queries.PIECES))
    assert rows.count() == 0 and pairs.count() == 0
    alone = suffix_tree_lm.score_texts(spark.createDataFrame([(1, "a b")], SCHEMA), F.lit(None).cast("boolean")).collect()
    assert [tuple(r)[:5] for r in alone] == [(1, True, 3, 0, 0)]


def test_packing_of_integers():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2 ** 64, 1000, dtype=np.uint64))
    assert (blocks.unpack_keys(blocks.pack_keys(keys)) == keys).all()
    for a in (rng.integers(-2 ** 60, 2 ** 60, 500), np.array([0, -1, 1, -2 ** 62, 2 ** 62]), np.zeros(0, np.int64)):
        assert (blocks.unpack_signed(blocks.pack_signed(a)) == a).all()


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(queries.tokenizer_path())
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found, count = [], Counter()
    for i, t in rows:
        t = t or ""
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        ab = [bytes(byte_of[c] for c in a_tok.id_to_token(x)) for x in a]
        bb = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else
              b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            found.append((i, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in some]).tolist() for some in (ab, bb)]
        spans = [list(zip([0, *e], e)) for e in ends]
        links, j = [], 0
        for x, (s, e) in zip(a, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, b[k]))
                k += 1
        groups, i0, j0 = [], 0, 0
        for stop in sorted(set(ends[0]) & set(ends[1])):
            i1, j1 = ends[0].index(stop) + 1, ends[1].index(stop) + 1
            groups.append(",".join(map(str, a[i0:i1])) + "|" + ",".join(map(str, b[j0:j1])))
            i0, j0 = i1, j1
        found.append((i, a, b, groups, links))
        count.update(links)
    most = defaultdict(int)
    for (_, b), c in count.items():
        most[b] = max(most[b], c)
    return [(i, len(a), len(b), len(g), len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, ls in found], count


def test_alignment_query(spark, tmp_path):
    rows = list(enumerate([None, "", " ", "a  b", " lead", "tail  ", "x\n\ny  z", "<|endoftext|> <s> <unk> <0x41>", "日本 ١٢ été", "a▁b",
                           "ﬁ \x00    x", "''don't'' " * 30, "word" * 400, "😀😀 ok", prose(3000), "   "] + [prose(30) for _ in range(40)]))
    rows += [(5, "tail  "), (None, "no id")]
    spark.createDataFrame(rows, SCHEMA).withColumn("n_a", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, count = plain_alignment(rows)
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, f"file://{tmp_path}").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[1] == 0 for r in want) == 3          # null, empty and the text whose mark reads as a space
    pairs = alignment.align_tokenizers(spark.read.parquet(f"file://{tmp_path}/documents.parquet"), queries.tokenizer_path(),
                                       P.path(queries.PIECES))[1]
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(count)


def test_words_encode_as_in_the_whole_text():
    _, b = alignment._tokenizers(queries.tokenizer_path(), P.path(queries.PIECES))
    some = [prose(200), "a   b", "   ", " x ", "x\ty \n z", "日本  語", "é" * 50, "tail "]
    assert b.by_word
    assert b.ids(some) == [np.asarray(x, "<u4").tobytes() for x in b.model.encode(some)]
