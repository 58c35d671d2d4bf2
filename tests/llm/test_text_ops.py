"""Operators on texts against libraries and brute-force versions, with nulls, empty
and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from marlstone.llm import encoders, op1_bpe, op2_sst, op4_viterbi, op5_spans, op6_lines, op7_packing, op8_quality, op10_similar, op10_simhash
from marlstone.llm.common import documents, shared_path, spread, windows
from marlstone.llm.components import components
from marlstone.llm.encoders import WordEncoder, library_encoder

MULTI, BYTES, LOWER = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
LINE = "this very line is long enough to be looked at by line dedup"
DOCS = [
    (1, "Hello world, it's 2024!\n\n  Two  spaces. Ünïcödé ñandú \U0001f600 日本語 <|endoftext|>"),
    (2, None), (3, ""), (4, "   \n \t "), (5, "x" * 3000), (6, "word " * 400), (7, LINE + "\nshort\n" + LINE), (7, LINE + "\nshort\n" + LINE),
    (None, LINE.upper()), (8, "  " + LINE), (9, LINE + "\t"), (10, "a\n" + LINE), (11, LINE + "!"), (-5, "minus"), (12, "é ́x 'S's \x1c\x85 end "),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "l", "s", len(t or ""), "extra", 7) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, score int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("1 = 0")


def odd_texts(n=400):
    r = random.Random(5)
    kinds = [lambda: r.randrange(32, 127), lambda: r.randrange(9, 0x300), lambda: r.randrange(0x300, 0xD800), lambda: r.randrange(0xE000, 0x1FFFF), lambda: 32, lambda: 10, lambda: 39]
    return [t or "" for _, t in DOCS] + ["".join(chr(r.choice(kinds)()) for _ in range(r.randrange(150))) for _ in range(n)]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


# 1
@pytest.fixture(scope="module")
def own():
    ranks, e = op1_bpe.encoder(MULTI)
    return ranks, e, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def test_bpe_is_tiktoken(own):
    ranks, e, lib = own
    texts = odd_texts()
    for t, x in zip(texts, e.ids(texts)):
        assert ids(x) == lib.encode_ordinary(t)
        assert op1_bpe.decode(ranks, x) == t.encode()


def test_both_segment_trees_agree(own):
    ranks, _, lib = own
    r = random.Random(1)
    pieces = ["".join(r.choice("abthe") for _ in range(r.randrange(2, 200))) for _ in range(200)]
    for p, x in zip(pieces, op1_bpe.encode_pieces(ranks, pieces)):
        assert x == (op1_bpe._alone(ranks, p.encode()) if p.encode() not in ranks.rank else x)
        assert ids(x) == lib.encode_ordinary(p)


def test_pieces_split_alike_for_every_character(own):
    _, e, lib = own
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)} b\n" for c in range(i, i + 64) if not 0xD800 <= c < 0xE000) for i in range(0, 0x20000, 64)]
    assert [ids(x) for x in e.ids(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_safely(own):
    _, e, lib = own
    text = "some words, and  more\n words " * 80_000
    assert "".join(windows(text, 1000)) == text
    assert ids(e.ids([text])[0]) == lib.encode_ordinary(text)


def test_very_long_texts_go_in_parts(own, monkeypatch):
    _, e, lib = own
    counter = op4_viterbi.Counter(op4_viterbi.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    lower = Tokenizer.from_file(LOWER)
    texts = ["plain words and  odd\n  spaces ▁ ▁x, é" * 200, "x" * 5000, " y" * 3000, "short", "", "  " + "z " * 2000]
    whole = [counter.text(t) for t in texts]
    for module in (encoders, op4_viterbi):
        monkeypatch.setattr(module, "LONG", 2000)
    assert [ids(x) for x in e.ids(texts)] == [lib.encode_ordinary(t) for t in texts]
    assert [ids(x) for x in library_encoder(LOWER, "lower").ids(texts)] == [x.ids for x in lower.encode_batch(texts, add_special_tokens=False)]
    import pyarrow as pa

    assert counter.texts(pa.array([*texts, None])).tolist() == [*whole, 0]


def test_scans_that_cannot_be_split_are_spread(spark, tmp_path):
    spark.range(100).selectExpr("id doc_id", "'t' text").repartition(1).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.range(100).selectExpr("id doc_id", "'t' text").repartition(9).write.parquet(f"{tmp_path}/b/documents.parquet")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    one, many = documents(spark, f"{tmp_path}/a"), documents(spark, f"{tmp_path}/b")
    assert "Repartition" in plan(one) and "Repartition" not in plan(many) and one.count() == many.count() == 100
    memory = spark.range(3).selectExpr("id doc_id", "'t' text")
    assert spread(memory) is memory


def test_encode_operator(spark, docs, nothing):
    got = op1_bpe.encode(docs, MULTI, ids="score").collect()
    assert len(got) == len(DOCS) and got[1].score == [] and got[0]._id == "extra"
    assert op1_bpe.encode(nothing, MULTI).count() == 0
    d = {(r.doc_id, r.n_tokens): r for r in op1_bpe.digests(docs, MULTI).collect()}
    assert d[3, 0].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_memo_starts_anew():
    e = WordEncoder(lambda t: [t], lambda p: [x.encode().ljust(8) for x in p], words=10, pieces=10)
    r = random.Random(0)
    for _ in range(20):
        t = " ".join(f"{r.random():.4f}" for _ in range(30))
        assert e.ids([t]) == [b"".join(w.encode().ljust(8) for w in [x if i == 0 else " " + x for i, x in enumerate(t.split(" "))])]
        assert len(e.words) <= 45


# 2
@pytest.mark.parametrize(("path", "kind"), [(BYTES, "bytes"), (LOWER, "lower")])
def test_library_encoder_is_the_library(path, kind):
    t, texts = Tokenizer.from_file(path), odd_texts(1500)
    t.encode_special_tokens = True
    assert [ids(x) for x in library_encoder(path, kind).ids(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs, nothing):
    files = op2_sst.write_shards(docs, BYTES, 2, shared_path(spark, "t2"), 3)
    got = op2_sst.read_shards(spark, files).collect()
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    start, want = 0, []
    for d, text in sorted(DOCS, key=lambda x: (x[0] is not None, x[0])):
        x = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    shards = [op2_sst.Shard(f) for f, _, _ in files]
    for d, text in DOCS:
        found = [x.tolist() for s in shards for x in s.get(d)]
        assert len(found) == sum(i == d for i, _ in DOCS) and [*t.encode(text or "", add_special_tokens=False).ids, 2] in found
    assert not any(s.get(999) for s in shards)
    assert op2_sst.read_shards(spark, op2_sst.write_shards(nothing, BYTES, 2, shared_path(spark, "t2"), 3)).count() == 0


def test_ids_beyond_two_bytes(spark, docs, tmp_path):
    t = json.loads(open(BYTES).read())
    t["model"]["vocab"]["x"] = 70_001
    (tmp_path / "wide.json").write_text(json.dumps(t))
    texts = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    for path, end in ((BYTES, 70_000), (str(tmp_path / "wide.json"), 2)):
        files = op2_sst.write_shards(texts, path, end, shared_path(spark, "t2"), 1)
        want = Tokenizer.from_file(path).encode("x y", add_special_tokens=False).ids
        assert [x.tolist() for _, x in op2_sst.Shard(files[0][0]).scan()] == [[*want, end], [end]]
        assert max(*want, end) > 65_535 and sum(n for _, _, n in files) == len(want) + 2


def test_shard_of_many_blocks(tmp_path):
    uri = f"file://{tmp_path}/a.sst"
    w = op2_sst.ShardWriter(uri, 2, "x")
    keys = [3 * i - 5000 for i in range(20_000)]
    for k in keys:
        w.add(op2_sst.key_of(k), struct.pack("<3H", k & 255, 7, 9))
    w.close()
    s = op2_sst.Shard(uri)
    assert len(s.index) > 3 and [k for k, _ in s.scan()] == keys
    assert all(s.get(k)[0][0] == k & 255 for k in keys[::97]) and not any(s.get(k + 1) for k in keys[::97])
    assert sum(s.may_hold(op2_sst.key_of(k + 1)) for k in keys) < 600


# 4
def test_counts_are_the_librarys():
    pieces = op4_viterbi.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    small = [("<unk>", 0.0), ("a", -1.0), ("b", -2.0), ("ab", -3.0), ("▁", -1.0), ("▁a", -2.0), ("bb", -4.0), ("abb", -5.0)]
    for vocabulary, fallback in ((pieces, True), (small, False)):
        t = Tokenizer(models.Unigram(vocabulary, 0, fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        c = op4_viterbi.Counter(vocabulary)
        r = random.Random(3)
        for text in [*odd_texts(), "▁", "▁a", " ▁a ", *("".join(r.choice("aabbc d") for _ in range(20)) for _ in range(500))]:
            assert c.text(text) == len(t.encode(text, add_special_tokens=False).ids), text


def test_count_operator(docs, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = op4_viterbi.count_tokens(docs, path, n_tokens="score").collect()
    assert [r.score for r in got][1:3] == [0, 0] and len(got) == len(DOCS) and got[6].score == got[7].score
    assert op4_viterbi.count_tokens(nothing, path).count() == 0


# 5
def slow_spans(rows, words, alone):
    seen, out, hits = {}, {}, defaultdict(set)
    for d, t in sorted(rows):
        cut = op5_spans.sentences(t)
        w = [t[a:b].split() for a, b in cut]
        for i in range(len(w)):
            n, j = 0, i
            while j < len(w):
                n, j = n + len(w[j]), j + 1
                if len(w[j - 1]) >= alone or n >= words and j - i >= 2:
                    key = tuple(map(tuple, w[i:j]))
                    if seen.setdefault(key, (d, i)) != (d, i):
                        hits[d] |= set(range(i, j))
                    break
        out[d] = "".join(t[a:b] for k, (a, b) in enumerate(cut) if k not in hits[d])
    return out


def test_spans_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["a b. ", "c d e. ", "f! ", "g\n", "h i j k l m. ", "é?  "]) for _ in range(r.randrange(30)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, alone in ((5, 6), (4, 100), (1, 1)):
        assert dict(map(tuple, op5_spans.dedup_spans(df, words, alone).collect())) == slow_spans(rows, words, alone)


def test_no_tail_of_a_repeated_passage_stays(spark):
    r = random.Random(9)
    sentence = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n)) + ". "
    passages = ["".join(map(sentence, sizes)) for sizes in ((30, 12, 4, 3, 3), (60, 3), (3, 60, 2, 2), (10, 9, 8, 7, 6, 5, 4, 3, 2, 1), (26, 24, 1))]
    rows, want = [], {}
    for p in passages:
        for k in range(3):  # in the middle, at the end, and at the start of a text
            before, after = sentence(20) if k < 2 else "", sentence(20) if k != 1 else ""
            want[len(rows)] = before + ("" if k else p) + after
            rows.append((len(rows), before + p + after))
    got = dict(map(tuple, op5_spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), tails=True).collect()))
    assert got == want


def test_tails_against_all_runs(spark):
    r = random.Random(10)
    rows = [(i, "".join(r.choice(["a b. ", "c d e. ", "f! ", "g\n", "h i j k l m. ", "é?  "]) for _ in range(r.randrange(12)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, alone in ((5, 6), (4, 100)):
        seen, want = {}, {}
        for d, t in rows:
            cut, gone = op5_spans.sentences(t), set()
            w = [tuple(t[a:b].split()) for a, b in cut]
            for i in range(len(w)):
                for j in range(i + 1, len(w) + 1):
                    if sum(map(len, w[i:j])) >= words and j - i >= 2 or any(len(x) >= alone for x in w[i:j]):
                        if seen.setdefault(tuple(w[i:j]), (d, i)) != (d, i):
                            gone |= set(range(i, j))
            want[d] = "".join(t[a:b] for k, (a, b) in enumerate(cut) if k not in gone)
        assert dict(map(tuple, op5_spans.dedup_spans(df, words, alone, tails=True).collect())) == want


def test_spans_edge_cases(docs, nothing):
    got = op5_spans.dedup_spans(docs, 4, 8)
    assert got.columns == docs.columns and got.count() == len(DOCS) and op5_spans.dedup_spans(nothing).count() == 0
    by = defaultdict(list)
    for x in got.collect():
        by[x.doc_id].append(x)
        assert x.n_chars == len(x.text) and x._id == "extra"
    assert by[None][0].text == LINE.upper() and by[7][0].text == by[7][1].text and by[8][0].text == "" and by[2][0].text == ""


# 6
def test_lines_against_sql(spark):
    r = random.Random(4)
    pool = [("Line %d " % i + "pad " * r.randrange(4, 14)) for i in range(25)] + ["x" * 39, "x" * 40, "é" * 40, "É" * 40, " \t" + "y" * 45 + "\r"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(8)))) for i in range(60)]
    pdf = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pdf.toPandas())
    want = {x[0]: x[1:] for x in con.execute(op6_lines.OP6_SQL).fetchall()}
    for x in op6_lines.dedup_lines(pdf).collect():
        assert hashlib.sha256(x.text.encode()).hexdigest() == want[x.doc_id][2]
    assert sum(w[1] for w in want.values()) > 50


def test_lines_edge_cases(docs, nothing):
    got = op6_lines.dedup_lines(docs, documents=4)
    assert got.columns == docs.columns and op6_lines.dedup_lines(nothing).count() == 0
    text = defaultdict(list)
    for x in got.collect():
        text[x.doc_id].append(x.text)
        assert x._id == "extra" and x.n_chars == len(x.text)
    assert text[7] == ["short", "short"] and text[None] == [""] and text[8] == [""] and text[9] == [""] and text[10] == ["a\n" + LINE] and text[11] == [LINE + "!"] and text[2] == [""]


def test_line_runs_compact_and_know_new_keys(spark):
    runs = op6_lines.LineRuns(spark, 3, fan_in=2)
    batch = lambda b, keys: spark.createDataFrame([(b * 100 + i, k, k * 7) for i, k in enumerate(keys)], "doc_id long, hi long, lo long")
    assert runs.add(batch(0, [1, 2, 3])) == (3, 3)
    assert runs.add(batch(1, [2, 3, 4])) == (3, 1)
    assert runs.add(batch(2, []).limit(0)) == (0, 0)
    assert runs.add(batch(3, [1, 1, 4, 5])) == (4 - 1, 1)
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted(map(tuple, runs.frequent(2).collect())) == [(1, 7, 301), (2, 14, 100), (3, 21, 101), (4, 28, 302)]


def test_keys_that_share_64_bits():
    run = np.array([(1, 1, 1, 1, 1), (1, 5, 1, 1, 1), (2, 0, 1, 1, 1)], op6_lines.RUN)
    assert op6_lines.unknown(np.array([(1, 3, 1, 1, 0), (1, 5, 1, 1, 0), (2, 0, 1, 1, 0), (9, 9, 1, 1, 0)], op6_lines.RUN), [run]).tolist() == [True, False, False, True]


@pytest.mark.parametrize("answer", [False, True])
def test_the_anti_join_decides(spark, monkeypatch, tmp_path, answer):
    batches = [np.array([(k, 0, 1, b, 0) for k in keys], op6_lines.RUN) for b, keys in enumerate(([1, 2], [2, 3]))]
    files = op6_lines.Shares(f"file://{tmp_path}")
    (tmp_path / "r0").mkdir(), (tmp_path / "r1").mkdir()

    def load(found):
        for i, b in enumerate(batches):
            b = b.copy()
            b["own"] = found(b, [x for k in range(i) for x in files.read(f"r{k}", 0)])
            files.write(f"r{i}", 0, iter([b]))
        return [tuple(x) for blocks in files.merged(["r0", "r1"], 0) for x in blocks.tolist()]

    assert load(op6_lines.unknown) == [(1, 0, 1, 0, 1), (2, 0, 2, 1, 1), (3, 0, 1, 1, 1)]
    if answer:
        with pytest.raises(RuntimeError):
            load(lambda b, _: np.full(len(b), answer))
    else:
        assert not any(x[4] for x in load(lambda b, _: np.full(len(b), answer)))


def test_runs_in_blocks(monkeypatch, tmp_path):
    monkeypatch.setattr(op6_lines, "BLOCK", 3)
    r = random.Random(7)
    files, want = op6_lines.Shares(f"file://{tmp_path}"), {}
    for k in range(4):
        (tmp_path / f"r{k}").mkdir()
        keys = sorted({(r.randrange(9), r.randrange(9)) for _ in range(r.randrange(40))})
        x = np.array([(a, b, 1, k, (a, b) not in want) for a, b in keys], op6_lines.RUN)
        for a, b in keys:
            want[a, b] = (want.get((a, b), (0, 0))[0] + 1, k)
        files.write(f"r{k}", 5, iter([x] if len(x) else []))
    got = [tuple(x) for blocks in files.merged([f"r{k}" for k in range(4)], 5) for x in blocks.tolist()]
    assert got == [(a, b, *want[a, b], 1) for a, b in sorted(want)]


# 7
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_fills_sequences_under_every_capacity(rule):
    r = random.Random(6)
    for tokens, docs, attention in ((100, 100, 10_000), (100, 3, 10_000), (100, 50, 4_000)):
        most = min(tokens, int(attention**0.5))
        counts = dict(Counter(r.randrange(1, most + 1) for _ in range(3000)))
        m = op7_packing.plan(counts, tokens, docs, attention, rule)
        held = defaultdict(list)
        seen = Counter()
        for n, rank, k, first, at in m.tolist():
            for i in range(k):
                held[first + i].append((at, n))
            seen[n] += k
        assert seen == counts
        for x in held.values():
            x.sort()
            assert [a for a, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))]
            assert sum(n for _, n in x) <= tokens and len(x) <= docs and sum(n * n for _, n in x) <= attention
        bound = max(sum(n * c for n, c in counts.items()) / tokens, sum(counts.values()) / docs, sum(n * n * c for n, c in counts.items()) / attention)
        assert len(held) <= bound * (1.02 if (rule, docs, attention) == ("norm", 100, 10_000) else 1.7) + 1
    with pytest.raises(ValueError):
        op7_packing.plan({101: 1}, 100)


def test_packing_whole_documents(spark, docs, nothing):
    got = op7_packing.pack_documents(docs, LOWER, tokens=64).collect()
    t = Tokenizer.from_file(LOWER)
    t.encode_special_tokens = True
    want = Counter()
    for d, text in DOCS:
        x = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(x), 64):
            want[d, k // 64, k, len(x[k : k + 64]), zlib.crc32(np.array(x[k : k + 64], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    assert op7_packing.pack_documents(nothing, LOWER).count() == 0


# 8
def test_classifier_learns_and_holds_out(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(800):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() + ("!!" if bad and r.random() < 0.5 else "") for _ in range(40)), int(not bad)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in op8_quality.score(docs, op8_quality.train(docs, labels, max_rows=400)).collect()}
    test = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 100 and sum((s >= 0.3) == y for s, y in test) / len(test) > 0.95
    flipped = labels.withColumn("quality", F.when(op8_quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x.doc_id: x.score for x in op8_quality.score(docs, op8_quality.train(docs, flipped, max_rows=400)).collect()}
    assert again == got  # held-out labels play no part, and training is reproducible


def test_scores_of_edge_cases(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = op8_quality.train(docs, none)
    got = op8_quality.score(docs, model).collect()  # column score is replaced
    assert [x.score for x in got] == [0.5] * len(DOCS) and op8_quality.score(nothing, model).count() == 0
    assert op8_quality.keep_good(docs, model, 0.6).count() == 0 and op8_quality.keep_good(docs, model, 0.5).count() == len(DOCS)


def test_score_is_the_dot_product():
    f = op8_quality.Features()
    at, x = f.of("One two two, three 3 THREE\n" * 3)
    assert (np.diff(at) > 0).all() and abs((x * x).sum() - 1) < 1e-9
    assert len(f.of("")[0]) == 0 and f.of("a b")[0].tolist() != f.of("b a")[0].tolist()


def slow_features(text, bits=op8_quality.BITS):
    """Counts by bucket, from the definition, in whole numbers."""
    import re

    import xxhash

    m64 = (1 << 64) - 1
    mix, form, pair, again = (int(x) for x in (op8_quality._MIX, op8_quality._SHAPE, op8_quality._PAIR, op8_quality._AGAIN))
    n = Counter()
    w = [xxhash.xxh3_64_intdigest(x) & ~0xFFFFFF | op8_quality.shape(x) & 0xFFFFFF for x in re.findall(r"\w+|[^\w\s]+", text or "")]
    s = [(x & 0xFFFFFF) * form & m64 for x in w]
    for x in [*w, *s, *((a ^ b * pair & m64) * pair & m64 for a, b in zip(w, w[1:])), *(a ^ b * pair & m64 for a, b in zip(s, s[1:])), *((a == b) * again + again & m64 for a, b in zip(w, w[1:]))]:
        n[(x * mix & m64) >> 64 - bits] += 1
    return n


def test_features_against_their_definition():
    a, b = "x" * 300, "x" * 299 + "y"
    long = " ".join(random.Random(1).choices(["alpha", "beta", "Gamma", "delta,", "x" * 400, "!!!!!?", "!!!!!!"], k=40_000))
    assert len(long) > 1 << 21
    f = op8_quality.Features()
    for text in ["", "one", "One two two, three 3 THREE", f"{a} {b}", "wow!!!!! ok!!!!?", long, *odd_texts(60)]:
        n = slow_features(text)
        at, x = f.of(text)
        assert at.tolist() == sorted(n)
        size = sum(k * k for k in n.values()) ** 0.5
        assert np.allclose(x, [n[k] / size for k in sorted(n)], rtol=1e-12)
    assert f.of(a)[0].tolist() != f.of(b)[0].tolist()


def test_training_and_scores_against_slow_versions(spark):
    r = random.Random(11)
    rows = [(i, " ".join(r.choice("ab cd ef gh ij kl".split()) + ("!" if i % 3 == 0 and r.random() < 0.4 else "") for _ in range(20)), int(i % 3 > 0)) for i in range(60)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [rows[1][:2], (1, "zz")], "doc_id long, text string")  # a repeated row, and a second text of an id
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    z, n, bias = defaultdict(float), defaultdict(float), -1

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + n[k] ** 0.5) / alpha + l2)

    def vector(text):
        c = slow_features(text)
        size = sum(v * v for v in c.values()) ** 0.5 or 1
        return {k: v / size for k, v in c.items()}

    order = [r.doc_id for r in labels.where(~op8_quality.held_out()).orderBy(F.xxhash64("doc_id")).collect()]
    by = {i: (vector(t), y) for i, t, y in rows}
    for _ in range(16):
        for i in order:
            x, y = by[i]
            x = {k: float(np.float32(v)) for k, v in x.items()} | {bias: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in x.items():
                g, w = (p - y) * v, weight(k)
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * w
                n[k] += g * g
    got = {(x.doc_id, x.text): x.score for x in op8_quality.score(docs, op8_quality.train(docs, labels)).collect()}
    for i, t, _ in rows:
        want = 1 / (1 + math.exp(-weight(bias) - sum(weight(k) * v for k, v in vector(t).items())))
        assert abs(got[i, t] - want) < 1e-4, (i, got[i, t], want)


# 10
def test_fingerprint_against_its_definition():
    import xxhash

    for text in ["", None, " \t\n", "One", "one TWO", "a b c", "a b c a b c d É", "x " * 500]:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split() if text else []
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert op10_simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, most):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= most:
            root[find(a)] = find(b)
    return Counter(frozenset(g) for g in [[x for x in fps if find(x) == r] for r in {find(f) for f in fps}])


@pytest.mark.parametrize("many", [1024, 3])
def test_links_against_all_pairs(spark, monkeypatch, many):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(150)}
    for _ in range(250):  # chains and clusters at one, two and three bits
        fps.add(r.choice(sorted(fps)) ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3]))))
    fps |= {7, 6, 5, 4, 0, 1 << 63, (1 << 64) - 1}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    monkeypatch.setattr(op10_simhash, "MANY", many)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = components(op10_simhash.links(df)).collect()
    by = defaultdict(set)
    for x in got:
        by[x.root].add(x.node % (1 << 64))
    want = groups(sorted(fps), 2)
    assert Counter(frozenset(g) for g in by.values()) == Counter({g: n for g, n in want.items() if len(g) > 1})


def test_large_files_are_filed_again():
    r = random.Random(4)
    free = (1 << 22) - 1
    x = np.array(sorted({r.getrandbits(22) for _ in range(3000)}), np.uint64)
    pairs = lambda p: {tuple(sorted(t)) for t in zip(*(v.tolist() for v in p))}
    assert pairs(op10_simhash.near_in_parts(x, free)) == pairs(op10_simhash.near_pairs(x, np.zeros(len(x), int)))


def test_ids_of_several_texts_are_several_documents(spark):
    a, b = "one text of quite a few words here", "something else altogether that is not alike at all"
    rows = [(3, a), (5, a), (5, b), (9, b), (None, "null has a text of its own"), (None, b), (9, "null has a text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for dedup in (op10_simhash.dedup_near, op10_similar.dedup_similar):
        assert Counter(map(tuple, dedup(df).collect())) == Counter([(3, a), (None, b), rows[4]])


def test_near_components_edge_cases(spark, docs, nothing):
    got = op10_simhash.near_components(docs).collect()
    assert len(got) == len(DOCS) and op10_simhash.near_components(nothing).count() == 0
    by = defaultdict(set)
    for x in got:
        by[x.doc_id].add((x.fp, x.component_id))
    assert by[2] == by[3] == by[4] == {(0, 2)} and {c for _, c in by[None]} == {None} == {c for _, c in by[7]} ^ {c for _, c in by[7]} | {None}
    kept = [x.doc_id for x in op10_simhash.dedup_near(docs).collect()]
    assert 2 in kept and 3 not in kept and None in kept


def test_components_of_chains(spark):
    r = random.Random(0)
    nodes = list(range(300))
    r.shuffle(nodes)
    chain = list(zip(nodes[:200], nodes[1:200])) + [(nodes[200], n) for n in nodes[201:]]
    got = {x.node: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {n: min(nodes[:200]) for n in nodes[:200]} | {n: min(nodes[200:]) for n in nodes[200:]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts_are_linked(spark, docs, nothing):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, family, n = [], {}, 0
    for _ in range(40):
        base = [word() for _ in range(300)]
        for k in (0, 0, 1, 2, 4):  # a changed word breaks five shingles
            w = list(base)
            for i in r.sample(range(300), k):
                w[i] = word()
            rows.append((n, " ".join(w)))
            family[n] = n - n % 5
            n += 1
    got = {x.doc_id: x.component_id for x in op10_similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == family
    kept = [x.doc_id for x in op10_similar.dedup_similar(docs).collect()]
    assert kept.count(None) == 1 and 8 not in kept and 12 in kept and op10_similar.dedup_similar(nothing).count() == 0


def test_reach_against_all_pairs():
    r = np.random.RandomState(2)
    base = r.randint(0, 1 << 62, (6, op10_similar.WORDS)).astype(np.uint64)
    x = base[r.randint(0, 6, 80)]
    for i in range(80):
        for _ in range(r.randint(0, 60)):
            x[i, r.randint(0, 8)] ^= np.uint64(1) << np.uint64(r.randint(0, 64))
    most = op10_similar.most_bits()
    d = np.bitwise_count(x[:, None] ^ x[None]).sum(2) <= most
    i, j = np.nonzero(d)
    want = op10_simhash.roots(80, i, j)
    assert op10_similar.reach(x, most).tolist() == want.tolist()


def test_similar_just_above_and_below_the_limit(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, want = [], {}
    # Words, words cut off the end, words put there: 0.8 or more of the shingles are shared, or just not.
    above = [(94, 10, 10), (84, 0, 20), (164, 17, 17), (8, 0, 1), (10, 0, 1), (16, 0, 3), (13, 1, 1)]
    below = [(94, 11, 11), (84, 0, 21), (164, 18, 18), (7, 0, 1), (15, 0, 3), (12, 1, 1), (94, 13, 13)]
    for _ in range(25):
        for k, (n, cut, put) in enumerate(above + below):
            w = [word() for _ in range(n)]
            x = [*w[: n - cut], *(word() for _ in range(put))]
            i = len(rows)
            rows += [(i, " ".join(w)), (i + 1, " ".join(x))]
            same, all_ = n - 4 - cut, n - 4 + put
            assert (5 * same >= 4 * all_) == (k < len(above))
            want[i], want[i + 1] = i, i if k < len(above) else i + 1
    rows += [(None, "  " + rows[0][1].upper()), (1, rows[1][1]), (None, None), (9999, " ")]
    got = op10_similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {x.doc_id: x.component_id for x in got}
    assert len(got) == len(rows) and by[0] is by[1] is by[None] is by[9999] is None
    wrong = [i for i in want if i > 1 and by[i] != want[i]]
    assert not wrong


def test_groups_beyond_memory(monkeypatch, tmp_path):
    r = random.Random(6)
    base = [b"%d" % r.randrange(10**6) for _ in range(60)]
    texts = [[*base[:k], *(b"%d" % r.randrange(10**6) for _ in range(60 - k))] for k in (60, 58, 55, 54, 30, 29, 20)]

    def solved():
        g = op10_similar.Group(f"file://{tmp_path}/shingles")
        for i, w in enumerate(texts):
            g.add(b"%016d" % i, op10_similar.sketch(b" ".join(w).decode())[2], op10_similar.shingles(w, 5))
        return [[int(x) for x in side] for side in g.links(0.8)], g.path

    whole, none = solved()
    monkeypatch.setattr(op10_similar, "HELD", 100)
    spilled, file = solved()
    assert whole == spilled == [[1, 2, 3], [0, 0, 0]] and none is None and file is not None and not list((tmp_path / 'shingles').iterdir())
