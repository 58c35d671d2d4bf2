"""Each stage of the pipeline on its own input, against what it must do."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from marlstone.llm.op10_similar import LEAST, SIZE

R = random.Random(12)
BOILER = "this boilerplate line is found at the foot of a great many documents"


def word():
    return "".join(R.choice("abcdefghijklmnop") for _ in range(R.randrange(3, 9)))


def sentence(n):
    return " ".join(word() for _ in range(n)).capitalize() + ". "


PASSAGE = "".join(sentence(14) for _ in range(5))


def corpus():
    docs, quality = {}, {}
    for i in range(400):
        text = "".join(sentence(R.randrange(8, 16)) for _ in range(R.randrange(6, 14))).strip()
        if i % 4 == 3:
            text = " ".join(w + "!!" for w in text.upper().split())
        if i % 10 == 1:
            text += "\n" + BOILER
        if i % 40 == 2:
            text += " " + PASSAGE.strip()
        docs[i], quality[i] = text, int(i % 4 != 3)
    for i in range(400, 420):  # copies, exact and with a changed word
        w = docs[(i - 400) * 4].split(" ")
        if i % 2:
            w[len(w) // 2] = "changed"
        docs[i], quality[i] = " ".join(w), 1
    docs[420] = None
    return docs, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, quality = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items() if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    out, docs = {"start": spark.read.parquet(f"{folder}/documents.parquet")}, spark.read.parquet(f"{folder}/documents.parquet")
    at = tmp_path_factory.mktemp("stages")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{at}/{name}")
        out[name] = docs = spark.read.parquet(f"{at}/{name}")
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_copies", "passages", "packing"]
    for name in ("quality", "lines", "near_copies", "passages"):
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in stages["passages"].collect())


def test_quality_keeps_clean_documents(stages):
    left = texts(stages["quality"])
    shouting = [i for i in range(400) if i % 4 == 3]
    assert all(i in left for i in range(400) if i % 4 != 3) and sum(i in left for i in shouting) <= 0.03 * len(shouting)


def test_lines_stay_in_the_last_document(stages):
    before, after = texts(stages["quality"]), texts(stages["lines"])
    holders = [i for i, t in before.items() if t and BOILER in t.split("\n")]
    assert len(holders) >= 20 and [i for i, t in after.items() if BOILER in t] == [max(holders)]
    assert all(after[i] == "\n".join(x for x in (t or "").split("\n") if x != BOILER) for i, t in before.items() if i != max(holders))


def test_one_document_of_each_group_stays(stages):
    before, after = texts(stages["lines"]), texts(stages["near_copies"])

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + SIZE]) for i in range(len(w) - SIZE + 1)}

    s = {i: shingles(t) for i, t in before.items()}
    gone = before.keys() - after.keys()
    near = lambda a, b: len(s[a] & s[b]) >= LEAST * len(s[a] | s[b])
    assert gone >= {i for i in range(400, 420) if any(near(i, j) for j in before if j < i)}
    assert all(any(near(i, j) for j in after) for i in gone) and all(after[i] == before[i] for i in after)


def test_passages_stay_where_they_are_first(stages):
    before, after = texts(stages["near_copies"]), texts(stages["passages"])
    holders = sorted(i for i, t in before.items() if PASSAGE.strip() in t)
    assert len(holders) > 5 and [i for i in after if PASSAGE.strip() in after[i]] == holders[:1]
    assert not any(PASSAGE.split(". ")[2] in after[i] for i in holders[1:])
    assert all(after[i] == t for i, t in before.items() if i not in holders)


def test_packing_holds_every_token(stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for i, text in texts(stages["passages"]).items():
        x = [*t.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(x), 2048):
            want[i, k // 2048, k, zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())] += 1
    got = stages["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048


def test_run_is_the_stages_in_a_row(spark, folder, stages):
    strip = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert strip(pipeline.run(spark, folder)) == strip(stages["packing"])
