"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists every vocabulary piece in a word; a forward pass
keeps, for each place, the best score of a way there and the number of its
tokens.  The rules are those of the tokenizers library's Unigram model behind its
Metaspace pre-tokenizer: at equal scores the way that was found first stays, that
is the one whose last piece starts earliest; a character that is no piece costs
the lowest score less ten; and a stretch of such characters becomes one unknown
token, or as many as it has bytes where the vocabulary has all byte pieces."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, hold, record, slices, windows, with_field
from .encoders import LONG, Words

SPACE, PENALTY = "▁", 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter:
    """Number of tokens of a word (a text between two spaces, with its mark).  The
    words of a batch are numbered by Arrow, and each distinct one is looked up once."""

    def __init__(self, pieces: list[tuple[str, float]], limit: int = 400_000):
        self.find, self.words = ahocorasick.Automaton(), Words(limit)
        for p, s in pieces:
            self.find.add_word(p, (len(p), s))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        have = {p for p, _ in pieces}
        self.bytes = all(f"<0x{i:02X}>" in have for i in range(256))

    def count(self, word: str) -> int:
        n = len(word)
        by_end: list[list[tuple[int, float]] | None] = [None] * (n + 1)
        for end, found in self.find.iter(word):
            if (x := by_end[end + 1]) is None:
                by_end[end + 1] = [found]
            else:
                x.append(found)
        best, tokens, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, last, single = 0.0, 0, False
            for size, score in by_end[end] or ():
                s = best[end - size] + score
                single |= size == 1
                if not last or s > top or s == top and size > last:
                    top, last = s, size
            if not single and (not last or best[end - 1] + self.unknown > top):
                best[end], open_[end] = best[end - 1] + self.unknown, True
                tokens[end] = tokens[end - 1] + (len(word[end - 1].encode()) if self.bytes else not open_[end - 1])
            else:
                best[end], tokens[end] = top, tokens[end - last] + 1
        return tokens[n]

    def _new(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.fromiter((self.count(SPACE + w) for w in words.to_pylist()), np.uint32, len(words))
        return n, np.arange(len(n)), np.ones(len(n), np.int64)

    def texts(self, texts: pa.StringArray) -> np.ndarray:
        """Tokens of each text.  A mark replaces each space, stands before the text,
        and starts a word."""
        texts = texts.cast(pa.string()).fill_null("")
        if len(texts) and pc.max(pc.binary_length(texts)).as_py() > LONG:
            return np.array([sum(int(self._texts(pa.array([w[1:] if i else w]), bool(i))[0]) for i, w in enumerate(windows(t.as_py(), LONG // 4))) for t in texts])
        return self._texts(texts, False)

    def _texts(self, texts: pa.StringArray, spaced: bool) -> np.ndarray:
        """spaced: a space was cut off in front of each text."""
        if not len(texts):
            return np.zeros(0, np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, " ", SPACE), SPACE)
        d, at = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()[:-1]
        pool, start, _ = self.words.look(d.dictionary, self._new)
        n = pool[start].astype(np.int64)[d.indices.to_numpy()]
        if not spaced:  # an empty first part is what stands before a mark of the text's own, or an empty text
            n[at[pc.equal(pc.binary_length(lists.flatten().take(pa.array(at))), 0).to_numpy(zero_copy_only=False)]] = 0
        return np.add.reduceat(n, at)

    def text(self, text: str) -> int:
        return int(self.texts(pa.array([text]))[0])


def counter(path: str) -> Counter:
    return hold(("unigram", path), lambda: Counter(read_pieces(path)))


def count_tokens(docs: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with column ``n_tokens``: tokens of the whole of ``text`` (null or
    empty: 0).  A column of that name is replaced; repeated rows stay."""
    keep = [c for c in docs.columns if c != n_tokens]
    df = docs.select(*[f"`{c}`" for c in keep])
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for part in slices(b, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.texts(part.column(at)))], names=[*keep, n_tokens])

    return df.mapInArrow(run, with_field(df.schema, n_tokens, T.LongType()))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: counts under the pieces and scores of a public vocabulary."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
    path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for b in slices(whole, "text"):
                yield record(schema, {"doc_id": b.column("doc_id"), "n_tokens": c.texts(b.column("text"))})

    docs = documents(spark, sf_dir)
    return docs.mapInArrow(run, "doc_id long, n_tokens long")
