"""Token counts under a unigram vocabulary, by a count-only Viterbi search.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends
at each position of a text; the search carries, per position, the best score
and the number of pieces of the best path, and nothing else: no path is kept.
Ties follow the unigram tokenizer: of candidates with equal scores, the one
whose last piece starts first stays.

Where every piece has its space marks in front, a best path never crosses from
a character to a following space mark; where scores are whole numbers too, sums
in double precision are exact, and a text's count is the sum over its words:
each distinct word of a block is searched once. With any other vocabulary, as
trained models are, sums depend on their order, so texts are searched whole,
from the first character on, as the tokenizer does.

Scale. One pass without a shuffle; the vocabulary (a fixed file) is read once
per worker, and the word cache is bounded: words beyond it are searched again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import RecentCache, blocks, held_by_process, offsets_of, tidy

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Counts of at most twice this many words are kept.
CACHE_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[tuple[str, float]]:
    """The normal pieces of a vocabulary file and their scores; control, unknown and byte pieces never match text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(m.get_piece_size())
    return [(m.id_to_piece(i), float(m.get_score(i))) for i in every if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class CountOnlyViterbi:
    """Counts pieces; characters that no piece covers fall back to one token per UTF-8 byte."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.by_words = all(s == int(s) and SPACE not in p.lstrip(SPACE) for p, s in vocabulary)
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.cache = RecentCache(CACHE_WORDS)

    def search(self, word: str) -> int:
        n = len(word)
        score, count, single = [0.0] * (n + 1), [0] * (n + 1), 0
        at = 0  # the position up to which ends are settled
        best: float | None = None
        for end, (length, value) in self.automaton.iter(word):
            end += 1
            while at < end - 1:  # ends that this match passes over
                at += 1
                self._settle(word, at, best, single, score, count)
                best, single = None, 0
            start = end - length
            candidate = score[start] + value
            if best is None or candidate > best or (candidate == best and start < first):
                best, first = candidate, start
                score[end], count[end] = candidate, count[start] + 1
            single |= length == 1
        while at < n:
            at += 1
            self._settle(word, at, best, single, score, count)
            best, single = None, 0
        return count[n]

    def _settle(self, word, at, best, single, score, count) -> None:
        """Where no one-character piece ends here, an unknown character is a candidate, the last one."""
        if not single and (best is None or score[at - 1] + self.unknown > best):
            score[at], count[at] = score[at - 1] + self.unknown, count[at - 1] + len(word[at - 1].encode())

    def words(self, distinct: list[str]) -> np.ndarray:
        search = self.search
        found = self.cache.get_all(distinct, lambda new: [search(w) for w in new])
        return np.fromiter(found, np.int64, len(found))

    def text(self, text: str) -> int:
        """Any text, with runs of spaces: a word is a run of space marks and what follows it."""
        if not text:
            return 0
        if not self.by_words:
            return self.search(SPACE + text.replace(" ", SPACE))
        return int(self.words(re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))).sum())

    def texts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return np.fromiter(map(self.text, texts.to_pylist()), np.int64, len(texts))
        odd = pc.match_substring_regex(texts, f"^ |  |{SPACE}").to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        flat = split.flatten().dictionary_encode()
        per = self.words([SPACE + w for w in flat.dictionary.to_pylist()])[flat.indices.to_numpy()]
        out = np.add.reduceat(np.append(per, 0), offsets_of(split)[:-1])
        out[empty] = 0
        for i in np.flatnonzero(odd):
            out[i] = self.text(texts[int(i)].as_py())
        return out


_READY: dict[str, CountOnlyViterbi] = {}
held_by_process(_READY.clear)


def _counter(path: str) -> CountOnlyViterbi:
    if path not in _READY:
        _READY[path] = CountOnlyViterbi(pieces(path))
    return _READY[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: the id, ``n_chars`` (code points) and ``n_tokens``.

    ``vocabulary`` is a file that all executors can read, by default that of
    the installed public tokenizers.

    Defined cases. Null or empty text: 0 tokens. Null ids and repeated rows
    pass through, a result for each row. No rows: no rows. A word of any
    length is searched whole. Other input columns are not looked at.
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for block in blocks(batches, limit=8 << 20):
            texts = block.column(1)
            chars = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([block.column(0), chars, pa.array(counter.texts(texts), pa.int64())], names=[id_col, "n_chars", "n_tokens"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(tidy(count), schema)


def op9_token_counts(spark, sf_dir):
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict = {}
