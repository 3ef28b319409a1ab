"""Token counts: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word by their
ends, longest first; dynamic programming carries the best score and the number
of pieces of the best path to each position. No path is kept. Scores are 64-bit;
at equal scores the match that starts first wins, which is what the tokenizers
library does, as it replaces a node's best path only by a strictly better one.
A character that no single-character piece covers costs the least score minus 10
and counts as its UTF-8 bytes if the vocabulary holds byte pieces, else each run
of such characters counts as one.

The default vocabulary is a piece model that was made by merges; its pieces and scores
are taken as a unigram model's, as no model of that kind is at hand. Any sentencepiece
model file may be given.

Words are what a Metaspace pre-tokenizer gives: spaces become U+2581, one is put
before a text that doesn't begin with one, and a word begins at each. Counts of
words are remembered in each worker up to `CACHE` distinct ones; further words
are counted anew, so results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

SPACE = "▁"
CACHE = 400_000
Vocab = list[tuple[str, float]]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> Vocab:
    """The pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter(dict):
    """Word (without its leading mark) to number of pieces, filled as asked."""

    def __init__(self, vocab: Vocab, cache: int = CACHE):
        super().__init__()
        self.cache, self.trie = cache, ahocorasick.Automaton()
        pieces = {p: s for p, s in vocab if p}
        for piece, score in pieces.items():
            self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min(s for _, s in vocab) - 10.0
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))

    def __missing__(self, word: str) -> int:
        n = self.viterbi(SPACE + word)
        if len(self) < self.cache:
            self[word] = n
        return n

    def viterbi(self, text: str) -> int:
        size = len(text)
        best, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        end, found, single = 0, False, True  # the end being filled; whether a match ends there, and one of one character

        def close(k: int) -> None:
            """The unknown character is the last candidate of an end without a single-character piece."""
            s = best[k - 1] + self.unknown
            if not found or s > best[k]:
                best[k], unknown[k] = s, True
                count[k] = count[k - 1] + (len(text[k - 1].encode("utf-8", "surrogatepass")) if self.bytes else not unknown[k - 1])

        for at, (length, score) in self.trie.iter(text):
            at += 1
            if at != end:
                if not single:
                    close(end)
                found = False
                for k in range(end + 1, at):
                    close(k)
                end, single = at, False
            s = best[at - length] + score
            if not found or s > best[at]:
                best[at], count[at], unknown[at], found = s, count[at - length] + 1, False, True
            if length == 1:
                single = True
        if not single:
            close(end)
        found = False
        for k in range(end + 1, size + 1):
            close(k)
        return count[size]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]  # the text's own space serves as the mark
        return sum(map(self.__getitem__, words))


_counters: dict[tuple[str, int], Counter] = {}


def counter(path: str, cache: int = CACHE) -> Counter:
    """This worker's counter of a vocabulary file."""
    if (path, cache) not in _counters:
        _counters[path, cache] = Counter(load_vocabulary(path), cache)
    return _counters[path, cache]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the number of pieces of each text, a row for each row.

    A null or empty text has 0; a null doc_id stays null. Repeated rows repeat.
    An empty table gives no rows; other columns aren't read. vocabulary is the
    path of a sentencepiece model file that all executors can read."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                part = texts.slice(at, 256)
                yield pa.record_batch([batch.column(0).slice(at, 256), pa.array([count(t) for t in part.to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
