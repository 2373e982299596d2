"""Token counts under a unigram piece model, by dynamic programming over a shared trie.

The distinct pre-tokens of a slice of texts form a trie.  Each node has the best score of any
segmentation of its prefix and that segmentation's length, worked out once however many
pre-tokens share the prefix; the node a pre-token ends in has the count it needs.  Pre-tokens
in sorted order are a depth-first walk of that trie, so only the path to the current node is
kept in memory, and of finished nodes only the counts of pre-tokens.
"""

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from passbook.llm.common import slices

#: Counts kept per task; beyond that they are dropped and worked out anew: equal results.
MAX_COUNTS = 500_000
SLICE_BYTES = 4_000_000


def load_pieces(path: str) -> dict[str, float]:
    """Log-probabilities of a SentencePiece model's pieces.

    The model lists pieces by rank; a piece of rank r gets Zipf's probability c / (r + 1).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = sum(1 / (r + 1) for r in range(len(plain)))
    return {piece: -math.log((r + 1) * total) for r, piece in enumerate(plain)}


class PieceTrie:
    """``add(words)``, then ``counts[word]``: pieces of the best segmentation of a word.

    Words are segmented behind a word mark.  A character no piece covers costs one token per
    UTF-8 byte, each at ``byte_score``.  Of equally good segmentations the one whose last
    piece is longest wins, at every prefix; single bytes come last.
    """

    def __init__(self, pieces: dict[str, float], byte_score: float | None = None):
        self.byte_score = min(pieces.values(), default=0.0) - 1 if byte_score is None else byte_score
        self.longest = max(map(len, pieces), default=1)
        self.finder = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.finder.add_word(piece, (len(piece), score))
        self.finder.make_automaton()
        self.counts: dict[str, int] = {}

    def add(self, words: set[str]) -> None:
        if len(self.counts) > MAX_COUNTS:
            self.counts.clear()
        known, byte_score = self.counts, self.byte_score
        score, length, before = [0.0], [0], ""  # by depth, along the path to `before`
        for word in sorted(words - known.keys()):
            marked = "\u2581" + word
            depth = 0
            for a, b in zip(before, marked, strict=False):
                if a != b:
                    break
                depth += 1
            del score[depth + 1 :], length[depth + 1 :]
            top = depth
            for last, (size, piece) in self.finder.iter(marked, max(0, depth + 1 - self.longest)):
                if last < depth:
                    continue
                while top <= last:
                    self.spell(marked[top], score, length)
                    top += 1
                start = last + 1 - size
                if score[start] + piece > score[top]:
                    score[top], length[top] = score[start] + piece, length[start] + 1
            for char in marked[top:]:
                self.spell(char, score, length)
            known[word], before = length[-1], marked

    def spell(self, char: str, score: list[float], length: list[int]) -> None:
        """One depth more, by the bytes of ``char``."""
        size = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
        score.append(score[-1] + size * self.byte_score)
        length.append(length[-1] + size)


#: Tries of this Python worker, by model: its later tasks know the counts of earlier ones.
_TRIES: dict[str, PieceTrie] = {}


def trie_of(model: str) -> PieceTrie:
    if model not in _TRIES:
        _TRIES[model] = PieceTrie(load_pieces(model))
    return _TRIES[model]


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, n_chars, n_bytes) of every whole text.

    Pre-tokens are the runs without white space, each behind a word mark.  A null or empty
    text has zeros; rows with equal keys are counted one by one; other columns are left out.
    ``model``: path of a SentencePiece file every executor has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(model)
        for batch in slices(batches, text, SLICE_BYTES):
            rows = []
            texts = [value or "" for value in batch.column(text).to_pylist()]
            split = [value.split() for value in texts]
            trie.add({w for words in split for w in words})
            for value, words in zip(texts, split, strict=True):
                tokens = sum(map(trie.counts.__getitem__, words))
                rows.append((len(words), tokens, len(value), len(value.encode())))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, *NAMES])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in NAMES)
    return docs.select(key, text).mapInArrow(count, schema)


NAMES = ["n_words", "n_tokens", "n_chars", "n_bytes"]
