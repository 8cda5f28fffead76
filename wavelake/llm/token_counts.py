"""Token counts without tokens: Aho-Corasick finds a unigram vocabulary's pieces, dynamic programming carries the best score and its number of pieces."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value of unigram tokenizers: an unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts a unigram tokenizer's tokens, with byte fallback: a character that no piece covers gives a token for each of its bytes.

    At each end the best way there is the one with the highest score; of equal ones, the one whose last piece is longest, which is the first in the order
    that the automaton reports and the tokenizer tries: a later one must be better to replace it.
    """

    def __init__(self, pieces: list[tuple[str, float]], mark: str = "▁", memory: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.mark, self.memory, self.known = mark, memory, {}

    def segment(self, text: str) -> int:
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        unknown, at = self.unknown, 0

        def close(end: int) -> None:
            c = text[end - 1]
            if c not in self.single:
                s = unknown + score[end - 1]
                if score[end] is None or s > score[end]:
                    score[end], count[end] = s, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))

        for last, (length, value) in self.automaton.iter(text):
            end = last + 1
            while at < last:
                at += 1
                close(at)
            s = value + score[end - length]
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[end - length] + 1
        while at < n:
            at += 1
            close(at)
        return count[n]

    def _word(self, text: str) -> int:
        out = self.known.get(text)
        if out is None:
            out = self.segment(self.mark + text)
            if len(self.known) < self.memory:
                self.known[text] = out
        return out

    def count(self, text: str) -> int:
        """Tokens of a whole text. Blanks become marks, one stands before the text, and each mark begins a segment of its own."""
        if not text:
            return 0
        words = text.replace(self.mark, " ").split(" ")
        if not words[0]:
            del words[0]
        get, word = self.known.get, self._word
        return sum([get(w) or word(w) for w in words])


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens of the whole text. Null and empty texts have none; null ids stay null; repeated rows count each; nothing is shuffled."""

    def run(batches):
        c = counter(vocabulary_path)
        for batch in batches:
            n = [c.count(t) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
