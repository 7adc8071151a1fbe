"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton of the pieces lists the matches that end at each character. Dynamic
programming carries the best score and that path's number of tokens from match to match; no path is
kept. Ties go as in the tokenizer: of equal scores at a place the path that was found first wins,
which is the one whose last piece is longest, and a character without a piece of its own may also be
unknown, at the lowest score less ten, found last. An unknown character counts as its UTF-8 bytes
(byte fallback).

Text is split before every space, which becomes the piece mark, and one mark comes first. Pieces
come from a vocabulary file; its order gives the scores, -ln(rank + 2) to ten binary places, so that
sums are exact in any order. Null and empty texts have no tokens. Repeated rows stay.
"""

from __future__ import annotations

import math
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from .common import Memory, per_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers, twice over.
CACHE_WORDS = 200_000


def pieces(path: str) -> list[tuple[str, float]]:
    """Pieces with scores from a sentencepiece file: its ordinary pieces by their place."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    texts = [model.id_to_piece(i) for i in plain]
    return [(t, -round(math.log(r + 2) * 1024) / 1024) for r, t in enumerate(texts) if MARK not in t[1:]]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.known = Memory(self.word, CACHE_WORDS)

    def word(self, word: str) -> int:
        """Tokens of one word, its mark included."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done, single, unknown = 0, self.single, self.unknown

        def close(to: int) -> None:
            """Places up to `to` have all their matches: see about unknown characters."""
            nonlocal done
            while done < to:
                c = word[done]
                done += 1
                if c not in single:
                    score = best[done - 1] + unknown
                    if best[done] is None or score > best[done]:
                        best[done] = score
                        count[done] = count[done - 1] + len(c.encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.automaton.iter(word):  # by end; the longest first
            if end > done:
                close(end)
            end += 1
            start = end - length
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end] = score
                count[end] = count[start] + 1
        close(n)
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        words = f"{'' if text[0] == ' ' else MARK}{text.replace(' ', ' ' + MARK)}"
        # No piece holds a line feed: what stands before and after one can be counted apart.
        known = self.known
        return sum([known[w] for w in words.replace("\n", " \n ").split(" ") if w])


@cache
def counter(path: str) -> Counter:
    """One for each worker process, which tasks share."""
    made = Counter(pieces(path))
    if any("\n" in w for w in made.automaton):
        raise ValueError("a piece holds a line feed")
    return made


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and n_tokens of each text."""

    def make():
        c = counter(path)
        return lambda texts: [[c.count(t) for t in texts]]

    return per_text(docs, [id_col], text_col, "n_tokens bigint", make)
