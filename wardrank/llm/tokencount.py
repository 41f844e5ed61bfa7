"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word; dynamic
programming over its characters carries only the best score and the number of
pieces on that path.  The counts equal those of a ``tokenizers`` ``Unigram``
model with byte fallback behind the pre-tokenizers ``WhitespaceSplit`` and
``Metaspace(prepend_scheme="always")``.  Its tie rules: starts are taken from
left to right, and a path into a position is replaced only by a strictly
better one, so of equal paths the one with the longest last piece wins; a
character that is no piece of its own may be unknown at the lowest score of
the vocabulary less 10, and counts as its UTF-8 bytes.

Counts of words are kept in a bounded table per task (``cache_words``); other
words are counted again.

Defined cases: null and empty texts have 0 words and 0 tokens; repeated
documents count alike; an empty table gives no rows; input columns named like
an added one are replaced.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, map_arrow

SPACE = "▁"
#: Fixed value: the penalty of an unknown character against the lowest score.
UNKNOWN_PENALTY = 10.0
_WORD = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PIECE = regex.compile(f"{SPACE}[^{SPACE}]*")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], cache_words: int = 200_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.cache_words = cache_words

    def pieces(self, word: str) -> int:
        """Number of pieces on the best path through one word.

        The automaton gives the matches by their end, at one end the longest
        first, which is the order of their starts.
        """
        best, count = [0.0], [0]
        top = pieces = None
        single = False
        unknown = self.unknown

        def close() -> None:
            """Settle the end that follows the settled ones."""
            nonlocal top, pieces, single
            if not single and (top is None or best[-1] + unknown > top):
                top = best[-1] + unknown
                pieces = count[-1] + len(word[len(best) - 1].encode("utf-8", "surrogatepass"))
            best.append(top)
            count.append(pieces)
            top, single = None, False

        for last, (length, score) in self.automaton.iter(word):
            while len(best) <= last:
                close()
            s = best[last + 1 - length] + score
            if top is None or s > top:
                top, pieces = s, count[last + 1 - length] + 1
            single = single or length == 1
        while len(best) <= len(word):
            close()
        return count[-1]

    def word(self, word: str) -> int:
        marked = word if word.startswith(SPACE) else SPACE + word
        n = sum(map(self.pieces, _PIECE.findall(marked)))
        if len(self.known) >= self.cache_words:
            self.known.clear()
        self.known[word] = n
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """(words, tokens) of a whole text."""
        words = _WORD.findall(text) if text else []
        known = self.known.get
        return len(words), sum(n if (n := known(w)) is not None else self.word(w) for w in words)


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text",
                 cache_words: int = 200_000) -> DataFrame:
    """``docs`` without the text, with ``n_words`` and ``n_tokens``."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_words", "n_tokens")]

    def run(batches):
        counter = UnigramCounter(vocabulary, cache_words)
        for b in batches:
            counts = [counter.text(t) for t in b[text].to_pylist()]
            yield {f.name: b[f.name] for f in kept} | {
                "n_words": [w for w, _ in counts], "n_tokens": [t for _, t in counts]}

    return map_arrow(docs.select(*(f.name for f in kept), text),
                     T.StructType([*kept, *fields("n_words long", "n_tokens long").fields]), run)
