"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick finds the vocabulary's matches, Viterbi carries the best
score and its number of pieces. Ties go as in the tokenizer: of equal scores, the path whose last piece starts first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores this much less than the worst piece
REMEMBERED = 200_000  # counts of words that a worker keeps; it forgets them all when there would be more; one text's own come on top


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces of words. An unknown character counts as the bytes it has, if the vocabulary has all byte pieces; else a run of
    unknown characters counts as one piece."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        have = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in have for b in range(256))
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        best, count, open_ = [0.0], [0], [False]  # open_: the best path ends in an unknown character
        ends = iter(self.machine.iter(word))
        end, match = next(ends, (len(word), None))
        for i in range(len(word)):
            score, pieces, unknown, single = None, 0, False, False
            while end == i:  # longest first, so that a tie keeps the piece that starts first
                length, own = match
                start = i + 1 - length
                if score is None or own + best[start] > score:
                    score, pieces = own + best[start], count[start] + 1
                single |= length == 1
                end, match = next(ends, (len(word), None))
            if not single and (score is None or self.unknown + best[i] > score):
                score, unknown = self.unknown + best[i], True
                pieces = count[i] + (len(word[i].encode("utf-8", "surrogatepass")) if self.bytes else int(not open_[i]))
            best.append(score)
            count.append(pieces)
            open_.append(unknown)
        return count[-1]

    def text(self, text: str) -> int:
        """Words begin at each space; the first has one even if the text doesn't begin with it."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        found = list(map(self.known.get, words))
        if None not in found:
            return sum(found)
        new = {w: self.word(MARK + w) for w in {w for w, n in zip(words, found) if n is None}}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        self.known.update((w, n) for w, n in new.items() if len(w) < 64)
        return sum(new[w] if n is None else n for w, n in zip(words, found))


def count_tokens(docs: DataFrame, vocabulary_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens) per row. Null and empty texts have 0 tokens; repeated rows are counted each; long texts are taken whole;
    an empty table gives no rows; a null id stays null. Other columns aren't read."""

    def run(batches):
        counter = Counter(vocabulary(vocabulary_file))
        for batch in batches:
            counts = [counter.text(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    bounded(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
