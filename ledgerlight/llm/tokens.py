r"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary matches of a stretch of
text; dynamic programming carries, for each place, the best score so far and
the number of pieces on that path, and nothing else: no piece is ever built.
The rules are those of the SentencePiece unigram tokenizer: a space becomes
U+2581 and one stands in front of the text; a character that is no piece by
itself costs the least score less 10 and counts its UTF-8 bytes; of paths of equal
score the one with the longest last piece stays.  Scores are summed in double
precision.

Where no piece reaches over the start of a run of U+2581, nor over a line break,
a text falls into stretches whose best paths are independent; each worker keeps
the counts of a bounded number of stretches.  A vocabulary with pieces that do
is read without those cuts.  The state of a stretch is as long as the longest
piece, however long the text is.

Defined results: null and empty texts have no tokens; repeated rows are counted
row by row; other columns are not read; an empty vocabulary counts the UTF-8
bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import common

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches whose counts a worker keeps.
KEPT = 1 << 19
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece model file with their scores, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counts:
    """Piece counts of texts under a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], kept: int = KEPT):
        self.kept, self.memory = kept, {}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _ in pieces), default=1)
        line = "" if any("\n" in p for p, _ in pieces) else r"\n"
        # pieces that reach over the start of a word leave only the characters that no piece holds to part texts
        over = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        word = rf"[^{line}]+" if over and line else r"(?s).+" if over else rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+"
        self.stretches = re.compile(word + (r"|\n" if line else ""))

    def stretch(self, text: str) -> int:
        """Pieces on the best path of one stretch, from rings of scores and counts as long as the longest piece."""
        n, ring = len(text), self.longest + 1
        score, count = [0.0] * ring, [0] * ring
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        waiting = next(matches, None)
        for end in range(n):
            found = []
            while waiting is not None and waiting[0] == end:
                found.append(waiting[1])
                waiting = next(matches, None)
            best, pieces = None, 0
            # longest first: of equal scores the first stays
            for length, own in sorted(found, reverse=True):
                at = (end + 1 - length) % ring
                total = score[at] + own
                if best is None or total > best:
                    best, pieces = total, count[at] + 1
            if text[end] not in self.single:
                total = score[end % ring] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[end % ring] + len(text[end].encode())
            score[(end + 1) % ring], count[(end + 1) % ring] = best, pieces
        return count[n % ring]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for stretch, times in Counter(self.stretches.findall(SPACE + text.replace(" ", SPACE))).items():
            n = self.memory.get(stretch)
            if n is None:
                n = self.stretch(stretch)
                if len(self.memory) >= self.kept:
                    self.memory.clear()
                if len(stretch) <= 64:
                    self.memory[stretch] = n
            total += n * times
        return total


class _Counted:
    def __init__(self, pieces):
        self.pieces = pieces

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(self.pieces.value)
        for batch in batches:
            n = pa.array([counts(text.as_py()) for text in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n], ["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every whole text; the vocabulary, of fixed size, is broadcast."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    return narrow.mapInArrow(_Counted(shared), "doc_id bigint, n_tokens bigint")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 32,000-piece vocabulary read as a unigram one."""
    return token_counts(common.table(spark, sf_dir, "documents"), vocabulary())
