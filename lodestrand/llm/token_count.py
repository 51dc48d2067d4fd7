"""Token counts without tokens: Aho-Corasick finds vocabulary pieces, a Viterbi pass carries score and piece count only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import one, require, slices, tidy

SPACE = "▁"
#: Distinct words each Python worker keeps with their counts; further ones are counted again in each slice.
KEPT_WORDS = 200_000
#: Below the lowest score of the vocabulary by this, as in the public unigram tokenizers.
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [(model.id_to_piece(k), float(model.get_score(k))) for k in range(model.get_piece_size())]


class PieceCounter:
    """How many pieces the best segmentation of a word has under a unigram vocabulary with byte fallback.

    The best has the highest sum of scores in double precision. Of equal sums that end at the same place, the one whose
    last piece starts first stays, as candidates are tried in the order of their starts and only a higher sum replaces
    one. A character that is no piece itself may be unknown, at the penalty; a run of unknown ones counts a piece for
    each UTF-8 byte.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.kept: dict[str, int] = {}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def viterbi(self, word: str) -> int:
        best, count, unknown = [0.0], [0], self.unknown
        top, n, whole = None, 0, False

        def close() -> None:
            """Ends the place after len(best) - 1 characters: its best is ``top``, or an unknown character."""
            nonlocal top, n, whole
            if not whole and (top is None or best[-1] + unknown > top):
                top, n = best[-1] + unknown, count[-1] + len(word[len(best) - 1].encode("utf-8", "surrogatepass"))
            best.append(top)
            count.append(n)
            top, n, whole = None, 0, False

        for end, (size, score) in self.automaton.iter(word):  # at each end the longest first
            while len(best) <= end:
                close()
            start = end + 1 - size
            total = best[start] + score
            if top is None or total > top:
                top, n = total, count[start] + 1
            whole = whole or size == 1
        while len(best) <= len(word):
            close()
        return count[-1]

    def counts(self, words: list[str]) -> list[int]:
        """Of words that begin with the mark."""
        kept, out = self.kept, []
        for word in words:
            if (c := kept.get(word)) is None:
                c = self.viterbi(word)
                if len(kept) < KEPT_WORDS and len(word) < 200:
                    kept[word] = c
            out.append(c)
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of texts: spaces become marks, one stands before a text, and each mark begins a word."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " "), " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes, offsets = coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]
        names = coded.dictionary.to_pylist()
        each = np.array(self.counts([SPACE + x for x in names]), np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        total = np.diff(np.concatenate([[0], np.cumsum(each)])[offsets])
        # a text that begins with a space gets no further mark, and an empty one has no tokens: its first word, empty, is none
        first = codes[np.minimum(offsets[:-1], max(0, len(codes) - 1))] if len(codes) else np.zeros(0, np.int64)
        bare = np.array([x == "" for x in names])[first] if len(codes) else np.zeros(len(total), bool)
        return total - np.where(bare, self.counts([SPACE])[0], 0)


_COUNTERS: dict[str | None, PieceCounter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col and n_tokens long for every row; null and empty texts have none.

    Texts are whole. A text with the mark ``▁`` itself is split at it like at a space. Rows that repeat each give a row; other
    columns are ignored; an empty table gives no rows. ``path`` names a sentencepiece model whose pieces and scores are
    taken as a unigram vocabulary.
    """
    require(docs, id_col, text_col)

    @tidy
    def run(batches):
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, PieceCounter(vocabulary(path)))
        for batch in (part for b in batches for part in slices(b, 1, 16 << 20)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter(one(batch.column(1))), pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType())]))
