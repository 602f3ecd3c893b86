"""Token counts: count-only Viterbi over a unigram vocabulary."""
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, CACHE, PENALTY = "▁", 400_000, 10.0
_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


class Counter:
    """Counts pieces of the best segmentation of a whole text, with SPACE before it and for each space.

    A text is cut only before a SPACE after another character, where no piece reaches across; a run
    of spaces stays with its next word. A vocabulary with pieces that do reach across, or without
    SPACE alone, has no cuts. The best score wins; of equal
    scores the path whose last piece starts first, as unigram tokenizers that scan starts in order
    and replace on a strictly better score only. A character that no piece of one character covers
    costs the lowest score less PENALTY and counts as its UTF-8 bytes if `byte_fallback`, else
    neighbours of that kind count as one. Memory of the search is bounded by the longest piece.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.auto, self.single = ahocorasick.Automaton(), set()
        for p, s in pieces:
            if p and (p not in self.auto):
                self.auto.add_word(p, (len(p), s))
                if len(p) == 1:
                    self.single.add(p)
        self.auto.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.whole = SPACE not in self.single or any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.low, self.bytes, self.cache = min((s for _, s in pieces), default=0.0) - PENALTY, byte_fallback, {}

    def word(self, w: str) -> int:
        longest, low, single = self.longest, self.low, self.single
        found = self.auto.iter(w)
        match, base, cut = next(found, None), 0, 8 * self.longest + 4096
        # Entry k is the place base + k; a piece reaches back `longest` places, so older ones go.
        score, count, unk = [0.0], [0], [False]
        for e, char in enumerate(w, 1):
            best, c, u = None, 0, False
            while match is not None and match[0] < e:  # longest first
                k, s = match[1]
                x = score[e - k - base] + s
                if best is None or x > best:
                    best, c, u = x, count[e - k - base] + 1, False
                match = next(found, None)
            if char not in single:
                x = score[-1] + low
                if best is None or x > best:
                    c = count[-1] + (len(char.encode("utf-8", "replace")) if self.bytes else not unk[-1])
                    best, u = x, True
            score.append(best)
            count.append(c)
            unk.append(u)
            if len(score) > cut:
                base += len(score) - longest - 1
                del score[: -longest - 1], count[: -longest - 1], unk[: -longest - 1]
        return count[-1]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole:
            return self.word(SPACE + text.replace(" ", SPACE))
        if "  " in text or text[0] == " " or SPACE in text:
            parts = [w[1:] for w in _CUT.split(SPACE + text.replace(" ", SPACE))]
        else:
            parts = text.split(" ")
        total, get = 0, self.cache.get
        for w in parts:
            n = get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(self.cache) < CACHE and len(w) < 40:
                    self.cache[w] = n
            total += n
        return total


def load(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, byte_fallback: bool = True) -> DataFrame:
    """One row per document: id, n_tokens. Null and empty texts have 0; repeated rows each give a row.

    The file is read once on the driver; its pieces (bounded by the vocabulary) are broadcast.
    """
    b = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        c = Counter(b.value, byte_fallback)
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "n_tokens": [c.text(t) for t in x["t"]]})

    return d.mapInPandas(run, f"id {dict(d.dtypes)['id']}, n_tokens long").withColumnRenamed("id", id_col)
