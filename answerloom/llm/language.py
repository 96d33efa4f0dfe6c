"""Language by unigram pieces, summed over every segmentation.

The pieces of a public vocabulary have a probability in each language. The score of a word
is the sum, over all ways to cut it into pieces, of the product of their probabilities; a
forward pass computes it in one step a character. A text's log-likelihood is the sum over
its words. Different words are scored once a worker, many of one length at a time; a word of
over ``LONG_WORD`` characters goes alone, with the same sum, its lattice made block by block.
Words are lower-cased, so cased pieces of the vocabulary take no part; any length of piece does.

The probabilities are expected counts over the training texts: each word's segmentations
weighted under the vocabulary's own order (a piece of rank r starts with weight 1/(r+10)).
All training rows are counted, in one pass.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import id_and_text, slices

#: Longer words are scored one by one, in the same way; nothing is cut.
LONG_WORD = 64
#: Characters of a long word whose pieces are looked up at once.
LONG_BLOCK = 256
SMOOTHING = 0.5
#: Log-likelihoods grow with the text; the score is judged at this share of a character.
SHARPNESS = 0.25
BATCH_BYTES = 6 << 20
KNOWN_WORDS = 400_000
BATCH_WORDS = 20_000
_START = "▁"
_BASE = np.uint64(0x100000001B3)
_LETTER = re.compile(r"[^\W\d_]")


class Pieces:
    """The pieces of a vocabulary file, found by a hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usual = [
            i for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        pieces = [model.id_to_piece(i) for i in usual]
        chosen = [(p, i) for p, i in zip(pieces, usual, strict=True) if p]
        self.longest = max(len(p) for p, _ in chosen)
        self.count = len(chosen) + 1  # the last one is any single character without a piece
        codes = np.zeros(len(chosen), dtype=np.uint64)
        for k, (piece, _) in enumerate(chosen):
            codes[k] = self._codes(np.array([[ord(c) for c in piece]], dtype=np.uint64), 0, len(piece))[0]
        order = np.argsort(codes)
        self.codes = codes[order]
        self.place = order
        prior = np.array([1.0 / (i + 10) for _, i in chosen] + [1e-6])
        self.prior = prior / prior.sum()

    @staticmethod
    def _codes(chars: np.ndarray, start: int, stop: int) -> np.ndarray:
        value = np.full(len(chars), 14695981039346656037, dtype=np.uint64)
        for j in range(start, stop):
            value = (value ^ chars[:, j]) * _BASE
        return value ^ (value >> np.uint64(32))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Piece of each code, or -1."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.place[at], -1)

    def lattice(self, words: list[str]) -> tuple[list[list[tuple[int, np.ndarray]]], int]:
        """For words of one length: at each end, (start, piece of each word or -1)."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(-1, n).astype(np.uint64)
        steps: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            raw = np.full(len(chars), 14695981039346656037, dtype=np.uint64)
            for stop in range(start + 1, min(n, start + self.longest) + 1):
                raw = (raw ^ chars[:, stop - 1]) * _BASE
                piece = self.find(raw ^ (raw >> np.uint64(32)))
                if stop == start + 1:
                    piece = np.where(piece < 0, self.count - 1, piece)
                if (piece >= 0).any():
                    steps[stop].append((start, piece))
        return steps, n

    def beginning(self, chars: np.ndarray, low: int, high: int) -> np.ndarray:
        """(high - low, longest): the piece of each length that begins at each place, or -1."""
        found = np.full((high - low, self.longest), -1, dtype=np.int64)
        raw = np.full(high - low, 14695981039346656037, dtype=np.uint64)
        for size in range(1, self.longest + 1):
            rows = min(high, len(chars) - size + 1) - low
            if rows <= 0:
                break
            raw = (raw[:rows] ^ chars[low + size - 1 : low + size - 1 + rows]) * _BASE
            found[:rows, size - 1] = self.find(raw ^ (raw >> np.uint64(32)))
        found[:, 0] = np.where(found[:, 0] < 0, self.count - 1, found[:, 0])
        return found

    def by_end(self, chars: np.ndarray) -> Iterator[np.ndarray]:
        """Blocks of (ends, longest): the pieces that stop at each end, ends ascending."""
        sizes = np.arange(1, self.longest + 1)
        for done in range(0, len(chars), LONG_BLOCK):
            high = min(len(chars), done + LONG_BLOCK)
            low = max(0, done + 1 - self.longest)
            starts = np.arange(done + 1, high + 1)[:, None] - sizes
            found = self.beginning(chars, low, high)
            yield np.where(starts >= 0, found[np.maximum(starts, low) - low, sizes - 1], -1)

    def by_start(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of (first place, pieces beginning at each place), blocks from the last one on."""
        for low in reversed(range(0, len(chars), LONG_BLOCK)):
            yield low, self.beginning(chars, low, min(len(chars), low + LONG_BLOCK))


def forward(steps, n: int, chance: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Log of the summed segmentations (words, languages); forward values and their scales.

    ``chance`` has a row per piece and a zero row at the end, which index -1 meets.
    """
    words = len(steps[1][0][1])
    alpha = [np.ones((words, chance.shape[1]))]
    scale = [np.zeros((words, chance.shape[1]))]  # log of what alpha was divided by, summed
    for stop in range(1, n + 1):
        deep = scale[stop - 1]
        value = np.zeros_like(alpha[0])
        for start, piece in steps[stop]:
            value += alpha[start] * chance[piece] * np.exp(scale[start] - deep)
        top = np.maximum(value, 1e-300)
        alpha.append(value / top)
        scale.append(deep + np.log(top))
    return scale[n], alpha, scale


def expected_counts(pieces: Pieces, words: list[str], weights: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Expected pieces of weighted words of one length, under one column of probabilities."""
    steps, n = pieces.lattice(words)
    total, _, ahead = forward(steps, n, chance)
    behind = [np.full(len(words), -np.inf) for _ in range(n + 1)]
    behind[n] = np.zeros(len(words))
    counts = np.zeros(pieces.count + 1)
    log_chance = np.log(np.maximum(chance[:, 0], 1e-300))
    log_chance[-1] = -np.inf
    for stop in range(n, 0, -1):
        for start, piece in steps[stop]:
            part = log_chance[piece] + behind[stop]
            behind[start] = np.logaddexp(behind[start], part)
            share = np.exp(ahead[start][:, 0] + part - total[:, 0]) * weights
            np.add.at(counts, piece, share)
    return counts[:-1]


def chained(blocks, chance: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Log sums over all segmentations up to each place of one word, a value for each language.

    ``blocks`` has a row of pieces by length for each place; only the last ``longest`` sums are held.
    """
    recent = np.zeros((longest, chance.shape[1]))  # newest first, divided by the newest
    recent[0] = 1.0
    deep = np.zeros(chance.shape[1])
    for table in blocks:
        for weights in chance[table]:
            value = (recent * weights).sum(axis=0)
            top = np.maximum(value, 1e-300)
            recent[1:] = recent[:-1] / top
            recent[0] = value / top
            deep = deep + np.log(top)
            yield deep


def _chars(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def long_forward(pieces: Pieces, word: str, chance: np.ndarray) -> np.ndarray:
    """``forward``'s sum for one word of any length, in memory that does not grow with it."""
    total = np.zeros(chance.shape[1])
    for total in chained(pieces.by_end(_chars(word)), chance, pieces.longest):
        pass
    return total


def long_counts(pieces: Pieces, word: str, weight: float, chance: np.ndarray) -> np.ndarray:
    """``expected_counts`` for one word of any length; two numbers a character are held."""
    chars = _chars(word)
    n = len(chars)
    ahead = np.zeros(n + 1)
    for at, value in enumerate(chained(pieces.by_end(chars), chance, pieces.longest), 1):
        ahead[at] = value[0]
    behind = np.full(n + pieces.longest, -np.inf)
    behind[n] = 0.0
    back = chained((found[::-1] for _, found in pieces.by_start(chars)), chance, pieces.longest)
    for at, value in enumerate(back, 1):
        behind[n - at] = value[0]
    counts = np.zeros(pieces.count + 1)
    log_chance = np.log(np.maximum(chance[:, 0], 1e-300))
    log_chance[-1] = -np.inf
    for low, found in pieces.by_start(chars):
        places = np.arange(low, low + len(found))[:, None]
        after = behind[places + np.arange(1, pieces.longest + 1)]
        shares = np.exp(ahead[places] + log_chance[found] + after - ahead[n]) * weight
        np.add.at(counts, found, shares)
    return counts[:-1]


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _marked(word: bytes) -> str:
    """A word in lower case behind the word mark."""
    return _START + word.decode().lower()


def _by_length(words: list[tuple[str, int]]) -> Iterator[tuple[list[str], list[int]]]:
    """Words of one length together, a long word alone, each with its number."""
    groups: dict[int, list[tuple[str, int]]] = {}
    for word in words:
        if len(word[0]) > LONG_WORD:
            yield [word[0]], [word[1]]
        else:
            groups.setdefault(len(word[0]), []).append(word)
    for group in groups.values():
        for at in range(0, len(group), BATCH_WORDS):
            part = group[at : at + BATCH_WORDS]
            yield [w for w, _ in part], [k for _, k in part]


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages in order, and a row of log-probabilities for each."""

    path: str
    languages: tuple[str, ...]
    log_chance: np.ndarray


def count_pieces(labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): expected counts over all rows with a language.

    Each task sums its rows first and sends one row per language and piece it met.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        chance = np.append(pieces.prior, 0.0)[:, None]
        sums: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def settle(lang: str) -> None:
            counted = words.pop(lang)
            mine = sums.setdefault(lang, np.zeros(pieces.count))
            for group, weights in _by_length([(_marked(w), n) for w, n in counted.items()]):
                if len(group[0]) > LONG_WORD:
                    mine += long_counts(pieces, group[0], weights[0], chance)
                else:
                    mine += expected_counts(pieces, group, np.array(weights, dtype=float), chance)

        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                words.setdefault(lang, Counter()).update(_words(text))
            if sum(map(len, words.values())) > KNOWN_WORDS:
                for lang in list(words):
                    settle(lang)
        for lang in list(words):
            settle(lang)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts > 1e-9)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "piece", "n"]
            )

    counted = rows.mapInArrow(run, "lang string, piece long, n double")
    return counted.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit_language(
    labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", most_languages: int = 500
) -> LanguageModel:
    """Piece probabilities of every language in ``labelled``.

    What reaches the driver is one number per language and vocabulary piece. Labels beyond
    ``most_languages`` different values are refused: they are not languages. An empty table
    gives a model without languages.
    """
    counts = count_pieces(labelled, path, text_col, lang_col)
    known = labelled.select(F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL").distinct()
    languages = tuple(sorted(r["lang"] for r in known.limit(most_languages + 1).collect()))
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    size = pieces_of(path).count
    table = np.full((len(languages), size), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    for row in counts.toPandas().itertuples():
        table[place[row.lang], row.piece] += round(row.n, 6)
    log_chance = np.log(table / table.sum(axis=1, keepdims=True)) if languages else table
    return LanguageModel(path, languages, log_chance)


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.pieces = pieces_of(model.path)
        self.chance = np.vstack([np.exp(model.log_chance.T), np.zeros(len(model.languages))])
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def learn(self, words: list[bytes]) -> None:
        first = len(self.known)
        self.known.update((word, first + k) for k, word in enumerate(words))
        scores = np.zeros((len(words), self.chance.shape[1]))
        for group, at in _by_length([(_marked(word), k) for k, word in enumerate(words)]):
            if len(group[0]) > LONG_WORD:
                scores[at[0]] = long_forward(self.pieces, group[0], self.chance)
            else:
                scores[at] = forward(*self.pieces.lattice(group), self.chance)[0]
        self.scores = np.vstack([self.scores, scores])

    def texts(self, texts: list[bytes | None]) -> np.ndarray:
        """Log-likelihood of each text in each language."""
        split = [_words(t) for t in texts]
        new = dict.fromkeys(w for words in split for w in words if w not in self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            self.scores = self.scores[:0]
            new = dict.fromkeys(w for words in split for w in words)
        self.learn(list(new))
        out = np.zeros((len(texts), self.scores.shape[1]))
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                out[i] = self.scores[at].sum(axis=0)
        return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    ``score`` is the language's share of the softened likelihoods. A text that is null or
    has no letter is ``und`` with score 0, as is every text if no language was learned.
    Repeated rows are answered each; texts and words of any length are scored whole.
    Ties go to the language that comes first by name.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model) if names else None
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            found, scores = ["und"] * len(texts), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if names else []
            if lettered:
                likely = scorer.texts([texts[i].encode() for i in lettered]) * SHARPNESS
                best = likely.argmax(axis=1)
                shares = np.exp(likely - likely.max(axis=1, keepdims=True))
                shares /= shares.sum(axis=1, keepdims=True)
                for i, k, row in zip(lettered, best.tolist(), shares, strict=True):
                    found[i], scores[i] = names[k], row[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
