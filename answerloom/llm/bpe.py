"""BPE by a pair occurrence index, and back.

The words of a batch that were not met before are laid out as one array of symbols with
links to the next and the previous one. An index holds, for every mergeable pair, all its
positions. The ranks that have positions are applied in ascending order, each to all its
positions at once; the pairs that a merge creates join the lists of their ranks. A word's
ids are kept, so frequent words are merged once.

The vocabulary is a tokenizer file of the ``tokenizers`` library. What precedes the merges
(normalisation, splitting, byte alphabet) follows the file; words outside plain Latin letters
and printable ASCII go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import id_and_text, slices

BATCH_BYTES = 2 << 20
#: Words remembered by one worker; the memory is emptied when it is full.
KNOWN_WORDS = 250_000
_GAP, _DEAD = -1, -2
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Encoder and decoder of one tokenizer file (lower case, word ends, byte alphabet)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.library = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added))) + ")")
        self.alphabet = str.maketrans(dict(enumerate(byte_alphabet())))
        self.inner = {c: vocab[c] for c in byte_alphabet()}
        self.final = {c: vocab[c + end] for c in byte_alphabet()}
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        # A merged symbol can only take part in later ranks; ascending order relies on it.
        born = np.full(max(vocab.values()) + 1, -1, dtype=np.int64)
        born[self.made] = np.arange(len(merges))
        if len(merges) and (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge precedes the merge that makes one of its parts")
        codes = (left << 32) | right
        self.by_code = np.argsort(codes)
        self.codes = codes[self.by_code]
        self.tokens = np.empty(max([*vocab.values(), *self.added.values()]) + 1, dtype=object)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        self.known: dict[bytes, bytes] = {}

    # -- splitting ---------------------------------------------------------------------

    def _parts(self, word: str) -> list[str]:
        """The pieces that merges stay within, in the byte alphabet."""
        if _PLAIN.fullmatch(word):
            return [
                p.encode().decode("latin-1").translate(self.alphabet)
                for p in _PARTS.findall(word.lower())
            ]
        text = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if p]

    def _layout(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words with a gap before each piece and at the end; word ends."""
        inner, final = self.inner, self.final
        symbols: list[int] = []
        ends = []
        for word in words:
            text = word.decode()
            segments = [text] if "<" not in text else self.split_added.split(text)
            for segment in segments:
                if segment in self.added:
                    symbols += (_GAP, self.added[segment])
                elif segment:
                    for piece in self._parts(segment):
                        symbols.append(_GAP)
                        symbols += [inner[c] for c in piece[:-1]]
                        symbols.append(final[piece[-1]])
            ends.append(len(symbols))
        symbols.append(_GAP)
        return np.array(symbols, dtype=np.int64), np.array(ends, dtype=np.int64)

    # -- merging -----------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        codes = (a << 32) | b
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where((self.codes[at] == codes) & (a >= 0) & (b >= 0), self.by_code[at], -1)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Apply all merges in place; merged-away places are marked dead."""
        following = np.arange(1, len(symbols) + 1)
        previous = np.arange(-1, len(symbols) - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Add the pairs starting at these places to the lists of their ranks."""
            ranks = self._ranks(symbols[places], symbols[following[places]])
            mergeable = ranks >= 0
            places, ranks = places[mergeable], ranks[mergeable]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            starts = [0, *cuts.tolist()]
            for rank, group in zip(ranks[starts].tolist(), np.split(places, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(group)

        if len(symbols) > 1 and len(self.codes):
            enter(np.arange(len(symbols) - 1))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[symbols[at] == a]
            at = at[symbols[following[at]] == b]
            if a == b and len(at):  # in a run of one symbol, pairs are taken from the left
                taken, used = [], -1
                for place, after in zip(at.tolist(), following[at].tolist(), strict=True):
                    if place != used:
                        taken.append(place)
                        used = after
                at = np.array(taken, dtype=np.int64)
            if not len(at):
                continue
            second = following[at]
            third = following[second]
            symbols[at] = made
            symbols[second] = _DEAD
            following[at] = third
            previous[third] = at
            enter(np.unique(np.concatenate([previous[at], at])))
        return symbols

    # -- texts -------------------------------------------------------------------------

    def learn(self, words: list[bytes]) -> None:
        """Merge words and remember their ids (as little-endian 32-bit integers)."""
        symbols, ends = self._layout(words)
        symbols = self.merge(symbols)
        kept = symbols >= 0
        before = np.concatenate([[0], np.cumsum(kept)])[ends] * 4
        data = symbols[kept].astype("<i4").tobytes()
        start = 0
        for word, stop in zip(words, before.tolist(), strict=True):
            self.known[word] = data[start:stop]
            start = stop

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers; null is empty."""
        split = [(t or b"").split() for t in texts]
        new: dict[bytes, None] = {}
        for words in split:
            new.update(dict.fromkeys(w for w in words if w not in self.known))
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = dict.fromkeys(w for words in split for w in words)
        self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by blanks: these files name no other decoder."""
        return " ".join(self.tokens[ids])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    """One encoder a worker and file."""
    return PairIndexEncoder(path)


def _id_lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids array<int>) for every row; a null or blank text has no ids.

    ``path`` is a tokenizer file that every worker can open at the same place. Rows are
    encoded where they are read; repeated rows give repeated rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            coded = merges.encode(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _id_lists(coded)], ["doc_id", "ids"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids, decoded) for every row: what the ids of a text decode to.

    The same as decoding the result of ``encode_documents``, in one worker instead of two.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            coded = merges.encode(batch.column("text").cast(pa.binary()).to_pylist())
            lists = _id_lists(coded)
            texts = [merges.decode(np.frombuffer(c, dtype="<i4")) for c in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(texts, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded) for every row of ids; null ids decode to the empty text."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column("ids")
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), [0]
                for n in pc.list_value_length(lists).to_pylist():
                    ends.append(ends[-1] + (n or 0))
                texts = [merges.decode(flat[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(texts, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
