"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

An automaton over all pieces reads a text once; at each position its output
links name the pieces that end there, and each relaxes the best score of the
position (single-pass Viterbi). The result is the segmentation with the
greatest sum of piece scores, the unigram rule; of equal sums the one whose
last piece is longest wins, from the end backwards. A character without a
piece costs the lowest score less ten and is written as its UTF-8 bytes.

With a model trained as BPE this is *not* the library's own BPE encoding, which
replays merges; it is the best segmentation under the same pieces and scores.

Where no piece holds the space sign but in front, words are coded apart, and
also cut at marks that no piece crosses; a worker remembers a bounded number of
words and cuts. Other models are coded whole texts at a time.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from cadence.llm.common import WordTable, as_texts, coded_words, joined_values, ship_package, text_slices, worker_table
from cadence.llm.token_counts import SPACE_SIGN, irregular, is_word_safe, model_path, processor

UNKNOWN_PENALTY = 10.0
#: Words, and cuts of words, of a generation that a worker remembers.
WORDS_KEPT = 60_000
_RUNS = re.compile(f"{SPACE_SIGN}+[^{SPACE_SIGN}]*|[^{SPACE_SIGN}]+")


class Codec:
    """Encoder and decoder over the pieces of a SentencePiece model file."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], byte_ids: dict[int, int]) -> None:
        import ahocorasick

        self.pieces, self.byte_ids = np.array(pieces, dtype=object), byte_ids
        self.byte_value = np.full(len(pieces), -1, dtype=np.int64)
        for value, k in byte_ids.items():
            self.byte_value[k] = value
        #: pieces as they are written out, ASCII bytes as their characters
        self.written = np.array([chr(v) if 0 <= v < 0x80 else p for p, v in zip(pieces, self.byte_value.tolist(), strict=True)], dtype=object)
        of_pieces = [(p, s, k) for k, (p, s, u) in enumerate(zip(pieces, scores, usable, strict=True)) if u and p]
        self.unknown = min((s for _, s, _ in of_pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s, k in of_pieces:
            self.automaton.add_word(p, (len(p), s, (k,)))
        self.automaton.make_automaton()
        self.no_piece = re.compile("[^" + "".join(re.escape(p) for p, _, _ in of_pieces if len(p) == 1) + "]")

    def encode(self, text: str) -> list[int]:
        """Ids of a normalised string (space signs for spaces)."""
        n = len(text)
        best, back = [0.0] + [-math.inf] * n, [(0, 0.0, ())] * (n + 1)
        if self.no_piece.search(text):
            matches = self._with_unknown(text)
        else:
            matches = self.automaton.iter(text)
        for at, edge in matches:  # by end; of one end the longest piece first
            score = best[at + 1 - edge[0]] + edge[1]
            if score > best[at + 1]:
                best[at + 1] = score
                back[at + 1] = edge
        out: list[int] = []
        while n:
            size, _, ids = back[n]
            out += ids
            n -= size
        out.reverse()
        return out

    def _with_unknown(self, text: str) -> list[tuple]:
        """The automaton's matches, and behind them one of a single character,
        written as its bytes, wherever a character has no piece."""
        found = list(self.automaton.iter(text))
        for m in self.no_piece.finditer(text):
            ids = tuple(self.byte_ids[b] for b in reversed(m[0].encode()))
            found.append((m.start(), (1, self.unknown, ids)))
        found.sort(key=lambda x: x[0])  # stable: the longer pieces stay in front
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces strung together, byte pieces as UTF-8, space
        signs as spaces, without the space put in front."""
        if len(ids) and self.byte_value[ids].max() >= 0x80:
            parts = [bytes([v]) if v >= 0 else p.encode() for p, v in zip(self.pieces[ids].tolist(), self.byte_value[ids].tolist(), strict=True)]
            text = b"".join(parts).decode("utf-8", "replace")
        else:
            text = "".join(self.written[ids].tolist())
        return text.replace(SPACE_SIGN, " ").removeprefix(" ")


@functools.cache
def codec(path: str) -> Codec:
    """The codec of a model file, one per worker process."""
    sp = processor(path)
    every = range(sp.get_piece_size())
    pieces = [sp.id_to_piece(k) for k in every]
    usable = [not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k)) for k in every]
    byte_ids = {int(pieces[k][3:5], 16): k for k in every if sp.is_byte(k)}
    if len(byte_ids) < 256:
        byte_ids = dict.fromkeys(range(256), sp.unk_id())
    return Codec(pieces, [sp.get_score(k) for k in every], usable, byte_ids)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts. Runs of spaces with what follows are coded apart where
    that is safe, else whole texts."""
    sp, c = processor(path), codec(path)
    plain = [sp.normalize(t) for t in texts]
    cut = [_RUNS.findall(t) if is_word_safe(path) else [t] for t in plain]
    return [np.array([k for r in runs for k in c.encode(r)], dtype=np.int32) for runs in cut]


#: Marks at which words are cut further where no piece crosses.
_MARKS = r"\n.,;:!?|#$%&*"
_MARK_RUNS = re.compile(f"{SPACE_SIGN}?(?:[{_MARKS}]+|[^{_MARKS}{SPACE_SIGN}]+|$)")


@functools.cache
def _crossing(path: str) -> re.Pattern:
    """Finds characters that share a piece with marks: words with one are not cut at marks."""
    found = set()
    for p in codec(path).pieces:
        p = p.removeprefix(SPACE_SIGN)
        if re.search(f"[{_MARKS}]", p):
            found |= set(re.sub(f"[{_MARKS}]", "", p))
    return re.compile("[" + re.escape("".join(sorted(found))) + SPACE_SIGN + "]")


def _words(path: str) -> WordTable:
    return worker_table(("pieces", path), lambda: _make_words(path))


def _make_words(path: str) -> WordTable:
    c, crossing = codec(path), _crossing(path)
    runs = WordTable(lambda cut: [array("i", c.encode(x)).tobytes() for x in cut], WORDS_KEPT)

    def work(words: list[str]) -> list[bytes]:
        cut = [[SPACE_SIGN + w] if not w or crossing.search(w) else _MARK_RUNS.findall(SPACE_SIGN + w) for w in words]
        coded = iter(runs.values(list(chain.from_iterable(cut))))
        return [next(coded) if len(x) == 1 else b"".join([next(coded) for _ in x]) for x in cut]

    return WordTable(work, WORDS_KEPT)


def encode_slice(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice of texts strung together, and where each text's ids begin and end."""
    safe = is_word_safe(path)
    odd = irregular(texts) if safe else np.ones(len(texts), dtype=bool)
    offsets, codes, words = coded_words(texts.filter(pa.array(~odd)))
    data, ends = joined_values(codes, offsets, _words(path).values(words) if safe else [], "<i4")
    if not odd.any():
        return np.frombuffer(data, dtype=np.int32), ends // 4
    rare = iter(encode_texts(texts.filter(pa.array(odd)).to_pylist(), path))
    common = (np.frombuffer(data[a:b], dtype=np.int32) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    rows = [next(rare) if x else next(common) for x in odd]
    return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; null stays null."""

    @arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if r is None else c.decode(np.array(r, dtype=np.int64)) for r in rows.to_pylist()], type=pa.string())

    return of(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) per row of ``docs``; round_trip says
    that decoding the ids gave the text back.

    Null and empty texts have no ids and round-trip to the empty text. A text
    that holds the space sign itself decodes with a space there and does not
    round-trip. Very long texts are coded whole; repeated rows and null ids like
    any other; an empty table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    model = path or model_path()
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            at = 0
            # a batch out for each slice: ids of a whole batch in would be large
            for part in text_slices(as_texts(batch.column(1))):
                ids, cuts = encode_slice(part, model)
                texts = part.to_numpy(zero_copy_only=False)
                exact = [c.decode(ids[a:b]) == t for a, b, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                doc_ids = batch.column(0).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(cuts).astype(np.int64)), lists, pa.array(exact, type=pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(code, schema)
