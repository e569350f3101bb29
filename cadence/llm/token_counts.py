"""Token counts: lengths of library encodings, without keeping the ids.

Arrow batches are cut into slices of about equal bytes. Texts are split at
boundaries that no piece of the vocabulary crosses: a piece holds the space
sign only in front, so a word with the space before it is encoded alike alone
and inside its text. Distinct words of a slice go to the library in one batch,
and only lengths come back; a worker remembers the lengths of a bounded number
of words. A text in which a space run, an edge space or the space sign itself
could move a boundary is split at the starts of space runs instead, in chunks
of bounded size, each of which is encoded whole.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadence.llm.common import WordTable, as_texts, coded_words, ship_package, text_slices, worker_table

SPACE_SIGN = "▁"
#: Characters of a long text that are encoded at once.
CHUNK = 1 << 16
#: The tokenizer file that the queries count with.
MODEL = "piece_bpe_32k.model"
_WORD_END = re.compile(r"[^ ] ")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def processor(path: str):
    """The library's tokenizer, one per worker process and file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def is_word_safe(path: str) -> bool:
    """Whether words may be encoded alone: the space sign stands only in front
    of pieces, no piece but control, unknown and byte pieces holds a space or
    line end, and the model neither rewrites texts nor lacks the space in front."""
    sp = processor(path)
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    sample = "ﬁ Ａ  é\n\tx"
    plain = sp.normalize(sample) == SPACE_SIGN + sample.replace(" ", SPACE_SIGN)
    return plain and all(SPACE_SIGN not in p.lstrip(SPACE_SIGN) and not re.search(r"[ \n]", p) for p in pieces)


def chunks_of(text: str, most: int = CHUNK) -> list[str]:
    """``text`` cut in front of space runs (a run and the word after it stay
    together) into parts of about ``most`` characters; a run of non-space
    characters is never cut."""
    out, start, end = [], 0, len(text.rstrip(" "))
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at > 0 and text[at - 1] == " ":
            at -= 1  # back to the start of the run
        if at <= start:  # a run of spaces fills the chunk: go on after it
            at = _WORD_END.search(text, start + most)
            at = at.start() + 1 if at else len(text)
        if at < 0 or at >= end:
            break  # spaces at the end stay with the last word
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


def count_tokens_in(texts: list[str], path: str) -> list[int]:
    """The library's token counts of whole texts, long ones chunk by chunk.

    Chunks after the first begin with a space; the library puts a space in front
    of every text it gets, so that first space is left out."""
    sp, safe = processor(path), is_word_safe(path)
    parts, owner = [], []
    for k, t in enumerate(texts):
        for j, part in enumerate(chunks_of(t) if safe and SPACE_SIGN not in t else [t]):
            parts.append(part[1:] if j else part)
            owner.append(k)
    lengths = [len(x) for x in sp.encode(parts, num_threads=1)] if parts else []
    return np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64).tolist()


def _lengths(path: str) -> WordTable:
    sp = processor(path)
    return worker_table(("lengths", path), lambda: WordTable(lambda words: [len(x) for x in sp.encode(words, num_threads=1)]))


#: Texts in which a space run, a space at an edge, or the space sign itself
#: could move a word's boundary; empty texts.
IRREGULAR = r"  |^ | $|\x{2581}|^$"


def irregular(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False), dtype=bool)


def slice_counts(texts: pa.Array, path: str) -> np.ndarray:
    """Token counts of a slice of texts (large strings, no nulls)."""
    if not is_word_safe(path):
        return np.array(count_tokens_in(texts.to_pylist(), path), dtype=np.int64)
    odd = irregular(texts)
    out = np.zeros(len(texts), dtype=np.int64)
    offsets, codes, words = coded_words(texts.filter(pa.array(~odd)))
    lengths = np.array(_lengths(path).values(words), dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(lengths[codes]))) if len(codes) else np.zeros(1, dtype=np.int64)
    out[~odd] = total[offsets[1:]] - total[offsets[:-1]]
    if odd.any():
        out[odd] = count_tokens_in(texts.filter(pa.array(odd)).to_pylist(), path)
    return out


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a whole text as the library gives them; null counts as empty."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        parts = [slice_counts(part, path) for part in text_slices(as_texts(texts))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64))

    return of(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens. Very long texts are encoded
    in chunks; repeated rows and null ids are counted like any other; an empty
    table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), path or model_path()).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
