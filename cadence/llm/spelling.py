"""Spelling variants: words one edit apart, found over variable-length grams.

The gram dictionary holds the frequent grams of the vocabulary. A word, put
between two marks, is cut into variable grams: from each place a gram grows from
``Q_MIN`` characters on while it is frequent and shorter than ``Q_MAX``; grams
inside an earlier one are left out. A gram from p to e depends on the characters
e - Q_MAX + 1 to p + Q_MAX - 1 only, so an edit elsewhere leaves it in the word's
decomposition. The most grams that one edit can affect, subtracted from all, is
the word's bound: so many of its grams every near word has.

Grams that an edit leaves alone stand left or right of it, so of two near words
the first grams and the last grams agree, as many together as the larger of their
bounds. With the bound cut into ``SPLITS`` + 1 equal shares, some number of shares
agrees at the beginning and the others, but for one, at the end. For each such
split a word is listed under its first and last grams, all that lies before and
after them included, and the length of the shorter word. It owns the lists of its
own bound and visits those of larger bounds, as far as a near word can have one;
a list needs an owner. Words of a list are then compared in full. Nothing is
decided by lists alone.

Lists over ``LIST_MOST`` words are never gathered: their words, and words whose
bound is 0, meet instead under their deletion variants, whose groups have a
proven bound (a character put into one variant).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadence.llm.common import as_texts, materialise, ship_package
from cadence.session import shared_dir

#: Maximal runs of these letters are the words of a text.
LETTERS = "[A-Za-zÀ-ÿ]+"
Q_MIN, Q_MAX = 2, 3
#: A gram is frequent if it is more than one of so many gram places of the
#: vocabulary; so at most this many grams of a length are frequent.
DICTIONARY_MOST = 20_000
#: Lists of a word and bound, less one.
SPLITS = 3
#: Longer lists are not gathered.
LIST_MOST = 8192
#: Cells of the arrays that compare a list with some of its words at once.
COMPARE_CELLS = 1 << 22
#: Words of one Arrow batch handed on at once.
_ROWS = 4096
_BEGIN, _END = "\x02", "\x03"


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(doc, run): every maximal run of letters of the whole texts, A-Z lower-cased,
    of ``least`` or more code points. Null and empty texts have none."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    return runs.where(F.length("run") >= least)


def count_words(runs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the distinct values of ``run`` that are long and frequent enough."""
    return runs.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def cut_grams(marked: str, frequent: frozenset[str] | set[str]) -> list[tuple[int, int]]:
    """(first, last) places of the variable grams of a word between its marks."""
    out, covered, size = [], -1, len(marked)
    for p in range(size - Q_MIN + 1):
        e = p + Q_MIN
        while e < size and e - p < Q_MAX and marked[p:e] in frequent:
            e += 1
        if e - 1 > covered:
            covered = e - 1
            out.append((p, covered))
    return out


def least_common(grams: list[tuple[int, int]], size: int) -> int:
    """How many of a word's grams every word one edit away has, at least: all but
    the most that depend on one place. ``size`` counts the marks."""
    change = [0] * (size + 1)
    for p, e in grams:
        change[max(0, e - Q_MAX + 1)] += 1
        change[min(size - 1, p + Q_MAX - 1) + 1] -= 1
    most = here = 0
    for c in change:
        here += c
        most = max(most, here)
    return len(grams) - most


def bound_of(word: str, frequent: frozenset[str] | set[str]) -> int:
    marked = _BEGIN + word + _END
    return least_common(cut_grams(marked, frequent), len(marked))


def list_keys(word: str, frequent: frozenset[str] | set[str], highest: dict[int, int]) -> tuple[int, list[tuple[int, bool]]]:
    """The word's bound, and its lists: (key, whether the word owns it). ``highest``
    has the largest bound of the words of each length.

    An edit affects 2 * Q_MAX - 2 grams at most (they lie less than Q_MAX places
    from it and end apart), so the bounds of near words differ by no more: lists
    of larger bounds need no visit. A word without a bound (0 or less) owns none."""
    marked = _BEGIN + word + _END
    grams = cut_grams(marked, frequent)
    bound, keys = least_common(grams, len(marked)), {}
    for shorter in (len(word) - 1, len(word)):
        most = min(bound + 2 * Q_MAX - 2, max(highest.get(shorter, 0), highest.get(shorter + 1, 0)))
        for of in range(max(bound, 1), most + 1):
            for k in range(SPLITS + 1):
                first, last = -(-k * of // (SPLITS + 1)), -(-(SPLITS - k) * of // (SPLITS + 1))
                if first + last <= len(grams):
                    head = marked[: grams[first - 1][1] + 1] if first else ""
                    tail = marked[grams[-last][0] :] if last else ""
                    key = _key(f"{shorter},{first},{last},{len(head)},{head}{tail}")
                    keys[key] = keys.get(key, False) or of == bound
    return bound, list(keys.items())


def _key(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode())
    return h - (1 << 64) if h >> 63 else h


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from a to b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:  # characters in common at the beginning
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def near_pairs(words: list[str], own: list[bool]) -> list[tuple[int, int]]:
    """Places (i, j), i < j, of the words of a list that are one edit apart, one of
    them at least an owner."""
    count, width = len(words), max(map(len, words))
    if count * width > COMPARE_CELLS or count < 12:
        return [(i, j) for i in range(count) for j in range(i + 1, count) if (own[i] or own[j]) and one_edit(words[i], words[j])]
    size = np.fromiter(map(len, words), dtype=np.int64, count=count)
    left = np.array([w.ljust(width, "\0") for w in words]).view(np.uint32).reshape(count, width)
    right = np.array([w.rjust(width, "\0") for w in words]).view(np.uint32).reshape(count, width)
    flag, out = np.array(own), []
    step = max(1, COMPARE_CELLS // (count * width))
    for at in range(0, count, step):
        rows = slice(at, at + step)
        ahead = np.minimum.accumulate(left[rows, None] == left[None], axis=2).sum(axis=2)
        behind = np.minimum.accumulate((right[rows, None] == right[None])[:, :, ::-1], axis=2).sum(axis=2)
        short = np.minimum(size[rows, None], size[None])
        equal = size[rows, None] == size[None]
        same = np.minimum(ahead, short) + np.minimum(behind, short)
        near = np.where(equal, same == short - 1, (abs(size[rows, None] - size[None]) == 1) & (same >= short))
        near &= flag[rows, None] | flag[None]
        i, j = np.nonzero(near)
        later = j > i + at
        out += zip((i[later] + at).tolist(), j[later].tolist(), strict=True)
    return out


def deletion_keys(word: str) -> list[int]:
    """Hashes of the word and of the word without each of its code points: words one
    edit apart share one."""
    codes = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(codes), factor))))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * power[: len(codes)])))
        # characters behind the deleted one move forward by a place: one power less
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        without = sums[:-1] + (sums[-1] - sums[1:]) * inverse
    every = np.unique(np.concatenate((without, sums[-1:])))
    return every.view(np.int64).tolist()


def _rows(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _frequent_grams(words: DataFrame) -> frozenset[str]:
    """The frequent grams shorter than Q_MAX: at most DICTIONARY_MOST of each length come to the driver."""
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for w in as_texts(batch.column(0)).to_pylist():
                marked = _BEGIN + w + _END
                for q in range(Q_MIN, Q_MAX):
                    found.update([marked[i : i + q] for i in range(len(marked) - q + 1)])
            yield _rows([list(found), list(found.values())], schema)

    grams = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    places = words.agg(F.coalesce(F.sum(F.length("word") + 2), F.lit(0))).first()[0]
    return frozenset(r["gram"] for r in grams.where(F.col("n") * DICTIONARY_MOST > places).select("gram").collect())


def _highest_bounds(words: DataFrame, frequent: frozenset[str]) -> dict[int, int]:
    """The largest bound for each length of a word: words of so many different
    lengths have half the square of that number of characters, so few rows come
    to the driver."""
    schema = pa.schema([("length", pa.int64()), ("bound", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most: dict[int, int] = {}
            for w in as_texts(batch.column(0)).to_pylist():
                most[len(w)] = max(most.get(len(w), 0), bound_of(w, frequent))
            yield _rows([list(most), list(most.values())], schema)

    found = words.select("word").mapInArrow(measure, "length long, bound long").groupBy("length").agg(F.max("bound").alias("bound"))
    return {r["length"]: r["bound"] for r in found.collect()}


def _listed(words: DataFrame, frequent: frozenset[str], highest: dict[int, int]) -> DataFrame:
    """(key, own, word, n): the lists of every word, and a null key if its bound is 0."""
    schema = pa.schema([("key", pa.int64()), ("own", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                out: list[list] = [[], [], [], []]
                for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    bound, keys = list_keys(w, frequent, highest)
                    if bound <= 0:
                        keys.append((None, False))
                    for key, own in keys:
                        for column, x in zip(out, (key, own, w, n), strict=True):
                            column.append(x)
                yield _rows(out, schema)

    return words.select("word", "n").mapInArrow(rows, "key long, own boolean, word string, n long")


def _under_deletions(words: DataFrame) -> DataFrame:
    """(key, own, word, n): the words under their deletion variants."""
    schema = pa.schema([("key", pa.int64()), ("own", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, step = deletion_keys(w), 1 + (1 << 20) // (len(w) + 1)
                for at in range(0, len(keys), step):
                    some = keys[at : at + step]
                    yield _rows([some, [True] * len(some), [w] * len(some), [n] * len(some)], schema)

    return words.select("word", "n").mapInArrow(rows, "key long, own boolean, word string, n long")


def _compared(lists: DataFrame) -> DataFrame:
    """(word, other, other_n), both ways round, of lists (column ws) whose size is bounded."""
    one = pa.struct([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])

    @arrow_udf("array<struct<word:string,other:string,other_n:long>>")
    def of(groups: pa.Array) -> pa.Array:
        flat = groups.flatten()
        words, ns, own = (flat.field(k).to_pylist() for k in ("word", "n", "own"))
        ends = np.cumsum(np.asarray(pc.list_value_length(groups)), dtype=np.int64).tolist()
        out, start = [], 0
        for end in ends:
            found = []
            for i, j in near_pairs(words[start:end], own[start:end]):
                a, b = start + i, start + j
                found += ({"word": words[a], "other": words[b], "other_n": ns[b]}, {"word": words[b], "other": words[a], "other_n": ns[a]})
            out.append(found)
            start = end
        return pa.array(out, type=pa.list_(one))

    return lists.select(F.explode(of("ws")).alias("p")).select("p.*")


def near_words(words: DataFrame, list_most: int = LIST_MOST) -> DataFrame:
    """(word, other, other_n): all pairs of ``words`` (word, n; distinct words)
    exactly one edit apart, both ways round, each once."""
    spark = words.sparkSession
    ship_package(spark)
    folder = shared_dir(spark, "spelling")
    frequent = _frequent_grams(words)
    _listed(words, frequent, _highest_bounds(words, frequent)).write.parquet(folder)
    listed = spark.read.parquet(folder)
    sizes = listed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("needed"))
    sizes = sizes.where(F.col("needed") & (F.col("size") > 1)).select("key", "size")
    joined = listed.join(sizes, "key")
    short = joined.where(F.col("size") <= list_most).groupBy("key").agg(F.collect_list(F.struct("word", "n", "own")).alias("ws"))
    rest = joined.where(F.col("size") > list_most).select("word", "n").union(listed.where("key is null").select("word", "n")).distinct()
    # words under one deletion variant: one character put into it, at one of its places
    met = _under_deletions(rest).groupBy("key").agg(F.collect_list(F.struct("word", "n", "own")).alias("ws")).where(F.size("ws") > 1)
    return _compared(short).union(_compared(met)).distinct()


def spelling_variants(words: DataFrame, ratio: int = 2, list_most: int = LIST_MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    ``form`` is the near word (one edit away) of largest n, the smallest in
    code-point order among those, if that n is ``ratio`` times the word's or
    more, else null; ``root`` is where following forms ends; n_near counts near
    words. Words are distinct and n at least 1; a null word is left out. Words of
    any length are compared whole. An empty table gives no rows; other columns are
    ignored.
    """
    words = materialise(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    best = near_words(words, list_most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    good = F.col("other_n") >= F.col("n") * ratio
    found = materialise(found.select("word", F.when(good, F.col("other")).alias("form"), "n", "n_near", F.when(good, F.col("other_n")).alias("form_n")))
    # n doubles at each step of a chain, so chains are short, and every round doubles what a pointer spans
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        far = links.join(links.select(F.col("word").alias("root"), F.col("root").alias("beyond")), "root", "left")
        links = materialise(far.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    ends = links.select("word", "root")
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
