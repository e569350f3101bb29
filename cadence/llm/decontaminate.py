"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units after numbers and names turn into typed
placeholders, other words into their lower-case letters without the marks
around them. Windows of five template words of documents and of benchmark items
are hash-joined. The item says where its names are: capitalised words are, and
at the beginning of a sentence they are read both ways. In a document any word
may stand for a name, whatever its case and place. Each window is also hashed
word for word without case. Along an alignment of a document with an item, every value of
the item (a number, a name) must stand for one value of the document; windows
that disagree with the majority do not count. A document holds an item if
enough of the item's windows count (80 %), or enough of them in a row (13 words).

The documents' windows do not leave the executors unless a bitmap of fixed size
(2 MB), filled from the items' windows, has two bits of their hash: false hits only cost a
row in the join, and a large benchmark only fills the bitmap. A second one (128 kB)
has the items' words: a word that no item has can only stand for a name, which
leaves few readings of most windows to be hashed.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadence.llm.common import WordTable, as_texts, materialise, ship_package, text_slices, worker_table

WINDOW = 5
#: Share of an item's windows, or words in a row, that make a document hold it.
COVERAGE, RUN_WORDS = 0.8, 13
#: A window with fewer plain words keeps its words, and so only matches word for word.
LEAST_PLAIN = 2
BITMAP_BITS = 1 << 24
#: Bits of the bitmap of the items' words.
WORD_BITS = 1 << 20
_SECOND_BIT = 40  # the second bit is what is left of a hash from here on

#: Words for numbers and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve dozen twenty thirty forty fifty hundred thousand million billion".split())
UNITS = frozenset(
    "% percent mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l liter liters litre litres"
    " gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh hz volt volts watt watts"
    " dollar dollars euro euros cent cents usd eur".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_QUANTITY = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([^\W\d_]+|%)")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = np.dtype([("n", "u1"), ("kind", "u1"), ("cap", "u1"), ("stop", "u1"), ("pad", "u4"), ("value", "<u8"), ("unit", "<u8")])
_PLAIN, _NUM, _UNIT, _NAME = range(4)
_MASK = (1 << 64) - 1
_KIND_MARKS = np.array([0, 0x1D8E4E27C47D124F, 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D], dtype=np.uint64)


_PACK = struct.Struct("<BBBBIQQ").pack
_MARKS = ".,;:!?()[]{}#$%&*|\"'-_/<>+="
_SPECIAL = NUMBER_WORDS | UNITS


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


def describe_word(word: str) -> bytes:
    """What a word is on its own, packed as ``_WORD``: how many template words it
    makes (a quantity such as 5kg makes two), its kind, whether it is capitalised,
    whether it ends a sentence, and the hash of its value."""
    core = word.strip(_MARKS)
    if core.isalpha():
        low = core.lower()
        if low not in _SPECIAL and word[-1] not in "\"')]":
            return _PACK(1, _PLAIN, core[0].isupper() and not core.isupper(), word[-1] in ".!?:", 0, _hash(low), 0)
    core = _EDGES.sub("", word)
    stop = word.rstrip("\"'”’)]»").endswith((".", "!", "?", ":"))
    if _NUMBER.fullmatch(word.rstrip(".,;:!?")) or core.lower() in NUMBER_WORDS:
        return _PACK(1, _NUM, 0, stop, 0, _hash(core.lower()), 0)
    if word.strip(".,;:!?()\"'") == "%":
        return _PACK(1, _UNIT, 0, stop, 0, _hash("%"), 0)
    if not core:
        return _PACK(0, _PLAIN, 0, stop, 0, 0, 0)
    q = _QUANTITY.fullmatch(word.strip(".,;:!?()\"'"))
    if q and q[2].lower() in UNITS:
        return _PACK(2, _NUM, 0, stop, 0, _hash(q[1]), _hash(q[2].lower()))
    low = core.lower()
    kind = _UNIT if low in UNITS else _PLAIN
    capital = core[0].isupper() and not core.isupper()
    return _PACK(1, kind, capital, stop, 0, _hash(low), 0)


def _factors() -> np.ndarray:
    f, out = 0x9E3779B97F4A7C15, []
    for _ in range(WINDOW):
        out.append(f)
        f = f * 0xD6E8FEB86659FD93 & _MASK
    return np.array(out, dtype=np.uint64)


def _allowed() -> np.ndarray:
    """[mask, plain places * 32 + missing places]: whether a window of a document may
    have that reading. Places read as names are plain, LEAST_PLAIN other plain
    words are left, and every plain word that no item has is read as a name."""
    mask, plain, missing = np.ogrid[: 1 << WINDOW, : 1 << WINDOW, : 1 << WINDOW]
    left = np.bitwise_count(plain) - np.bitwise_count(mask)
    return ((mask & ~plain == 0) & (left.astype(np.int8) >= LEAST_PLAIN) & (missing & ~mask == 0)).reshape(1 << WINDOW, -1)


_ALLOWED = _allowed()


def template_windows(texts: pa.Array, table: WordTable, wanted: tuple[np.ndarray, np.ndarray] | None, masks: Sequence[int] = range(1 << WINDOW)) -> list[list[dict]]:
    """For each text of a slice, its windows: h, at (place of the first template
    word), mask (bits of the words read as names; -1 for the window word for
    word), sure (every such word is capitalised inside a sentence, or the window
    is word for word) and slots (values of its placeholders, in order).

    Without ``wanted`` the texts are items: all readings of their names. With
    it, bitmaps of the items' windows and words as bytes, they are documents: any
    plain words may be names, at the places of one of ``masks``; only windows that
    the bitmap has, and no slots for those word for word, as they are the item's."""
    words = pc.utf8_split_whitespace(texts)
    offsets = np.asarray(words.offsets)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    coded = words.flatten().dictionary_encode()
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(coded):
        return out
    known = np.frombuffer(b"".join(table.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())), dtype=_WORD)
    seq = known[np.asarray(coded.indices)]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    # words without letters or digits make no template word; quantities make two
    starts_text = np.zeros(len(seq), dtype=bool)
    starts_text[offsets[:-1][np.diff(offsets) > 0]] = True
    after_stop = starts_text | np.concatenate(([True], seq["stop"][:-1] > 0))
    n = seq["n"].astype(np.int64)
    at = np.repeat(np.arange(len(seq)), n)
    second = np.concatenate(([False], at[1:] == at[:-1])) if len(at) else np.zeros(0, dtype=bool)
    kind, value, row = np.where(second, _UNIT, seq["kind"][at]), np.where(second, seq["unit"][at], seq["value"][at]), row[at]
    if len(kind) < WINDOW:
        return out
    follows = np.concatenate(([False], (kind[:-1] == _NUM) & (row[1:] == row[:-1])))
    kind = np.where((kind == _UNIT) & ~follows, _PLAIN, kind)  # a unit only after a number
    plain = kind == _PLAIN
    capital = (seq["cap"][at] > 0) & plain
    inside = capital & ~after_stop[at]
    total = len(kind) - WINDOW + 1
    factors = _factors()
    mark = np.where(plain, value, _KIND_MARKS[kind])
    mark ^= mark >> np.uint64(29)
    value_mark = value ^ (value >> np.uint64(31))
    name_mark = _KIND_MARKS[_NAME] ^ (_KIND_MARKS[_NAME] >> np.uint64(29))

    def places(x: np.ndarray) -> np.ndarray:
        return sum(x[k : k + total].astype(np.uint8) << k for k in range(WINDOW))

    plains, capitals, insides = places(plain), places(capital), places(inside)
    whole = row[:total] == row[WINDOW - 1 :]
    first = np.searchsorted(row, np.arange(len(texts)))

    def add(h: np.ndarray, mask: int, some: np.ndarray) -> None:
        """The windows of one reading: their hashes and places."""
        h ^= h >> np.uint64(32)
        if wanted is not None:  # the second bit only where the first one is set
            for shift in (0, _SECOND_BIT):
                bit = (h >> np.uint64(shift)) & np.uint64(BITMAP_BITS - 1)
                hit = np.flatnonzero((wanted[0][bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                h, some = h[hit], some[hit]
        for x, k in zip(h.view(np.int64).tolist(), some.tolist(), strict=True):
            of = (int(plains[k]) ^ 31) | (int(insides[k]) if mask < 0 else mask)
            slots = [] if mask < 0 and wanted is not None else [int(v) for j, v in enumerate(value[k : k + WINDOW].view(np.int64)) if of >> j & 1]
            sure = mask < 0 or not mask & ~int(insides[k])
            out[row[k]].append({"h": x, "at": int(k - first[row[k]]), "mask": mask, "sure": sure, "slots": slots})

    if wanted is None:
        missing = np.zeros(total, dtype=np.uint8)
    else:
        bit = value & np.uint64(WORD_BITS - 1)
        missing = places(plain & ((wanted[1][bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 0))
    some = np.flatnonzero(whole & (missing == 0))
    add(sum(value_mark[some + k] * factors[k] for k in range(WINDOW)) ^ np.uint64(0xA0761D6478BD642F), -1, some)
    unread = sum(mark[k : k + total] * factors[k] for k in range(WINDOW))
    shape = np.where(whole, plains.astype(np.int16) << WINDOW | missing, 0)  # no reading is allowed without plain words
    for mask in masks:
        fits = _ALLOWED[mask][shape]
        if wanted is None:
            fits &= ((capitals & mask) == mask) & ((insides & mask) == insides)
        some = np.flatnonzero(fits)
        if len(some):
            add(sum(((name_mark - mark[some + k]) * factors[k] for k in range(WINDOW) if mask >> k & 1), unread[some]), mask, some)
    return out


_WINDOWS = "array<struct<h:long,at:int,mask:int,sure:boolean,slots:array<long>>>"


def windows(text: Column, wanted: tuple[bytes, bytes] | None = None, masks: Sequence[int] = range(1 << WINDOW)) -> Column:
    """Template windows of a whole text (see ``template_windows``); null counts as empty."""

    @arrow_udf(_WINDOWS)
    def of(texts: pa.Array) -> pa.Array:
        table = _described()
        bits = tuple(np.frombuffer(w, dtype=np.uint8) for w in wanted) if wanted is not None else None
        rows = [w for part in text_slices(as_texts(texts)) for w in template_windows(part, table, bits, masks)]
        kind = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("mask", pa.int32()), ("sure", pa.bool_()), ("slots", pa.list_(pa.int64()))])
        return pa.array(rows, type=pa.list_(kind))

    return of(text)


def _described() -> WordTable:
    """The worker's table of described words."""
    return worker_table(("described",), lambda: WordTable(lambda words: [describe_word(w) for w in words]))


def judge_alignment(windows_of: list[dict]) -> dict:
    """Of the matched windows of one alignment (place in the item, slot pairs):
    the places that count, the most of them in a row, and whether a value was
    changed. A window that is not sure (a word that does not look like a name
    stands for one) counts beside one that counts."""
    cast: dict[int, Counter] = {}  # readings of one place vote once
    for w in windows_of:
        cast[w["place"]] = cast.get(w["place"], Counter()) | Counter((p["item"], p["doc"]) for p in w["pairs"])
    votes: dict[int, Counter] = {}
    for of_place in cast.values():
        for (item, doc), n in of_place.items():
            votes.setdefault(item, Counter())[doc] += n
    chosen = {b: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for b, c in votes.items()}
    agreeing = [w for w in windows_of if all(chosen[p["item"]] == p["doc"] for p in w["pairs"])]
    places = {w["place"] for w in agreeing}
    good = sorted({w["place"] for w in agreeing if w.get("sure", True) or {w["place"] - 1, w["place"] + 1} & places})
    run = best = 0
    for k, place in enumerate(good):
        run = run + 1 if k and place == good[k - 1] + 1 else 1
        best = max(best, run)
    return {"places": good, "run": best, "changed": any(b != d for b, d in chosen.items())}


def _judged(found: Column) -> Column:
    @arrow_udf("struct<places:array<int>,run:int,changed:boolean>")
    def of(groups: pa.Array) -> pa.Array:
        kind = pa.struct([("places", pa.list_(pa.int32())), ("run", pa.int32()), ("changed", pa.bool_())])
        return pa.array([judge_alignment(g) for g in groups.to_pylist()], type=kind)

    return of(found)


def item_words(text: Column) -> Column:
    """Hashes of the distinct template words of a text, whatever their kind; null counts as empty."""

    @arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for words in pc.utf8_split_whitespace(as_texts(texts)).to_pylist():
            known = np.frombuffer(b"".join(_described().values(list(dict.fromkeys(words)))), dtype=_WORD)
            rows.append(np.unique(np.concatenate((known["value"], known["unit"]))).view(np.int64))
        return pa.array(rows, type=pa.list_(pa.int64()))

    return of(text)


def _bitmap(bits: DataFrame, size: int) -> bytes:
    """A bitmap with the bits ``b`` (0 to size - 1) set: at most size / 64 rows are gathered."""
    cells = bits.select(F.shiftright("b", 6).alias("cell"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 64, dtype=np.int64)
    got = cells.toArrow()
    out[np.asarray(got["cell"])] = np.asarray(got["bits"])
    return out.astype("<i8").tobytes()


def _wanted(benchmark: DataFrame, item_windows: DataFrame) -> tuple[bytes, bytes]:
    """Two bits for every window hash of the items, and one for every word."""
    both = F.array(F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1)), F.shiftrightunsigned("h", _SECOND_BIT))
    words = benchmark.select(F.explode(item_words(F.col("text"))).alias("w")).select(F.col("w").bitwiseAND(F.lit(WORD_BITS - 1)).alias("b"))
    return _bitmap(item_windows.select(F.explode(both).alias("b")), BITMAP_BITS), _bitmap(words, WORD_BITS)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_windows, coverage, longest_run,
    reparameterised): one row per document and benchmark item it holds.

    Items of equal text count as one, under their smallest id. Null and empty
    texts, and texts of fewer than five template words, have no windows: such
    documents are clean and such items are never found. Rows are told apart by
    doc_id and text, so repeated rows give one result and rows of one id with
    different texts (null ids too) are judged apart. Words in capitals only, and
    those of an item that is in lower case, are no names of the item: they are
    found as they are, in any case. An empty table on either side gives no rows;
    other columns are ignored.
    """
    ship_package(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = materialise(items.select("item_id", F.explode(windows(F.col("text"))).alias("w")).select("item_id", "w.h", F.col("w.at").alias("place"), "w.mask", F.col("w.slots").alias("item_slots")))
    sizes = items.groupBy("item_id").agg(F.countDistinct("place").alias("n_windows"))
    masks = sorted(r["mask"] for r in items.where("mask >= 0").select("mask").distinct().collect())  # at most 2^WINDOW
    in_docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(windows(F.col("text"), _wanted(benchmark, items), masks)).alias("w"))
    in_docs = in_docs.select("doc_id", "text_hash", "w.h", "w.at", F.col("w.mask").alias("doc_mask"), "w.sure", F.col("w.slots").alias("doc_slots"))
    met = in_docs.join(items, "h").where(F.col("doc_mask") == F.col("mask"))
    met = met.withColumn("doc_slots", F.when(F.col("mask") < 0, F.col("item_slots")).otherwise(F.col("doc_slots"))).where(F.size("doc_slots") == F.size("item_slots"))
    pairs = F.transform(F.arrays_zip(F.col("item_slots").alias("item"), F.col("doc_slots").alias("doc")), lambda p: F.struct(p["item"].alias("item"), p["doc"].alias("doc")))
    # along one alignment a place of the item comes up once a reading, so an item's length bounds the set
    key = ["doc_id", "text_hash", "item_id"]
    aligned = met.select(*key, (F.col("at") - F.col("place")).alias("shift"), F.struct("place", "sure", pairs.alias("pairs")).alias("w"))
    judged = aligned.groupBy(*key, "shift").agg(F.collect_set("w").alias("ws")).select(*key, _judged(F.col("ws")).alias("j"))
    by_item = judged.select(*key, F.explode("j.places").alias("place"), "j.run", "j.changed").groupBy(*key).agg(
        F.countDistinct("place").alias("n_matched"), F.max("run").alias("longest_run"), F.max("changed").alias("reparameterised")
    )
    share = F.col("n_matched") / F.col("n_windows")
    held = by_item.join(sizes, "item_id").where((share >= coverage) | (F.col("longest_run") >= run_words - WINDOW + 1))
    return held.select(*key, "n_matched", "n_windows", share.alias("coverage"), "longest_run", "reparameterised")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    bad = find_contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")
