"""Conversation structure audit and repair by Four-Russians block tables.

The rows of a conversation are edited at least cost until their role initials
read ``(s?(ua)+)?``: a row is kept (0), given another role (2) or deleted (3, and
blank and duplicate rows must be), empty user or assistant rows are inserted (2),
and a truncated row that stays costs 1. Among the cheapest lists of edits the one
whose initials D, I, K, R come first in ASCII order is taken.

For the repair a row is one of nine symbols, and what lies behind it is a vector:
the cost from there to the end, for each of the four states of the pattern. Edits
bound the differences within a vector, so there are few vectors up to a
constant, and what ``BLOCK`` symbols do to each of them is precomputed in tables.
Vectors run backward over a conversation, block by block by lookup; edits run
forward, and a block on the way is expanded backward into the vectors of its rows,
so that ties fall by the costs to the very end.

Rows are put in order by a range sort and cut by position into chunks of equal
size, whatever the lengths of conversations. A chunk hands on what it does to every
vector and state at its edges; these maps are composed in groups of bounded size,
group by group of groups, and handed back down. So a conversation of any length
is repaired in pieces. Only its digest is made in one task, row after row as they
stream by, for a hash has no parts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadence.llm.common import as_texts, materialise, ship_package, with_position

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(EMPTY, "s"): SYSTEM, **{(q, "u"): USER for q in (EMPTY, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
#: Where an inserted or re-roled row leads from each state, and its role.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
#: Symbols: 0 must go; else 1 + 2 * (place of the initial in INITIALS) + truncated.
INITIALS = "sua?"
SYMBOLS = 1 + 2 * len(INITIALS)
#: Symbols looked up at once.
BLOCK = 4
#: Rows of a chunk, and maps composed in one group.
CHUNK, FAN = 4096, 1024
#: The vector at the end of a conversation: number 0, and no other has that number.
_LAST = (0, 4, 2, 0)
_TRAILING = ("", "II", "I", "")


def _choices(symbol: int, behind: tuple, q: int) -> dict[str, tuple[int, int]]:
    """(cost to the end, next state) of each edit of a row in state q."""
    out = {"D": (DELETE + behind[q], q)}
    if symbol:
        more = (symbol - 1) % 2 * TRUNCATED
        kept = _AFTER.get((q, INITIALS[(symbol - 1) // 2]))
        if kept is not None:
            out["K"] = (KEEP + more + behind[kept], kept)
        out["R"] = (REROLE + more + behind[_NEXT[q]], _NEXT[q])
    return out


def _before(symbol: int, behind: tuple) -> tuple:
    """The costs before a row, from those behind it."""
    own = [min(c for c, _ in _choices(symbol, behind, q).values()) for q in range(4)]
    user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
    return (min(own[EMPTY], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant)


def _edits(symbol: int, behind: tuple, q: int) -> tuple[str, int]:
    """The initials for one row (inserted rows in front), ties ASCII-least, and the state after it."""
    here, out = _before(symbol, behind), ""
    while True:
        options = {e: x for e, x in _choices(symbol, behind, q).items() if x[0] == here[q]}
        inserting = INSERT + here[_NEXT[q]] == here[q]
        if "D" not in options and inserting:
            out, q = out + "I", _NEXT[q]
            continue
        letter = min(options)
        return out + letter, options[letter][1]


class Tables:
    """vectors, and for symbols and blocks of them: the vector in front (from the
    vector behind) and the state behind (from the vector behind and the state in front)."""

    def __init__(self) -> None:
        self.vectors, number, todo = [_LAST], {}, [0]
        step: dict[tuple[int, int], int] = {}
        while todo:
            v = todo.pop()
            for s in range(SYMBOLS):
                front = _before(s, self.vectors[v])
                front = tuple(x - min(front) for x in front)
                if front not in number:
                    number[front] = len(self.vectors)
                    self.vectors.append(front)
                    todo.append(number[front])
                step[s, v] = number[front]
        count = len(self.vectors)
        self.step = np.array([[step[s, v] for v in range(count)] for s in range(SYMBOLS)], dtype=np.int32)
        self.edits = [[[_edits(s, self.vectors[v], q) for q in range(4)] for v in range(count)] for s in range(SYMBOLS)]
        self.state = np.array([[[self.edits[s][v][q][1] for q in range(4)] for v in range(count)] for s in range(SYMBOLS)], dtype=np.int8)
        codes = np.arange(SYMBOLS**BLOCK)
        digits = [codes // SYMBOLS ** (BLOCK - 1 - k) % SYMBOLS for k in range(BLOCK)]
        behind = [np.tile(np.arange(count), (len(codes), 1))]
        for d in reversed(digits):
            behind.append(self.step[d[:, None], behind[-1]])
        self.block_step = behind[-1]
        state = np.tile(np.arange(4), (len(codes), count, 1))
        for d, v in zip(digits, reversed(behind[:-1]), strict=True):
            state = self.state[d[:, None, None], v[:, :, None], state]
        self.block_state = state
        self.expanded: dict[tuple[int, int, int], tuple[list[str], int]] = {}

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the whole blocks, and the symbols left over at the end."""
        whole = len(symbols) // BLOCK * BLOCK
        powers = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        return symbols[:whole].reshape(-1, BLOCK) @ powers, symbols[whole:]

    def vectors_behind(self, symbols: np.ndarray, behind: np.ndarray) -> tuple[list, list, np.ndarray]:
        """Vectors (numbers) behind each block and each symbol left over, from those
        behind the last row; and those in front of all."""
        codes, rest = self.blocks(symbols)
        at_rest, at_blocks = [], []
        for s in rest[::-1].tolist():
            at_rest.append(behind)
            behind = self.step[s][behind]
        for c in codes[::-1].tolist():
            at_blocks.append(behind)
            behind = self.block_step[c][behind]
        return at_blocks[::-1], at_rest[::-1], behind

    def transfer(self, symbols: np.ndarray) -> bytes:
        """What rows do: for every vector behind them the vector in front, and for
        every state in front the state behind."""
        count = len(self.vectors)
        at_blocks, at_rest, front = self.vectors_behind(symbols, np.arange(count))
        codes, rest = self.blocks(symbols)
        state = np.tile(np.arange(4), (count, 1))
        for c, v in zip(codes.tolist(), at_blocks, strict=True):
            state = self.block_state[c][v[:, None], state]
        for s, v in zip(rest.tolist(), at_rest, strict=True):
            state = self.state[s][v[:, None], state]
        return np.concatenate([front[:, None], state], axis=1).astype("<i2").tobytes()

    def trace(self, symbols: np.ndarray, behind: int, q: int) -> tuple[list[str], int]:
        """The edits of every row, given the vector behind the last and the state in front."""
        at_blocks, at_rest, _ = self.vectors_behind(symbols, np.array([behind]))
        codes, rest = self.blocks(symbols)
        out: list[str] = []
        for c, v in zip(codes.tolist(), at_blocks, strict=True):
            key = (c, int(v[0]), q)
            if key not in self.expanded:
                self.expanded[key] = self._expand(*key)
            edits, q = self.expanded[key]
            out += edits
        for s, v in zip(rest.tolist(), at_rest, strict=True):
            edit, q = self.edits[s][int(v[0])][q]
            out.append(edit)
        return out, q

    def _expand(self, code: int, behind: int, q: int) -> tuple[list[str], int]:
        symbols = [code // SYMBOLS ** (BLOCK - 1 - k) % SYMBOLS for k in range(BLOCK)]
        vectors = [behind]
        for s in symbols[:0:-1]:
            vectors.append(int(self.step[s][vectors[-1]]))
        out = []
        for s, v in zip(symbols, reversed(vectors), strict=True):
            edit, q = self.edits[s][v][q]
            out.append(edit)
        return out, q


@functools.cache
def tables() -> Tables:
    return Tables()


def _maps(transfers: list[bytes]) -> np.ndarray:
    """(map, vector, 5): the vector in front and the states behind."""
    return np.frombuffer(b"".join(transfers), dtype="<i2").reshape(len(transfers), -1, 5).astype(np.int64)


def compose(transfers: list[bytes]) -> bytes:
    """One map for rows that follow one another."""
    maps = _maps(transfers)
    behind = [np.arange(maps.shape[1])]
    for m in maps[::-1]:
        behind.append(m[behind[-1], 0])
    state = np.tile(np.arange(4), (maps.shape[1], 1))
    for m, v in zip(maps, reversed(behind[:-1]), strict=True):
        state = m[v[:, None], 1 + state]
    return np.concatenate([behind[-1][:, None], state], axis=1).astype("<i2").tobytes()


def handed_down(transfers: list[bytes], state: int, behind: int) -> list[tuple[int, int]]:
    """(state in front, vector behind) of each of the maps, given those of all."""
    maps = _maps(transfers)
    vectors = [behind]
    for m in maps[:0:-1]:
        vectors.append(int(m[vectors[-1], 0]))
    out = []
    for m, v in zip(maps, reversed(vectors), strict=True):
        out.append((state, v))
        state = int(m[v, 1 + state])
    return out


def _resolved(pieces: DataFrame, fan: int) -> DataFrame:
    """(conv, k, state, behind) for pieces (conv, k, transfer) of conversations, in the order of k."""
    widest = pieces.groupBy("conv").agg((F.max(F.floor(F.col("k") / fan)) - F.min(F.floor(F.col("k") / fan))).alias("w")).agg(F.max("w")).first()[0]

    @arrow_udf("binary")
    def composed(groups: pa.Array) -> pa.Array:
        return pa.array([compose([p["transfer"] for p in sorted(g, key=lambda p: p["k"])]) for g in groups.to_pylist()], pa.binary())

    @arrow_udf("array<struct<k:long,state:int,behind:int>>")
    def down(groups: pa.Array, state: pa.Array, behind: pa.Array) -> pa.Array:
        out = []
        for g, q, v in zip(groups.to_pylist(), state.to_pylist(), behind.to_pylist(), strict=True):
            g = sorted(g, key=lambda p: p["k"])
            found = handed_down([p["transfer"] for p in g], q, v)
            out.append([{"k": p["k"], "state": a, "behind": b} for p, (a, b) in zip(g, found, strict=True)])
        return pa.array(out, type=pa.list_(pa.struct([("k", pa.int64()), ("state", pa.int32()), ("behind", pa.int32())])))

    # at most `fan` pieces in a group
    groups = pieces.groupBy("conv", F.floor(F.col("k") / fan).alias("g")).agg(F.collect_list(F.struct("k", "transfer")).alias("ps"))
    if not widest:
        known = groups.withColumn("state", F.lit(EMPTY)).withColumn("behind", F.lit(0))
    else:
        groups = materialise(groups)
        above = _resolved(groups.select("conv", F.col("g").alias("k"), composed("ps").alias("transfer")), fan)
        above = above.select(F.col("conv").alias("c"), F.col("k").alias("at"), "state", "behind")
        known = groups.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("g") == F.col("at")))
    return known.select("conv", F.explode(down("ps", "state", "behind")).alias("d")).select("conv", "d.*")


def _pieces(conv: pa.Array) -> list[tuple[int, int]]:
    """(begin, end) of the runs of one conversation among the rows of a chunk."""
    ids = conv.to_pylist()
    cuts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
    return list(zip(cuts, [*cuts[1:], len(ids)], strict=True))


def _per_chunk(work: Callable, returns: str, kind: pa.DataType) -> Callable:
    """An Arrow function of chunks (lists of row structs and what else comes with them)."""

    @arrow_udf(returns)
    def of(rows: pa.Array, *others: pa.Array) -> pa.Array:
        out = []
        for k in range(len(rows)):
            table = pa.RecordBatch.from_struct_array(rows[k].values)
            table = table.sort_by("pos")
            out.append(work(table, *(o[k].as_py() for o in others)))
        return pa.array(out, type=kind)

    return of


_EDGES = pa.list_(pa.struct([("conv", pa.int64()), ("transfer", pa.binary())]))


def _edge_maps(table: pa.RecordBatch) -> list[dict]:
    """The maps of the first and the last piece of a chunk (one, if it has one)."""
    pieces, symbols = _pieces(table["conv"]), np.asarray(table["symbol"]).astype(np.int64)
    edges = pieces[:1] + pieces[1:][-1:]
    return [{"conv": table["conv"][a].as_py(), "transfer": tables().transfer(symbols[a:b])} for a, b in edges]


def _chunk_edits(table: pa.RecordBatch, edges: list[dict] | None) -> list[dict]:
    """pos, edits, state in front of them and whether it is the conversation's last row, of a chunk's rows."""
    symbols, pos = np.asarray(table["symbol"]).astype(np.int64), table["pos"].to_pylist()
    known = {e["conv"]: e for e in edges or []}
    out = []
    pieces = _pieces(table["conv"])
    for k, (a, b) in enumerate(pieces):
        at_edge = known[table["conv"][a].as_py()] if k in (0, len(pieces) - 1) else {"state": EMPTY, "behind": 0}
        q, behind = at_edge["state"], at_edge["behind"]
        edits, end = tables().trace(symbols[a:b], behind, q)
        if behind == 0:
            edits[-1] += _TRAILING[end]
        for p, edit, symbol in zip(pos[a:b], edits, symbols[a:b].tolist(), strict=True):
            out.append({"pos": p, "edits": edit, "state": q})
            for e in edit.replace("D", ""):
                q = _AFTER[q, INITIALS[(symbol - 1) // 2]] if e == "K" else _NEXT[q]
    return out


_BLANK = r"\A[\x20\x09-\x0D]*\z"
_CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` (pos, conv, turn, initial, blank, cut_off, digest) with their first fault and symbol."""
    same = rows.where(~F.col("blank")).groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    # positions are unique: no key of the join is hot
    marked = rows.join(same, "pos", "left")
    duplicate = ~F.col("blank") & F.col("new").isNull()
    truncated = ~F.col("blank") & ~duplicate & F.col("cut_off")
    place = F.coalesce(*[F.when(F.col("initial") == c, F.lit(k)) for k, c in enumerate(INITIALS[:-1])], F.lit(len(INITIALS) - 1))
    symbol = F.when(F.col("blank") | duplicate, F.lit(0)).otherwise(1 + 2 * place + truncated.cast("int"))
    return marked.select("pos", "conv", "turn", "initial", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), symbol.alias("symbol"))


def _ordered(turns: DataFrame, conv_col: str) -> DataFrame:
    """Rows in order: pos, conv, turn, role, text, and what is needed of the text."""
    space = F.lit(" ")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return with_position(rows, ["conv", "turn", "digest"], "pos")


def repair(turns: DataFrame, conv_col: str = "conv_id", chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Two DataFrames. One row per row of ``turns``: conv, pos (order over all
    rows), turn, role, text, blank, duplicate, truncated, illegal (the row's
    initial may not follow that of the row before), edits (initials: rows inserted
    before it, its own edit, and after a last row the rows inserted behind), lines
    (role and text of the rows it becomes). And one row per conversation: conv,
    gaps, blank, duplicate, truncated, illegal, cost.

    Rows go by turn (nulls first), then by a digest of role and text, so that equal
    rows stand together. Null roles and texts count as one space. A row's first
    fault counts: blank, duplicate (role and text as in an earlier row of the
    conversation), truncated. An empty role has no initial and fits nowhere. Rows
    with a null id are a conversation of their own. Texts of any length are judged
    whole and repeated rows are duplicates. An empty table gives no rows; other
    columns are ignored.
    """
    ship_package(turns.sparkSession)
    rows = _ordered(turns, conv_col)
    slim = rows.select("pos", "conv", "turn", F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(_BLANK).alias("blank"), F.col("text").rlike(_CUT_OFF).alias("cut_off"), "digest")
    faults = materialise(_faults(slim))
    previous = faults.select((F.col("pos") + 1).alias("pos"), F.col("conv").alias("conv_before"), F.col("initial").alias("initial_before"))
    chunks = faults.groupBy(F.floor(F.col("pos") / chunk).alias("chunk")).agg(F.collect_list(F.struct("pos", "conv", "symbol")).alias("rows"))  # `chunk` rows each
    edge_maps = _per_chunk(_edge_maps, "array<struct<conv:long,transfer:binary>>", _EDGES)
    pieces = materialise(chunks.select(F.col("chunk").alias("k"), F.explode(edge_maps("rows")).alias("e")).select("e.conv", "k", "e.transfer"))
    edges = _resolved(pieces, fan).groupBy(F.col("k").alias("chunk")).agg(F.collect_list(F.struct("conv", "state", "behind")).alias("edges"))  # two at most
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]))
    traced = _per_chunk(_chunk_edits, "array<struct<pos:long,edits:string,state:int>>", kind)
    edits = materialise(chunks.join(edges, "chunk").select(F.explode(traced("rows", "edges")).alias("e")).select("e.*"))
    full = rows.select("pos", "role", "text").join(faults, "pos").join(edits, "pos").join(previous, "pos", "left")
    pair = F.concat("initial_before", "initial")
    illegal = F.col("initial_before").isNotNull() & F.col("conv_before").eqNullSafe(F.col("conv")) & ~pair.isin("su", "ua", "au")
    stays = F.col("truncated") & ~F.contains("edits", F.lit("D"))
    cost = F.regexp_count("edits", F.lit("D")) * DELETE + F.regexp_count("edits", F.lit("I")) * INSERT + F.regexp_count("edits", F.lit("R")) * REROLE + F.when(stays, TRUNCATED).otherwise(0)
    full = full.select("conv", "pos", "turn", "role", "text", "blank", "duplicate", "truncated", F.coalesce(illegal, F.lit(False)).alias("illegal"), "edits", _lines().alias("lines"), cost.cast("long").alias("cost"))
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    per_conv = full.groupBy("conv").agg(*counts)
    per_turn = faults.groupBy("conv").agg(gaps).select(F.col("conv").alias("c"), "gaps")
    report = per_conv.join(per_turn, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return full.drop("cost"), report


def _lines() -> Column:
    """role and text of the rows that a row becomes, by its edits and the state in front of them."""
    # one letter after the other: the state, and the rows so far
    row = "struct<role:string,text:string>"
    start = F.struct(F.col("state").alias("q"), F.expr(f"cast(array() as array<{row}>)").alias("out"))

    def follow(x: Column, e: Column) -> Column:
        role = F.when(x["q"] == USER, F.lit(_ROLE[USER])).otherwise(F.lit(_ROLE[EMPTY]))
        by_role = F.when(x["q"] == USER, F.lit(ASSISTANT)).otherwise(F.lit(USER))
        kept = F.when((e == "K") & (F.col("initial") == "s"), F.lit(SYSTEM)).otherwise(by_role)
        made = F.when(e == "I", F.struct(role.alias("role"), F.lit("").alias("text"))).when(e == "K", F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
        made = made.otherwise(F.struct(role.alias("role"), F.col("text").alias("text")))
        grown = F.struct(kept.alias("q"), F.concat(x["out"], F.array(made)).alias("out"))
        return F.when(e == "D", x).otherwise(grown)

    letters = F.filter(F.split("edits", ""), lambda e: e != "")
    return F.aggregate(letters, start, follow, lambda x: x["out"])


def conversation_audits(repaired: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of the rows of ``repair``: all edits in order,
    and the digest of the repaired rows as ``role:text``, newline-joined.

    Rows stream by in order; of a conversation only its edits and the state of
    the hash are held."""
    ship_package(repaired.sparkSession)
    lines = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    rows = repaired.select("conv", "pos", "edits", F.size("lines").alias("n"), F.array_join(lines, "\n").alias("line"))
    schema = pa.schema([("conv", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, edits, sha, first = None, False, [], hashlib.sha256(), True
        for batch in batches:
            done = []
            for conv, edit, n, line in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "n")), as_texts(batch.column("line")).to_pylist(), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append({"conv": now, "audit": "".join(edits), "repaired_sha256": sha.hexdigest()})
                    now, begun, edits, sha, first = conv, True, [], hashlib.sha256(), True
                edits.append(edit)
                if n:
                    sha.update((line if first else "\n" + line).encode())
                    first = False
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv": now, "audit": "".join(edits), "repaired_sha256": sha.hexdigest()}], schema=schema)

    return rows.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(digest, "conv long, audit string, repaired_sha256 string")
