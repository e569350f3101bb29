r"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of a role are merged
into one block by an array aggregation; blocks are concatenated:

    ### role: text </turn>          one turn
    ### role: text<+>text </turn>   merged turns

Control strings and backslashes inside texts and roles are escaped with a
backslash, so a reader can tell the template from the texts, and gets every
turn back as it was. The loss mask is the list of the code-point ranges that
assistant texts take in the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, MERGED, CLOSE = "### ", ": ", "<+>", " </turn>\n"
#: Control string -> what stands for it in a text. The backslash goes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"), ("<+>", "\\m"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LOSS_ROLE = "assistant"
#: Turns of one formatted part; a longer conversation makes several parts.
PART_TURNS = 4096


def escape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, marked in escapes:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column, escapes: tuple = ESCAPES) -> Column:
    """Cut at doubled backslashes, so that what is left of a backslash is an escape's."""

    def plain(piece: Column) -> Column:
        for control, marked in escapes[1:]:
            piece = F.replace(piece, F.lit(marked), F.lit(control))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


_TURNS = "array<struct<role:string,texts:array<string>>>"


def merged_turns(turns: Column) -> Column:
    """Sorted turns (structs with role, text) as blocks: role, texts of adjacent turns of the role."""

    def step(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        fresh = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        longer = F.struct(last["role"].alias("role"), F.array_append(last["texts"], t["text"]).alias("texts"))
        return F.when(last["role"] == t["role"], F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(F.array_append(blocks, fresh)).cast(_TURNS)

    return F.aggregate(turns, F.array().cast(_TURNS), step)


def _block_text(b: Column) -> Column:
    body = F.array_join(F.transform(b["texts"], lambda t: escape(t)), MERGED)
    return F.concat(F.lit(OPEN), escape(b["role"], ROLE_ESCAPES), F.lit(COLON), body, F.lit(CLOSE))


def _loss_ranges(blocks: Column) -> Column:
    """array<struct<start, end>> of the assistant texts in the formatted string."""
    kind = "struct<at:int,out:array<struct<start:int,end:int>>>"
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(kind)

    def text_step(state: Column, t: Column) -> Column:
        end = state["at"] + F.char_length(escape(t))
        out = F.array_append(state["out"], F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct((end + len(MERGED)).alias("at"), out.alias("out")).cast(kind)

    def step(state: Column, b: Column) -> Column:
        head = state["at"] + len(OPEN) + F.char_length(escape(b["role"], ROLE_ESCAPES)) + len(COLON)
        texts = F.aggregate(b["texts"], F.struct(head.alias("at"), state["out"].alias("out")).cast(kind), text_step)
        skipped = F.struct((state["at"] + F.char_length(_block_text(b))).alias("at"), state["out"].alias("out")).cast(kind)
        inside = F.transform(F.array(texts), lambda x: F.struct((x["at"] - len(MERGED) + len(CLOSE)).alias("at"), x["out"].alias("out")).cast(kind))
        return F.when(b["role"] == LOSS_ROLE, F.element_at(inside, 1)).otherwise(skipped)

    return F.aggregate(blocks, init, step, lambda s: s["out"])


def format_whole_conversations(turns: DataFrame, part_rows: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, formatted, loss, n_blocks) of rows (conv_id, turn, role, text).

    Every ``part_rows`` turns in order are a part, whatever their numbers. Adjacent
    turns of a role are merged wherever they stand: a block that goes on in the
    next part is left open there and continued with the merge mark, so the parts
    put together in order are the same string for every ``part_rows``. ``loss``
    counts from the beginning of its part; ``n_blocks`` are those that begin in it.

    Null texts and roles count as empty. Turns are ordered by number, null numbers
    first; ties by role, then text. Repeated rows are turns each. Rows with a null
    conv_id form one conversation. Texts of any length are kept whole. An empty
    table gives no rows; other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    joins = lambda neighbour: F.coalesce(neighbour.over(order) == F.col("role"), F.lit(False))
    rows = rows.select("*", (F.row_number().over(order) - 1).alias("at"), joins(F.lag("role")).alias("goes_on"), joins(F.lead("role")).alias("stays_open"))
    rows = rows.select("conv_id", F.floor(F.col("at") / part_rows).alias("part"), F.struct("at", "role", "text", "goes_on", "stays_open").alias("t"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first, last = F.element_at("turns", 1), F.element_at("turns", -1)
    head = F.when(first["goes_on"], len(OPEN) + F.char_length(escape(first["role"], ROLE_ESCAPES)) + len(COLON)).otherwise(0)
    blocks = parts.select("conv_id", "part", merged_turns(F.col("turns")).alias("blocks"), head.alias("head"), F.when(last["stays_open"], len(CLOSE)).otherwise(0).alias("tail"))
    closed = blocks.select("*", F.array_join(F.transform("blocks", _block_text), "").alias("closed"))
    mark = F.when(F.col("head") > 0, F.lit(MERGED)).otherwise(F.lit(""))
    body = F.substring(F.col("closed"), F.col("head") + 1, F.char_length("closed") - F.col("head") - F.col("tail"))
    shift = F.char_length(mark) - F.col("head")
    loss = F.transform(_loss_ranges(F.col("blocks")), lambda r: F.struct((r["start"] + shift).alias("start"), (r["end"] + shift).alias("end")))
    n_blocks = F.size("blocks") - (F.col("head") > 0).cast("int")
    return closed.select("conv_id", "part", F.concat(mark, body).alias("formatted"), loss.alias("loss"), n_blocks.alias("n_blocks"))


#: The name under which parts were made before turns were merged over their ends.
format_conversations = format_whole_conversations


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted string, merged ones apart."""
    blocks = F.filter(F.split(formatted, " </turn>\n", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        cut = F.instr(block, COLON)
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN)), ROLE_ESCAPES)
        body = F.substring(block, cut + len(COLON), F.char_length(block))
        return F.transform(F.split(body, r"<\+>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def text_under_mask(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, range after range with nothing between."""
    return F.array_join(F.transform(loss, lambda r: unescape(F.substring(formatted, r["start"] + 1, r["end"] - r["start"]))), "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted parts:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_blocks. A digest over a whole conversation needs its text in one row, so
    here (not in the formatting) a conversation's parts meet."""
    parts = formatted.select("conv_id", F.char_length("formatted").alias("chars"), "n_blocks", F.struct("part", "formatted", text_under_mask(F.col("formatted"), F.col("loss")).alias("loss")).alias("p"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.sum("n_blocks").cast("long").alias("n_blocks"),
        F.sort_array(F.collect_list("p")).alias("p"),
    )
    joined = lambda field: F.array_join(F.transform("p", lambda x: x[field]), "")
    whole = whole.select("conv_id", read_back(joined("formatted")).alias("turns"), joined("loss").alias("loss"), "formatted_chars", "n_blocks")
    printed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(printed, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


#: The conversation that the query adds: control strings inside its texts.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def oracle_sql() -> str:
    """DuckDB SQL for the digests, from the turns themselves."""
    text = PROBE[0][3]
    esc = "coalesce(text, '')"
    for plain, marked in ESCAPES:
        esc = f"replace({esc}, '{plain}', '{marked}')"
    role = "role"
    for plain, marked in ROLE_ESCAPES:
        role = f"replace({role}, '{plain}', '{marked}')"
    head, tail = len(OPEN) + len(COLON), len(CLOSE)
    return f"""with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{text}' union all select -7, 1, 'assistant', '{text}'),
marked as (
  select *, length({esc}) as n,
    case when role = lag(role) over (partition by conv_id order by turn nulls first, role, text)
         then {len(MERGED)} else length({role}) + {head + tail} end as frame
  from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = '{LOSS_ROLE}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = '{LOSS_ROLE}'), '')) as loss_sha256,
  sum(n + frame)::bigint as formatted_chars,
  (count(*) filter (where frame <> {len(MERGED)}))::bigint as n_blocks
from marked group by conv_id"""
