"""Secret scans with Spark expressions only.

Base kinds are patterns with a length test. The method adds spans of high
entropy: runs of a character class (hexadecimal, base64) at least a window long
are candidates; a window slides over each, its Shannon entropy following from
the counts of its characters, which change by one character in and one out per
step. Windows at or over the class's threshold are joined into spans.
Candidates on the allow-list give no such span; base spans always stay.

Redaction judges runs of narrower alphabets too, each by its own threshold, and
once a window of a candidate is hot it takes the whole candidate. The spans of
``find_secrets`` are those of its SQL: the joined windows of the two classes.

Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import spare_name

WINDOW = 20


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, the same to every engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: kind -> (pattern, group whose length counts, characters it needs)
BASE_KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    alphabet: str
    pattern: str
    threshold: float  # bits per character over WINDOW characters


#: A random window of 20 has about 3.5 bits (of at most 4) from hexadecimal
#: digits and about 4.1 (of at most log2 20 = 4.32) from base64.
CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdefABCDEF", "[0-9a-fA-F]{20,}", 3.0),
    CharacterClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", "[A-Za-z0-9+/_=-]{20,}", 3.75),
)
#: Alphabets that redaction judges by themselves. Of 200,000 random strings of 20
#: characters each, 0.13 % (of 32 symbols) and 0.06 % (of 36) have less than 3.2
#: bits; 3.5 % of base64 have less than 3.75, 3.0 % of 16 digits less than 3.0.
NARROW_CLASSES = (
    CharacterClass("entropy_lower36", "abcdefghijklmnopqrstuvwxyz0123456789", "[a-z0-9]{20,}", 3.2),
    CharacterClass("entropy_upper36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "[A-Z0-9]{20,}", 3.2),
)
KINDS = (*BASE_KINDS, *(c.kind for c in CLASSES))
_RANKS = (*KINDS, *(c.kind for c in NARROW_CLASSES))
#: Candidates that match one of these as a whole are no secrets: words, plain
#: numbers, identifiers of words, UUIDs, published example keys, hexadecimal
#: runs (for the base64 class, the hexadecimal class has judged them).
ALLOW_LIST = (
    r"[A-Za-z_=-]+",
    r"[A-Za-z]+([/_=-][A-Za-z]+)*",
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r".*EXAMPLE.*",
    r"(0123456789abcdef)+|(0123456789ABCDEF)+",
)
SHORT_CUT = "|".join([rf"({_NAMES})", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{20}"])


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, found>>: all leftmost non-overlapping matches, in order.

    The text between matches and the matches themselves alternate, so running
    sums of their lengths give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(between.alias("between"), found.alias("found"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["between"])
        grown = F.array_append(state["out"], F.struct(start.alias("start"), x["found"].alias("found")))
        return F.struct((start + F.char_length(x["found"])).alias("at"), grown.alias("out"))

    return F.aggregate(F.filter(pairs, lambda x: x["found"].isNotNull()), empty, step, lambda s: s["out"])


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(_RANKS.index(kind)).alias("rank"), end.cast("int").alias("end"))


_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _at_least(kind: str) -> str:
    """The pattern to search with. A hexadecimal match is a maximal run, so asking
    for the length at once finds the same spans without the short runs that
    ordinary words hold."""
    pattern, _, least = BASE_KINDS[kind]
    return pattern.replace("+", f"{{{least},}}") if kind == "hex" else pattern


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a base kind: leftmost matches, those whose group is too short dropped."""
    pattern, group, least = BASE_KINDS[kind]
    found = _matches(text, _at_least(kind))
    long_enough = F.filter(found, lambda m: F.char_length(F.regexp_extract(m["found"], pattern, group)) >= least)
    return F.transform(long_enough, lambda m: _span(kind, m["start"], m["start"] + F.char_length(m["found"])))


def _count_term(c: Column) -> Column:
    """c log2 c, zero for no character."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_windows(candidate: Column, cls: CharacterClass, window: int = WINDOW) -> Column:
    """array<struct<a, b>>: joined windows of ``candidate`` whose entropy is at
    least the threshold. The state holds the counts of the window's characters
    and the sum of c log2 c over them; a step changes two counts."""
    codes = F.transform(F.filter(F.split(candidate, ""), lambda x: x != ""), lambda x: F.instr(F.lit(cls.alphabet), x) - 1)
    zeros = F.array_repeat(F.lit(0), len(cls.alphabet))
    kind = "struct<counts:array<int>,s:double,out:array<struct<a:int,b:int>>>"
    init = F.struct(zeros.alias("counts"), F.lit(0.0).alias("s"), F.array().cast("array<struct<a:int,b:int>>").alias("out")).cast(kind)

    def bump(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda c, k: F.when(k == code, c + by).otherwise(c))

    def run(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            code = F.get(codes, i)
            grown = bump(state["counts"], code, 1)
            now = F.get(grown, code)
            s = state["s"] + _count_term(now) - _count_term(now - 1)
            # the character that leaves the window, if the window is full
            old = F.get(codes, i - window)
            shrunk = F.when(i >= window, bump(grown, old, -1)).otherwise(grown)
            left = F.get(shrunk, old)
            s = s + F.when(i >= window, _count_term(left) - _count_term(left + 1)).otherwise(F.lit(0.0))
            hot = (i >= window - 1) & (F.lit(math.log2(window)) - s / F.lit(float(window)) >= F.lit(cls.threshold))
            a, b = i - (window - 1), i + 1
            out, last = state["out"], F.try_element_at(state["out"], F.lit(-1))
            joined = F.when(
                last["b"] >= a,
                F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), b.alias("b")))),
            ).otherwise(F.array_append(out, F.struct(a.alias("a"), b.alias("b"))))
            return F.struct(shrunk.alias("counts"), s.alias("s"), F.when(hot, joined).otherwise(out).alias("out")).cast(kind)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), init, step, lambda x: x["out"])

    # the codes are bound once, as the single element of an array
    return F.element_at(F.transform(F.array(codes), run), 1)


def entropy_spans(text: Column, cls: CharacterClass, allow: tuple[str, ...] = ALLOW_LIST, whole: bool = False) -> Column:
    """Spans of high entropy of one class, without candidates on the allow-list
    (matched as a whole); hexadecimal runs are left to their own class. With
    ``whole``, a candidate with a hot window is one span from end to end."""
    allowed = [*allow, *([r"[0-9a-fA-F]+"] if cls.kind != "entropy_hex" else [])]
    suppressed = "^(" + "|".join(f"({p})" for p in allowed) + ")$"
    found = F.filter(_matches(text, cls.pattern), lambda m: ~m["found"].rlike(suppressed))
    if whole:
        hot = F.filter(found, lambda m: F.size(hot_windows(m["found"], cls)) > 0)
        return F.transform(hot, lambda m: _span(cls.kind, m["start"], m["start"] + F.char_length(m["found"])))
    return F.flatten(
        F.transform(found, lambda m: F.transform(hot_windows(m["found"], cls), lambda w: _span(cls.kind, m["start"] + w["a"], m["start"] + w["b"])))
    )


def scan(text: Column, whole: bool = False) -> tuple[Column, Column]:
    """(base spans, added spans) of a text, each array<struct<start, rank, end>>.
    Texts without any possible match are passed over by one pattern. With
    ``whole``, narrow alphabets are judged too and added spans are whole candidates."""
    empty = F.array().cast(_SPANS)
    maybe = text.rlike(SHORT_CUT)
    guarded = lambda spans: F.when(maybe, spans).otherwise(empty)
    base = F.array_sort(F.concat(*[base_spans(text, k) for k in BASE_KINDS]))
    added = F.concat(*[entropy_spans(text, c, whole=whole) for c in (*CLASSES, *(NARROW_CLASSES if whole else ()))])
    return guarded(base), guarded(added)


def _printed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) per row of ``docs``.

    Null and empty texts have no spans: zero counts, the digest of the empty
    string, empty ``spans``. Repeated rows and null ids are scanned like any
    other; an empty table gives no rows; other columns are ignored.
    """
    base, added = scan(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", base.alias("base"), added.alias("added"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    return rows.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_printed(F.col("base")), 256).alias("base_sha256"),
        _printed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, candidates of
    high entropy from end to end; overlapping and touching spans get one mark. ``n_chars`` is set anew where a text changed, if
    there is such a column. Null texts stay null; all other columns stay."""
    spans = spare_name(docs, "spans")
    base, added = scan(F.coalesce(F.col("text"), F.lit("")), whole=True)
    marked = docs.withColumn(spans, F.array_sort(F.concat(base, added)))
    kind = "struct<at:int,out:array<string>>"
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind)

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        fresh = (s["start"] > state["at"]) | (F.size(state["out"]) == 0)
        out = F.when(fresh, F.concat(state["out"], F.array(kept, F.lit(mark)))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out")).cast(kind)

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(F.col("text"), state["at"] + 1, F.char_length("text")))

    some = F.size(F.col(spans)) > 0
    done = marked.withColumn("text", F.when(some, F.aggregate(F.col(spans), init, step, finish)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(some, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def oracle_sql() -> str:
    """DuckDB SQL for ``find_secrets`` over ``documents``; every window's entropy
    is computed from its own characters."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = [(k, p, g, n) for k, (p, g, n) in BASE_KINDS.items()]
    parts, names = [], []
    for k, _, group, least in kinds:
        pattern = _at_least(k)
        parts.append(f"""{k}_m as (
  select rid, unnest(found) as f, unnest(range(1, len(found) + 1)) as i, between
  from (select rid, regexp_extract_all(text, {quote(pattern)}) as found, string_split_regex(text, {quote(pattern)}) as between, text from docs)),
{k}_s as (
  select rid, {KINDS.index(k)} as rank, length(list_aggregate(between[1:i], 'string_agg', '')) + coalesce(sum(length(f)) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as s, f, length(regexp_extract(f, {quote(pattern)}, {group})) as n
  from {k}_m),
{k} as (select rid, rank, s, s + length(f) as e from {k}_s where n >= {least})""")
        names.append(k)
    for c in CLASSES:
        allowed = [*ALLOW_LIST, *([r"[0-9a-fA-F]+"] if c.kind != "entropy_hex" else [])]
        allow = "|".join(f"({p})" for p in allowed)
        k = c.kind
        parts.append(f"""{k}_m as (
  select rid, unnest(found) as f, unnest(range(1, len(found) + 1)) as i, between
  from (select rid, regexp_extract_all(text, {quote(c.pattern)}) as found, string_split_regex(text, {quote(c.pattern)}) as between from docs)),
{k}_s as (
  select rid, i, length(list_aggregate(between[1:i], 'string_agg', '')) + coalesce(sum(length(f)) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as s, f
  from {k}_m),
{k}_w as (
  select rid, i, s + a as a, substr(f, a + 1, {WINDOW}) as w
  from (select rid, i, s, f, unnest(range(0, length(f) - {WINDOW} + 1)) as a from {k}_s where not regexp_full_match(f, {quote(allow)}))),
{k}_c as (select rid, i, a, ch, count(*) as n from (select rid, i, a, unnest(string_split(w, '')) as ch from {k}_w) group by all),
{k}_h as (
  select rid, i, a from (select rid, i, a, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} as h from {k}_c group by all) where h >= {c.threshold}),
{k}_g as (
  select rid, i, a, sum(fresh) over (partition by rid, i order by a) as g
  from (select rid, i, a, case when a - lag(a) over (partition by rid, i order by a) <= {WINDOW} then 0 else 1 end as fresh from {k}_h)),
{k} as (select rid, {KINDS.index(k)} as rank, min(a) as s, max(a) + {WINDOW} as e from {k}_g group by rid, i, g)""")
        names.append(k)
    unions = "\n  union all ".join(f"select rid, rank, s::bigint as s, e::bigint as e, {quote(k)} as kind from {k}" for k in names)
    base = len(BASE_KINDS)
    counts = ", ".join(f"(count(*) filter (where rank = {KINDS.index(k)}))::bigint as n_{k}" for k in BASE_KINDS)
    one = "kind || ':' || s || ':' || e"
    return f"""with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
{", ".join(parts)},
spans as ({unions})
select doc_id, {counts},
  sha256(coalesce(string_agg({one}, ',' order by s, rank, e) filter (where rank < {base}), '')) as base_sha256,
  coalesce(string_agg({one}, ',' order by s, rank, e) filter (where rank is not null), '') as spans,
  (count(*) filter (where rank >= {base}))::bigint as n_entropy
from docs left join spans using (rid) group by rid, doc_id"""
