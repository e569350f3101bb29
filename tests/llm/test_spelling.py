import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import queries, spelling

LOWER = {k: k + 32 for k in range(65, 91)}


def plain_words(rows):
    """Words of the contract, one run after another."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words):
    out = {}
    near = {w: [x for x in words if plain_distance_one(w, x)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_whole_query_against_brute_force(spark, docs_of, tmp_path):
    import random

    draw = random.Random(5)
    stems = ["writing", "colour", "organise", "travelled", "été", "garçon", "mañana", "straße", "thethe", "aaaaa", "aaaaaa", "abcabcabc"]
    rows = []
    for k in range(150):
        words = []
        for _ in range(40):
            w = draw.choice(stems) + draw.choice(["", "s", "er", "ing"])
            if draw.random() < 0.4:
                i = draw.randrange(len(w))
                w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("abeé") + w[i:], w[:i] + draw.choice("xyou") + w[i + 1 :]])
            words.append(w.title() if draw.random() < 0.2 else w)
        rows.append((k if k % 17 else None, draw.choice([" ", ", ", "\n", "1"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " 12 "), (1003, "z" * 30_000 + " "), (1004, "z" * 30_000), (1005, "z" * 30_000), (1006, ("z" * 29_999 + "y ") * 4)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    words = plain_words(rows)
    assert len(words) > 200
    assert got(queries.op13_spelling_variants(spark, str(tmp_path))) == plain_variants(words)


@pytest.mark.parametrize("list_most", [1, 6, 8192])
def test_lists_of_any_length_give_the_same_pairs(spark, list_most):
    import random

    draw = random.Random(7)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randrange(1, 9))) for _ in range(400)} | {"", "x"})
    found = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), list_most).select("word", "other").collect()
    pairs = {(r[0], r[1]) for r in found}
    assert len(pairs) == len(found)
    assert pairs == {(a, b) for a in words for b in words if plain_distance_one(a, b)}


def test_chain_of_forms_ends_at_its_root(spark):
    words = [("abcdef" + "xyzuvw"[:k] if k else "abcdef", 3 * 2**k) for k in range(7)] + [("qqqqq", 5), ("qqqqr", 9)]
    rows = got(spelling.spelling_variants(spark.createDataFrame(words, "word string, n long")))
    assert {rows[w][1] for w, _ in words[:7]} == {"abcdefxyzuvw"}
    assert rows["qqqqq"] == (None, "qqqqq", 5, 1, None)


def test_ties_empty_tables_and_other_columns(spark):
    schema = "word string, n long, key long, own boolean, other string, form string"
    rows = [("token", 3, 1, True, "o", "f"), ("tokens", 8, 1, True, "o", "f"), ("tokex", 8, 1, True, "o", "f"), (None, 9, 1, True, "o", "f")]
    assert got(spelling.spelling_variants(spark.createDataFrame(rows, schema)))["token"] == ("tokens", "tokens", 3, 2, 8)
    assert spelling.spelling_variants(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé", min_size=1, max_size=12), st.sets(st.sampled_from(["aa", "ab", "ba", "bb", "é\x03", "\x02a", "aé"])), st.data())
def test_bound_holds_for_every_edit(word, frequent, data):
    """A word one edit away shares a list with the word, or neither has a bound."""
    at = data.draw(st.integers(0, len(word)))
    c = data.draw(st.sampled_from("abéz"))
    other = data.draw(st.sampled_from([word[:at] + c + word[at:], word[:at] + c + word[at + 1 :], word[:at] + word[at + 1 :]]))
    if not plain_distance_one(word, other):
        return
    assert spelling.one_edit(word, other)
    assert set(spelling.deletion_keys(word)) & set(spelling.deletion_keys(other))
    bounds = {w: spelling.bound_of(w, frequent) for w in (word, other)}
    highest = {n: max([b for w, b in bounds.items() if len(w) == n], default=0) for n in map(len, bounds)}
    (bound, keys), (other_bound, others) = (spelling.list_keys(w, frequent, highest) for w in (word, other))
    if max(bound, other_bound) > 0:
        shared = {k for k, _ in keys} & {k for k, _ in others}
        owned = {k for k, own in keys + others if own}
        assert shared & owned
