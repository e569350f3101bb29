import hashlib
import random

import numpy as np
import pytest

from cadence.llm import queries, suffix_dedup

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(rows):
    """The contract, string by string."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            if i is not None:
                least[t[p : p + 50]] = min(least.get(t[p : p + 50], i), i)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            first = least.get(t[p : p + 50])
            if first is not None and (i is None or first < i):
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(seed, docs=60):
    """Documents out of few passages, cut and changed at random, with long repeats."""
    draw = random.Random(seed)
    passages = ["".join(draw.choice(["the ", "än", "b", "of ", "x1 ", "日本", "is"]) for _ in range(draw.randrange(5, 90))) for _ in range(8)]
    rows = []
    for k in range(docs):
        parts = []
        for _ in range(draw.randrange(0, 6)):
            p = draw.choice(passages)
            a, b = sorted(draw.sample(range(len(p) + 1), 2))
            parts.append(draw.choice([p, p[a:b], p[:a] + "#" + p[a:], "ab" * draw.randrange(40), "z" * draw.randrange(70), str(draw.random())]))
        rows.append((draw.choice([k, k, k, 3, None]), draw.choice([None, ""]) if draw.random() < 0.05 else "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, docs_of, tmp_path, seed):
    rows = made(seed)
    docs_of(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op12_suffix_dedup(spark, str(tmp_path))) == plain(rows)


@pytest.mark.parametrize(("seed", "slice_bytes", "piece", "parts"), [(24, 2500, 1 << 18, 3), (6, 1 << 20, 64, 1), (7, 900, 130, 5), (8, 1, 51, 2), (41, 4000, 1000, 7)])
def test_depths_without_spark(monkeypatch, seed, slice_bytes, piece, parts):
    """Slices and pieces of any size give the same bytes."""
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = made(seed, 80)
    slices, now = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)) if seed % 2 else rows:
        now.append((i, (t or "").encode()))
        if sum(len(t) for _, t in now) >= slice_bytes:
            slices, now = [*slices, now], []
    slices.append(now)
    slices = [sorted(s, key=lambda r: (r[0] is None, r[0] or 0)) for s in slices]
    rows_of = [suffix_dedup.Slice(np.array([suffix_dedup._NO_ID if i is None else i for i, _ in s], dtype=np.int64), np.array([len(t) for _, t in s], dtype=np.int64), b"".join(t for _, t in s)) for s in slices]
    replies = [[] for _ in slices]
    for depth in range(3):
        entries = [e for k, r in enumerate(rows_of) for e in suffix_dedup.Refinement(r, parts, replies[k]).buckets.rows(k)]
        for k in range(len(slices)):
            replies[k].append([])
        for part in range(parts):
            group = [e for e in entries if e["part"] == part]
            if not group:
                continue
            name, text = (np.frombuffer(b"".join(e[c] for e in group), dtype=np.uint64) for c in ("name", "text"))
            flags = suffix_dedup.answer(name, text, np.frombuffer(b"".join(e["least"] for e in group), dtype=np.int64), np.frombuffer(b"".join(e["many"] for e in group), dtype=np.uint8), depth == 2)
            at = 0
            for e in group:
                n = len(e["name"]) // 8
                replies[e["slice"]][depth].append({"part": part, "flags": flags[at : at + n].tobytes()})
                at += n
    out = []
    for s, r, reply in zip(slices, rows_of, replies, strict=True):
        gone = suffix_dedup.Refinement(r, parts, reply).removed()
        for (i, t), a in zip(s, r.starts[:-1].tolist(), strict=True):
            mine = gone[a : a + len(t)]
            spans = int(np.sum(np.diff(np.concatenate(([False], mine)).astype(int)) > 0))
            kept = np.frombuffer(t, dtype=np.uint8)[~mine].tobytes()
            out.append((i, len(t), int(mine.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(out, key=str) == plain(rows)


def test_odd_rows_and_other_columns(spark, odd_docs, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows = [(i, t) for i, t in rows if not t or len(t) < 1000]
    found = {r["doc_id"]: r for r in suffix_dedup.repeated_strings(clashing).collect()}
    assert found[4]["spans"] == [] and found[4]["n_bytes"] > 300_000  # a document's own repeats stay
    assert found[1]["kept"] == b"" and found[2]["kept"] == b"" and bytes(found[6]["kept"]) == "é😀 日本 ok".encode()
    assert suffix_dedup.repeated_strings(clashing).count() == odd_docs.count()


def test_empty_table(spark, docs_of):
    assert suffix_dedup.repeated_strings(docs_of([])).count() == 0


def test_spans_are_byte_places(spark, docs_of):
    passage = "ä" * 30  # 60 bytes
    found = {r["doc_id"]: r for r in suffix_dedup.repeated_strings(docs_of([(2, "xx" + passage + "yy"), (1, passage)])).collect()}
    assert [(s["start"], s["stop"]) for s in found[2]["spans"]] == [(2, 62)] and bytes(found[2]["kept"]) == b"xxyy"
    assert found[1]["spans"] == []
