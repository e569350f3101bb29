import random

import numpy as np
import xxhash

from cadence.llm import simhash


def brute_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, most=2):
    """(id, fp) -> smallest id reachable."""
    label = list(range(len(pairs)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= most:
                label[root(i)] = root(j)
    out = {}
    for k, (d, _) in enumerate(pairs):
        if d is not None:
            out[root(k)] = min(out.get(root(k), d), d)
    return [out.get(root(k)) for k in range(len(pairs))]


def test_fingerprint_matches_the_definition(monkeypatch):
    monkeypatch.setattr(simhash, "VOTE_BLOCK", 7)
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 9, 40):
        text = " ".join(rng.choice(["Ab", "cÉ", "x y", "Z", " q"]) + rng.choice(["", "\n", "\t\v"]) for _ in range(n))
        assert simhash.text_fingerprint(text.encode(), 3) == brute_fingerprint(text)


def test_pairs_at_two_bits_share_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, size=200, dtype=np.uint64)
    for flips in (0, 1, 2):
        y = x.copy()
        for row in range(len(x)):
            for b in rng.choice(64, flips, replace=False):
                y[row] ^= np.uint64(1) << np.uint64(b)
        for a, b in zip(simhash.anchors_within_two(x), simhash.anchors_within_two(y), strict=True):
            assert len(a) in (2, 33) and set(a.tolist()) & set(b.tolist())


def test_anchors_lie_within_two_bits():
    x = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for fp, anchors in zip(x, simhash.anchors_within_two(x), strict=True):
        assert len(set(anchors.tolist())) == len(anchors)
        assert np.bitwise_count(anchors ^ fp).max() <= 2


def test_components_match_brute_force(spark, docs_of):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base * 4]
    fps += [fps[-1] ^ 3, fps[-1] ^ 15, fps[-1] ^ 63]  # a chain
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
    links = simhash.linked_fingerprints(rows)
    parts = {r.node: r.component for r in simhash.connected_components(links).collect()}
    unsigned = sorted(set(fps))
    want = brute_components([(k, f) for k, f in enumerate(unsigned)])
    as_signed = [f - (1 << 64) if f >> 63 else f for f in unsigned]
    got = [parts.get(s, s) for s in as_signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_documents_match_brute_force(clashing, docs_of):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps), strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.simhash_components(clashing).collect()), key=str) == want
    assert simhash.simhash_components(docs_of([]).limit(0)).count() == 0


def test_one_document_of_each_group_stays(clashing):
    kept = simhash.keep_one_per_component(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 6, None]


def test_large_group_of_near_copies_links_without_all_pairs(spark):
    """A dense ball of fingerprints gives links that grow with its size, not its square."""
    centre = 0x123456789ABCDEF0
    ball = [centre] + [centre ^ (1 << b) for b in range(60)]
    rows = spark.createDataFrame([(f,) for f in ball], "fp long")
    links = simhash.linked_fingerprints(rows)
    assert links.count() < 61 * 34
    assert {r.component for r in simhash.connected_components(links).collect()} == {min(ball)}
