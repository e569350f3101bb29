import random

import numpy as np
import pyarrow as pa
import pytest

from cadence.llm import spm_codec, token_counts, training_order
from cadence.llm.common import WordTable

ODD = ["", " ", "   ", "a", " a", "a ", "  a  b", "日本語 テスト 😀😀 x", "▁a ▁", "a\n\nb\tc", "<s> </s> <0x41>", "ﬁé́", "\x00a", "2². ², x.y", "$$ a$$ ##!"]


def texts():
    rng = random.Random(9)
    alphabet = ["the", "ing", "x", ".", ",", "\n", " ", "  ", "é", "日", "²", "😀", "$", "1", "A"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)]


def test_counts_equal_the_library(monkeypatch):
    path = token_counts.model_path()
    sp = token_counts.processor(path)
    assert token_counts.is_word_safe(path)
    want = [len(sp.encode(t)) for t in texts()]
    assert token_counts.slice_counts(pa.array(texts(), pa.large_string()), path).tolist() == want
    monkeypatch.setattr(token_counts, "chunks_of", lambda t, most=5: _chunks(t, most))
    assert token_counts.count_tokens_in(texts(), path) == want


_chunks = token_counts.chunks_of


def test_chunks_are_whole_and_bounded():
    text = " ".join(["abc"] * 1000) + "   "
    parts = token_counts.chunks_of(text, 50)
    assert "".join(parts) == text and max(map(len, parts)) < 60 and len(parts) > 50


def test_count_query_on_odd_rows(clashing):
    sp = token_counts.processor(token_counts.model_path())
    got = sorted((tuple(r) for r in token_counts.count_tokens(clashing, limit=100).collect()), key=str)
    rows = [(r.doc_id, r.text or "") for r in clashing.collect()]
    want = sorted(((d, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 100) for d, t in rows), key=str)
    assert got == want
    assert token_counts.count_tokens(clashing.limit(0)).count() == 0


def brute_viterbi(text, codec, scores):
    """Best score over all segmentations, character by character."""
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            piece = text[start:end]
            if piece in scores:
                best[end] = max(best[end], best[start] + scores[piece])
        if text[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + codec.unknown)
    return best[-1]


def test_encoding_has_the_best_score_and_round_trips():
    path = token_counts.model_path()
    sp, codec = token_counts.processor(path), spm_codec.codec(path)
    scores = {sp.id_to_piece(k): sp.get_score(k) for k in range(259, sp.get_piece_size())}
    some = texts()
    ids, cuts = spm_codec.encode_slice(pa.array(some, pa.large_string()), path)
    for k, t in enumerate(some):
        got = ids[cuts[k] : cuts[k + 1]]
        total, run = 0.0, b""
        for i in got.tolist():
            if sp.is_byte(i):
                run += bytes([int(sp.id_to_piece(i)[3:5], 16)])
                try:
                    run.decode()
                except UnicodeDecodeError:
                    continue
                total, run = total + codec.unknown, b""
            else:
                total += sp.get_score(i)
        assert total == brute_viterbi(sp.normalize(t), codec, scores), t
        assert codec.decode(got) == sp.decode(got.tolist())
        assert (codec.decode(got) == t) == ("▁" not in t)


def test_encode_documents_on_odd_rows(clashing):
    out = spm_codec.encode_documents(clashing)
    rows = out.collect()
    assert len(rows) == 8 and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
    back = out.select("doc_id", spm_codec.decode(out["ids"], token_counts.model_path()).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=str) == sorted(((r.doc_id, r.text or "") for r in clashing.collect()), key=str)
    assert spm_codec.encode_documents(clashing.limit(0)).count() == 0


def test_word_table_is_bounded_and_right():
    asked = []
    table = WordTable(lambda ws: asked.extend(ws) or [w * 2 for w in ws], most=5)
    for k in range(50):
        words = [f"w{(k * 7 + j) % 23}" for j in range(6)] * 2
        assert table.values(words) == [w * 2 for w in words]
        assert len(table.young) <= 5 + 6 and len(table.old) <= 5 + 6
    assert table.values([]) == []


@pytest.mark.parametrize("domain", [1, 2, 3, 7, 1000, 4097])
def test_permutation_is_a_bijection(domain):
    x = training_order.permute(np.arange(domain), 5, domain)
    assert sorted(x.tolist()) == list(range(domain))
    assert (training_order.permute(x, 5, domain, inverse=True) == np.arange(domain)).all()
    if domain > 100:
        assert (x != training_order.permute(np.arange(domain), 6, domain)).any()


def test_permutation_refuses_numbers_outside():
    with pytest.raises(ValueError):
        training_order.permute(np.array([7]), 1, 7)


def test_word_wise_ids_equal_the_library():
    path = training_order.ranks_path()
    enc = training_order.encoding(path)
    some = texts() + ["a\n \nb", "x\n y", "it's we'll  x", "a  b", "a　b c"]
    got = training_order.encode_slice(pa.array(some, pa.large_string()), path)
    assert [np.frombuffer(g, dtype="<u2").tolist() for g in got] == [enc.encode_ordinary(t) for t in some]


def test_training_order_round_trip(spark, clashing, tmp_path):
    docs = clashing.repartition(3).sortWithinPartitions("doc_id", "text").cache()
    folder = training_order.write_training_order(docs, f"{tmp_path}/a", key=3, shards=5, length=16)
    again = training_order.write_training_order(docs, f"{tmp_path}/b", key=3, shards=5, length=16)
    other = training_order.write_training_order(docs, f"{tmp_path}/c", key=4, shards=5, length=16)
    read = lambda f, **k: sorted(map(tuple, training_order.read_training_order(spark, f, length=16, **k).collect()))
    rows = read(folder)
    assert rows == read(again) and [r[2] for r in rows] != [r[2] for r in read(other)]
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert (np.diff(training_order.permute(np.array([r[2] for r in rows]), 3)) > 0).all()
    assert read(folder, start=len(rows) // 2) == rows[len(rows) // 2 :]
    enc = training_order.encoding(training_order.ranks_path())
    ids = np.concatenate([np.frombuffer(r[4], dtype="<u2") for r in sorted(rows, key=lambda r: r[2])])
    assert all(len(r[4]) == 2 * r[3] for r in rows)
    texts_back = [enc.decode(x[:-1].tolist()) for x in np.split(ids, np.flatnonzero(ids == training_order.END_OF_TEXT) + 1)[:-1]]
    assert sorted(texts_back) == sorted(r.text or "" for r in docs.collect())


def test_training_order_of_nothing(spark, clashing, tmp_path):
    folder = training_order.write_training_order(clashing.limit(0), f"{tmp_path}/none", key=3, shards=2, length=16)
    assert training_order.read_training_order(spark, folder, length=16).count() == 0
