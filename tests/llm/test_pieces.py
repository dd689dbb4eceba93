import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import tesserae.llm.pieces as pieces
from tesserae.llm.blocks import mix, powers, utf8

TEXTS = ["", " ", "  two  spaces\n\tand tab ", "ﬁ①Ａ é é", "the\x00z", "a\r\nb", "antidisestablish" * 60, "日本語テキスト" * 50, "   " * 30, "The quick brown fox, über naïve; 12345 $$ {x}"]
MARKED = [*TEXTS, "x▁y ▁", "▁"]


@pytest.fixture(scope="module")
def merger():
    return pieces.Merger(pieces.read_model())


def encode(m, texts, seed=1, dropout=0.0):
    data, offsets = utf8(pa.array(texts))
    m.cached_for = None
    return m.encode(data, offsets, np.arange(len(texts)), seed, dropout)


def test_without_dropout_as_the_library(merger):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids, at = encode(merger, TEXTS)
    for i, text in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_every_segmentation_decodes(merger, dropout):
    ids, at = encode(merger, MARKED, 3, dropout)
    data, ends = merger.decode(ids, at)
    data = data.tobytes()
    assert [data[a:b].decode() for a, b in zip(ends, ends[1:])] == MARKED


def test_seeds_vary_and_repeat(merger):
    one, two, three = (encode(merger, TEXTS, s, 0.3)[0].tolist() for s in (1, 1, 2))
    assert one == two != three


def test_equal_words_are_cut_freely(merger):
    """A frequent word has as many segmentations as its candidates allow, each candidate skipped at the rate."""
    n = 4000
    ids, at = encode(merger, ["international"] * n, 7, 0.1)
    cuts = [tuple(ids[a:b]) for a, b in zip(at, at[1:])]
    assert len(set(cuts)) > 16
    ids, at = encode(merger, ["aa"] * n, 7, 0.1)
    plain = encode(merger, ["aa"])[0].tolist()
    kept = sum(ids[a:b].tolist() == plain for a, b in zip(at, at[1:]))
    assert len(plain) < 3 and 0.7 < kept / n < 0.95


def test_cached_words_as_cut_anew(merger):
    """Words whose cut without dropout stands are what the agenda gives them."""
    texts = [" ".join(TEXTS)] * 20
    cached = encode(merger, texts, 5, 0.05)
    plain = merger._plain
    merger._plain = lambda code, starts, lengths, candidates: (*plain(code, starts, lengths, False)[:2], np.zeros(len(starts), np.uint64), np.arange(len(starts) + 1))
    limit, pieces._limit = pieces._limit, lambda d: np.uint64(2**64 - 1)  # all words are cut anew
    try:
        segment = merger._segment

        def anew(*a):
            pieces._limit = limit
            return segment(*a)

        merger._segment = lambda *a: anew(*a) if a[-1] > 0 else segment(*a)
        again = encode(merger, texts, 5, 0.05)
    finally:
        pieces._limit = limit
        del merger._plain, merger._segment
    assert cached[0].tolist() == again[0].tolist() and cached[1].tolist() == again[1].tolist()


def test_rounds_are_the_agenda(merger, monkeypatch):
    rounds = encode(merger, MARKED, 5, 0.2)
    monkeypatch.setattr(pieces, "LONG", 0)
    agenda = encode(merger, MARKED, 5, 0.2)
    assert rounds[0].tolist() == agenda[0].tolist() and rounds[1].tolist() == agenda[1].tolist()


def written_down(m, text, doc, seed, dropout):
    """One text's pieces, candidate by candidate, from the docstring's words."""
    out, limit = [], int(pieces._limit(dropout))
    data, offsets = utf8(pa.array([text]))
    code, _ = m._characters(data, offsets)
    starts = [i for i, c in enumerate(code) if i == 0 or (c == 0x2581 and code[i - 1] != 0x2581)]
    for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(code)])):
        word = code[a:b]
        up, down = powers(len(code) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((word + 1).view(np.uint64) * up[: len(word)], dtype=np.uint64)])
        name = mix(total[-1:] + np.array([len(word)], np.uint64))
        own = mix(mix(np.array([doc + 1], np.uint64)) + np.uint64(number))
        key = int((mix(name + own * np.uint64(0xA5A3564EDCE5B0B3)) ^ mix(np.array([seed], np.uint64)))[0])
        symbols = [(i, int(m.of_char[c])) for i, c in enumerate(word)]
        while True:
            best = None
            for k, ((i, x), (j, y)) in enumerate(zip(symbols, symbols[1:])):
                piece = m.pairs.get(x << 20 | y, -1)
                if piece >= 0 and pieces._mix(pieces._named(key, i, j, piece)) >= limit:
                    best = min(best or (int(m.rank[piece]), i, k, piece), (int(m.rank[piece]), i, k, piece))
            if best is None:
                break
            _, i, k, piece = best
            symbols[k : k + 2] = [(i, piece)]
        for i, x in symbols:
            spelled = "▁" if word[i] == 0x110000 else chr(word[i])
            out += [x] if 0 <= x < m.size else [int(m.byte[v]) for v in spelled.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.4])
def test_as_written_down(merger, dropout):
    """Every candidate skipped by its own hash, one document after the other, whatever other words a block has."""
    texts = [*MARKED, "the international cat " * 30, "antidisestablishmentarianism " * 20]
    ids, at = encode(merger, texts, 5, dropout)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == written_down(merger, text, i, 5, dropout)


def test_a_very_long_word(merger):
    ids, at = encode(merger, ["abcde" * 40_000], 3, 0.1)
    assert merger.decode(ids, at)[0].tobytes().decode() == "abcde" * 40_000


def test_documents(edge, nothing):
    rows = pieces.encode_documents(edge).collect()
    assert len(rows) == edge.count() and all(r["lossless"] for r in rows)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    twins = [r["ids"] for r in rows if r["doc_id"] == 10]
    assert twins[0] == twins[1]
    assert pieces.encode_documents(nothing).count() == 0


def test_epochs_of_a_document_are_cut_apart(spark, nothing, edge):
    text = "international antidisestablishmentarianism unbelievable " * 20
    docs = spark.createDataFrame([(1, text), (1, text), (1, text + "more"), (2, text), (None, text), (None, text), (None, "x")], "doc_id long, text string")
    rows = pieces.encode_documents(docs, epochs=True).collect()
    assert sorted((r["doc_id"] or 0, r["epoch"]) for r in rows) == [(0, 0), (0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0)]
    assert all(r["lossless"] for r in rows)
    own = [tuple(r["ids"]) for r in rows if r["doc_id"] == 1 and r["n_bytes"] == len(text)]
    assert len(set(own)) == 2
    assert pieces.encode_documents(edge, epochs=True).count() == edge.count() and pieces.encode_documents(nothing, epochs=True).count() == 0


def test_a_missing_model_is_named():
    with pytest.raises(FileNotFoundError, match="no/such.model"):
        pieces.read_model("/no/such.model")
