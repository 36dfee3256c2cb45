"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import pytest

from atomweave.llm import sentence_pieces as S

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return S.Codec(*S.read_model(PATH))


ODD = ["", " ", "  ", "a", " a ", "a  b", "a\tb\r\n\n c", "▁", "a▁b▁▁c", "▁ ▁", "<s> x</s>", "<unk>", "<0x41>", "\x00a", "ﬁ é é", "😀👩‍👩‍👧", "　x", "�", "日本語のテキスト", "สวัสดี", "ааааа", "𝔘𝔫𝔦", "\U0010fffd", "x" * 300, "ab" * 700, " " * 15, "\n" * 40, "a" + " " * 31 + "b", "0123456789" * 9]


def test_odd_texts(library, codec):
    for t in ODD:
        ids = codec.encode([t])[0].tolist()
        assert ids == library.encode(t), t
        assert codec.decode(ids) == library.decode(ids), t


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(library, codec, seed):
    rnd = random.Random(seed)
    pieces = [p.replace(S.MARK, " ") for p in codec.v.pieces[259:]]
    short = [p for p in pieces if len(p) <= 3]
    kinds = [
        lambda: "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 60))),
        lambda: "".join(rnd.choice(short) for _ in range(rnd.randint(1, 90))),
        lambda: "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 80))),
        lambda: "".join(rnd.choice("aeiouty ") for _ in range(rnd.randint(1, 200))),
        lambda: "".join(rnd.choice(" \n▁x") for _ in range(rnd.randint(1, 120))),
        lambda: "".join(chr(rnd.choice([rnd.randrange(32, 0x2FFF), rnd.randrange(0xE000, 0x10FFFF), 32])) for _ in range(rnd.randint(1, 60))),
    ]
    texts = [rnd.choice(kinds)() for _ in range(1500)]
    got = [i.tolist() for i in codec.encode(texts)]
    want = library.encode(texts)
    for t, a, b in zip(texts, got, want, strict=True):
        assert a == b, t
    assert [codec.decode(i) for i in got] == library.decode(want)


@pytest.mark.parametrize("seed", range(3))
def test_random_identifiers(library, codec, seed):
    """Identifiers that no text gives: bytes that aren't characters, control and unknown pieces."""
    rnd = random.Random(seed)
    for _ in range(800):
        ids = [rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(3, 259), rnd.randrange(259, 32000), 28705]) for _ in range(rnd.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_long_words_by_the_agenda(library):
    """A low bound sends every word with a hasty piece to the agenda."""
    c, rnd = S.Codec(*S.read_model(PATH), long=2), random.Random(1)
    texts = ["".join(rnd.choice(["the", "in", "er", "  ", "a", "▁▁▁", "on"]) for _ in range(40)) for _ in range(400)]
    assert [i.tolist() for i in c.encode(texts)] == library.encode(texts)


def small(scores):
    """A vocabulary of byte pieces, the mark, the letters and the given pieces."""
    names = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), *scores, S.MARK, *"abc"]
    kinds = [S.UNKNOWN, S.CONTROL, S.CONTROL, *[S.BYTE] * 256, *[S.NORMAL] * (len(scores) + 4)]
    return S.Codec(names, [0.0] * 259 + list(scores.values()) + [-100.0, -101.0, -102.0, -103.0], kinds)


@pytest.mark.parametrize("seed", range(4))
def test_vocabularies_whose_scores_are_out_of_order(seed):
    """Merged pieces that grow at once, ties, and overlaps: rounds and agenda agree with single merges done naively."""
    rnd = random.Random(seed)
    for _ in range(40):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 4))) for _ in range(12)}
        pieces |= {p[:2] for p in pieces}
        c = small({p: float(-rnd.randint(1, 12)) for p in sorted(pieces)})
        words = [S.MARK + "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14))) for _ in range(60)]
        ids, ends = S.merge_rounds(c.v, words)
        for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True):
            got = ids[a:b].tolist()
            sym = list(w)
            while True:
                best = min(((c.v.rank[c.v.id[a + b]], k) for k, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a + b in c.v.id and a in c.v.id and b in c.v.id), default=None)
                if best is None:
                    break
                sym[best[1] : best[1] + 2] = [sym[best[1]] + sym[best[1] + 1]]
            want = [i for s in sym for i in ([c.v.id[s]] if s in c.v.id else c.v.byte[list(s.encode())].tolist())]
            assert got == want
            assert [s for _, s in S.agenda(c.v, c.v.symbols(S.np.array([ord(x) for x in w], S.np.uint32)).tolist())] == [c.v.id.get(s, len(c.v.pieces)) for s in sym]


def test_a_million_spaces_and_letters(library, codec):
    for t in (" " * 300_000, "ab" * 150_000, "é́x" * 50_000):
        assert codec.encode([t])[0].tolist() == library.encode(t)


@pytest.mark.parametrize("together", [1, 7, 60])
def test_texts_cut_between_words(library, monkeypatch, together):
    monkeypatch.setattr(S, "TOGETHER", together)
    c, texts = S.Codec(*S.read_model(PATH)), [*ODD, "the cat  sat on the mat again", "x" * 100 + " the cat", "", "the", "▁ a  b   c"]
    assert [i.tolist() for i in c.encode(texts)] == library.encode(texts)


def test_queries(spark, library):
    texts = [None, *ODD, "same", "same"]
    d = spark.createDataFrame([(None if k == 3 else k % 30, t, "x", k, "y") for k, t in enumerate(texts)], "doc_id long, text string, value string, ids int, n_tokens string").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        want.append((None if k == 3 else k % 30, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, S.round_trip(d, PATH).collect()), key=key) == sorted(want, key=key)
    got = S.decode_ids(S.encode_texts(d, PATH), PATH)
    assert sorted(sha(r.text) for r in got.collect()) == sorted(r[3] for r in want)
    assert S.round_trip(d.limit(0), PATH).count() == 0


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in S.round_trip(docs, PATH).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
