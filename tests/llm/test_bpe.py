import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lignum.llm import bpe

PATH = bpe.default_path()


def texts():
    draw = random.Random(3)
    pool = "aeiouthn'sd  \n\t\r1290.,!?-_éßñ中文字😀́  \x1c\x85‍　ŒĐ٣"
    out = [None, "", " ", "  a", "a  ", "don't we'll I'M\n\n x", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "the " * 3000, "a" * 5000, "ab" * 3000 + " z"]
    return out + ["".join(draw.choice(pool) for _ in range(draw.randint(0, 60))) for _ in range(600)]


def test_like_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_tokens")
    got = {r.doc_id: r for r in bpe.digests(df, PATH, 500).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(df, PATH, 500).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, PATH, 500), PATH).collect()}
    for i, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want, repr(text)
        assert back[i] == (text or "") == library.decode(want, skip_special_tokens=False)
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_latin_texts_are_cut_alike():
    cut, every = bpe.splitter(), bpe.regex.compile(bpe.PATTERN).findall
    for c in range(bpe.LATIN_END + 16):
        for text in (chr(c), f"a{chr(c)}1 {chr(c)}{chr(c)} {chr(c)}", f"  {chr(c)}  x{chr(c)} ", f"'s{chr(c)}'re 1{chr(c)}"):
            assert cut(text) == every(text), repr(text)


@pytest.mark.parametrize("words", [{}, {b"a": [1]}, {b"": [5], b"a": [1]}])
def test_small_lexicons(words, tmp_path):
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(words))
    found = bpe.Lexicon(tmp_path / "lexicon")
    assert [found.find(w) for w in (b"", b"a", b"b")] == [words.get(b""), words.get(b"a"), None]


def test_new_pieces_are_merged_in_step(tmp_path, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    many = [*(t or "" for t in texts()), "x" * 48, "x" * 49, " " + "ab" * 60, "a b" * 50]
    pieces = sorted({p for t in many for p in bpe.splitter()(t)})
    short = [p.encode() for p in pieces if len(p.encode()) <= bpe.SHORT]
    words = {w: vocabulary.merge(w) for w in short[::7]}
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(tmp_path / "lexicon")
    length = bpe.np.array([len(w) for w in short])
    data = bpe.np.array([[*w, *bytes(bpe.SHORT - len(w))] for w in short], dtype=bpe.np.uint8)
    assert lexicon.find_all(data, length) == [words.get(w) for w in short]
    assert vocabulary.merge_all(data, length) == [vocabulary.merge(w) for w in short]

    library, one_by_one, merge = Tokenizer.from_file(PATH), [], vocabulary.merge
    monkeypatch.setattr(vocabulary, "merge", lambda piece: one_by_one.append(piece) or merge(piece))
    monkeypatch.setattr(bpe, "HELD", 500)
    monkeypatch.setattr(bpe, "KEPT", 40)
    got = list(bpe.Codec(vocabulary, lexicon).digests(many))
    assert all(len(p) > bpe.SHORT for p in one_by_one)
    for text, (n, ids, decoded) in zip(many, got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert n == len(want) and ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and decoded == hashlib.sha256(text.encode()).hexdigest()


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "x " * 100_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe.digests(df, PATH).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2] and got[0][1:] == got[1][1:] == got[2][1:]
    assert got[3][2] == hashlib.sha256(b"x " * 100_000).hexdigest()


def test_lexicon_shares_suffixes(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(f"{a}{b}{c}ing" for a in "abc" for b in "xyz" for c in "mno")}
    data = bpe.compile_lexicon(words)
    (tmp_path / "lexicon").write_bytes(data)
    found = bpe.Lexicon(tmp_path / "lexicon")
    assert all(found.find(w) == ids for w, ids in words.items()) and found.find(b"axming ") is None and found.find(b"ax") is None
    assert bpe.HEADER.unpack_from(data)[1] == 7  # one chain for all 27 words
