from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.token_counts import Lengths, cuts_are_safe, default_model, parts, token_counts

SPACED = ["a", " ", "  ", "a b", " a b ", "a  b c", "▁ a ▁b▁ c d", "x ▁ y z", "one\ntwo three\n\nfour  five six", "\t a b c",
          "<s> text </s> <unk> <0x0A> more text", "日本語 の テキスト です", "日本語" * 50, "\U0001f600 \U0001f600 é a", "a\0 b\0c d",
          "word " * 40, " word" * 40, "x" * 300 + " y" * 30]


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def plain(processor, text):
    return len(processor.encode(text or ""))


def test_against_whole_texts(both, processor):
    rows = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    out = token_counts(both)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((d, len((t or "").encode()), n := plain(processor, t), n > 4096) for d, t in rows)
    assert Counter(map(tuple, out.collect())) == want
    assert any(o for *_, o in want) and any(n == 0 for _, _, n, _ in want)


@pytest.mark.parametrize("size", [1, 2, 5, 17, 100])
def test_parts_and_calls_change_no_count(processor, size, odd):
    texts = SPACED + [r.text or "" for r in odd.select("text").collect()]
    got = Lengths(default_model(), size * 3, size).of([t.encode() for t in texts])
    assert got.tolist() == [plain(processor, t) for t in texts]
    for t in texts:
        assert b" ".join(parts(t.encode(), size)) == t.encode()


def test_cuts(processor):
    assert parts(b"aa bb cc", 2) == [b"aa", b"bb", b"cc"]
    assert parts(b"aa  bb  cc", 2) == [b"aa  bb  cc"]
    assert cuts_are_safe(["▁a", "b", "▁▁"]) and not cuts_are_safe(["a▁b"])
    assert cuts_are_safe(processor.id_to_piece(list(range(processor.get_piece_size()))))


def test_very_long_texts(spark, processor):
    texts = ["lorem ipsum dolor " * 200_000, "日本語" * 20_000, "x" * 50_000]  # 3.6 MB, and two without a blank
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(df).collect()}
    assert got == {i: (len(t.encode()), plain(processor, t)) for i, t in enumerate(texts)}


def test_other_vocabulary(spark, odd):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts(odd, path=path).collect()) == want


def test_empty(empty):
    assert token_counts(empty).collect() == []
