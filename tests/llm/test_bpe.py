import random

import pytest

from daygrid.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_same_ids_with_any_lexicon(make, reference, size):
    rng = random.Random(size)
    texts = ["", None, "aaaaaaaaaaaa aaaa", "<|endoftext|>x <|endoftext|>", "日本語 😀😀 x́ \n\n  \t z  ", "   ", "don't I'LL we'll",
             "　x \x85y", "٣٤٥ ½ Ⅷ", "ab" * 20000, "the cat " * 3000, "the cat", "the cat"]
    texts += ["".join(rng.choice("abé <|endoftx>.\n'sTH0123") for _ in range(200)) for _ in range(60)]
    docs = make(list(enumerate(texts)))
    rows = bpe.encode(docs, bpe.send_lexicon(docs, bpe.tokenizer_path(), size)).collect()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = reference.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == reference.decode(ids, skip_special_tokens=False) == text


def test_empty_table_and_digests(no_docs, edge_docs):
    name = bpe.send_lexicon(no_docs, bpe.tokenizer_path())
    assert bpe.token_digests(bpe.encode(no_docs, name)).count() == 0
    assert bpe.token_digests(bpe.encode(edge_docs, name)).count() == 11


def test_transducer_ranks_and_shared_suffixes():
    words = sorted({bytes(random.Random(i).choices(b"abc\xff\x00", k=1 + i % 6)) for i in range(400)} | {b"walking", b"talking"})
    arrays = bpe.build_transducer(words)
    assert bpe.look_up(words, *arrays).tolist() == list(range(len(words)))
    assert bpe.look_up([b"", b"zzz", b"walk", b"walkings"], *arrays).tolist() == [-1] * 4
    both = bpe.build_transducer([b"talking", b"walking"])
    assert len(both[3]) == 8  # one chain of states behind two first letters
