import numpy as np
from llm_cases import WORD

from leakscope.llm import words as W


def distinct(values):
    return {v: k for k, v in enumerate(dict.fromkeys(values))}


def test_words_are_told_apart_like_strings():
    text = "a bb\x0bbb\ta\x0c\rccc \x1f \xa0 é\n a"
    found = WORD.findall(text)
    got = W.word_hashes(text.encode()).tolist()
    assert len(got) == len(found)
    assert len(set(got)) == len(set(found))
    assert len(set(zip(got, found, strict=True))) == len(set(found))


def test_slices_and_groups_cover_everything(monkeypatch):
    whole = ("word " * 50 + "x" * 400 + " end").encode()
    want = W.word_hashes(whole)
    monkeypatch.setattr(W, "SLICE", 64)
    assert b"".join(W.slices(whole)) == whole
    assert (W.word_hashes(whole) == want).all()
    texts = [b"", b"a b", whole, b"c"]
    ranges = list(W.groups(texts))
    assert [k for lo, hi in ranges for k in range(lo, hi)] == [0, 1, 2, 3]


def test_many_texts_like_one_by_one():
    texts = [b"a b c", b"", b"  ", b"b", b"a b"]
    hashes, counts = W.many_word_hashes(texts)
    assert counts.tolist() == [3, 0, 0, 1, 2]
    assert (hashes == np.concatenate([W.word_hashes(t) for t in texts])).all()


def test_grams_equal_only_for_equal_words():
    rng = np.random.default_rng(0)
    names = [f"t{k}" for k in rng.integers(0, 3, 300)]
    got = W.grams(W.word_hashes(" ".join(names).encode()), 4).tolist()
    want = [tuple(names[k : k + 4]) for k in range(len(names) - 3)]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))
    assert len(W.grams(np.zeros(3, np.uint64), 4)) == 0


def test_lower_touches_ascii_only():
    assert W.lower("ÀBz".encode()) == "Àbz".encode()
