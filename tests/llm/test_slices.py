"""Work over whole slices of texts: the same as word by word, without a call for each word."""

import hashlib
import random
import sys

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from skarn.llm import packing, substring_dedup


def _calls(f):
    """How many calls of functions, Python's and C's, ``f`` makes."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_substring_slices_equal_single_windows_without_a_call_a_word():
    r = random.Random(17)
    blanks = [" ", "  ", "\n", "\t\r", "\x0b\x0c", " \n "]
    odd = ["x" * n for n in (7, 8, 9, 255, 256, 257, 1000)] + ["é" * 3, "日本語のことば", "a\xa0b", "\x1c", "\x00", "\x00\x00", "\x85", " "]
    texts = [None, "", " ", "\n\t", "a", *("".join(r.choice(odd + list("abcde")) + r.choice(blanks) for _ in range(n)) for n in (12, 13, 14, 60, 400, 0, 30))]
    texts += [" " + texts[-1], "a " * 40, "x" * 300 + " " + "b " * 20]
    column = pa.array(["out", *texts, "out"]).slice(1, len(texts))
    got = substring_dedup.Slice(column, 13)
    words = [(t or "").encode().split() for t in texts]
    assert got.counts.tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    by = dict(zip(flat, got.h.tolist()))
    assert [by[w] for w in flat] == got.h.tolist() and len(set(by.values())) == len(by)
    assert got.texts.tolist() == [i for i, w in enumerate(words) if len(w) >= 13]
    assert got.digests() == [hashlib.blake2b(b" ".join(words[i]), digest_size=16).digest() for i in got.texts]
    windows = {}
    for text, anchor, first, last in zip(*(x.tolist() for x in got.anchored(13))):
        for i in range(first, last + 1):
            at = i - int(got.first[text])
            assert windows.setdefault((int(got.texts[text]), at), anchor) == anchor and last - first < 9
    # every window has an anchor, and equal windows have the same one
    assert sorted(windows) == [(i, a) for i, w in enumerate(words) for a in range(len(w) - 12)]
    anchors = {}
    for (i, a), anchor in windows.items():
        assert anchors.setdefault(tuple(words[i][a : a + 13]), anchor) == anchor
    # the work of a task isn't a call for each word
    long = pa.array([" ".join(f"w{r.randrange(10**6)}" for _ in range(20_000))])
    assert _calls(lambda: substring_dedup.Slice(long, 13).anchored(13)) < 500


def test_packing_ids_of_slices_equal_the_tokenizers_without_a_call_a_word():
    r = random.Random(19)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, ids = Tokenizer.from_file(path), packing.WordIds(path, 1)
    odd = ["Don't", "'s", "it's", "<|endoftext|>", "<|ENDOFTEXT|>", "ab<|endoftext|>.", "<|", "|>", "é", "e\u0301", "É", "ß", "ÿ", "÷", "×", "日本語", "ΑΣ", "İ", "\u0301", "x1", "_", "\x00", "\x1c", "\x85", "a\xa0b", "\u2028", "ﬁ", "***", ".,", "...", "'", '"', "<", ">", "|", "=", "\u0338", "the", "Erlying", "QUE"]
    blanks = ["", "", "", " ", "\n", "\t\r", "\x0b\x0c", "  "]
    for seed in range(40):
        texts = [None, "", " \n"] + ["".join(r.choice(odd) + r.choice(blanks) for _ in range(r.randrange(60))) for _ in range(12)]
        r.shuffle(texts)
        if seed == 20:
            ids.reset()
        column = pa.array(["out", *texts, "out"]).slice(1, len(texts))
        got, counts = ids.documents(column)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        assert got.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
    got, counts = ids.documents(pa.array([None, None], pa.string()))
    assert got.tolist() == [1, 1] and counts.tolist() == [1, 1]
    # words met before, bare or with marks after them, cost no call
    long = pa.array([" ".join(r.choice(["the", "que", "erlying"]) + r.choice(["", ".", ",***", "!?"]) for _ in range(20_000))])
    ids.documents(long)
    assert _calls(lambda: ids.documents(long)) < 500
