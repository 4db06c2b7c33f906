"""What a packing worker remembers stays small, and forgetting changes no ids."""

import sys

from gapscope.llm import bpe, packing
from gapscope.llm.queries import vocabulary


def test_chunks_in_memory_are_few_and_small():
    known = bpe.memo(vocabulary(), "bytes of a test", lambda _, ids: bytes(4 * len(ids)), packing.LibraryBpe, packing.MEMO_CHUNKS)
    for k in range(250_000):
        known[f"w{k}"]
    assert len(known) <= packing.MEMO_CHUNKS
    assert sys.getsizeof(known) + sum(sys.getsizeof(c) + sys.getsizeof(b) for c, b in known.items()) < 24 << 20


def test_forgotten_chunks_give_the_same_ids():
    path, text = vocabulary(), "alpha beta, gamma alpha! delta beta, alpha " * 5
    encoder = bpe.encoder(path, packing.LibraryBpe)
    small = bpe.Memo(lambda chunk: encoder.chunk(chunk), 2)
    assert [i for c in encoder.split(text) for i in small[c]] == encoder.encode(text) and len(small) <= 2


def test_a_word_is_merged_once_whatever_its_case_and_marks():
    encoder, merged = packing.LibraryBpe(vocabulary()), []
    word = encoder.word
    encoder.word = lambda w: merged.append(w) or word(w)
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in str(k)) for k in range(200_000)]
    for form in (str, str.title, "{},".format, "{}.".format):
        known = bpe.Memo(encoder.packed, packing.MEMO_CHUNKS)
        for w in words:
            known[form(w)]
    assert len(merged) == len(words) + 2


def test_packed_chunks_are_the_ids():
    encoder = packing.LibraryBpe(vocabulary())
    chunks = ["Word", "word&&&", "don't", "it's,", "'s", "\u212aelvin", "\u212bngstr\u00f6m", "\u0130stanbul", "e\u0301t\u00e9.", "\u00e9t\u00e9's", "\u00c9T\u00c9!?"]
    chunks += ["\u039f\u03a3", "\u039f\u03a3.", "a<|endoftext|>b.", "<|startoftext|>", "x<", "abc\u037e", "12a.", "a1", "\u00aa\u00ba\u00b5", "--", "na\u00efve\u0301,", "\ud83d\ude00a".encode("utf-16", "surrogatepass").decode("utf-16"), "\u4e2d\u6587."]
    for chunk in chunks:
        ids = encoder.chunk(chunk)
        assert encoder.packed(chunk) == b"".join(i.to_bytes(4, "little") for i in ids), chunk
