import numpy as np
import pyarrow as pa

from loomspark.llm import textkernel
from loomspark.llm.terms import Terms


def test_a_word_hashes_alike_wherever_it_stands():
    """In texts of many blocks, on the edges of these, and when it is longer than one itself."""
    long, other = "x" * (textkernel.BLOCK + 7), "x" * (textkernel.BLOCK + 8)
    words = ["a", "word", "ünï", "wörd" * 50, long, other, "y" * (3 * textkernel.BLOCK)]
    alone = {w: textkernel.Words(pa.array([w])).hash[0] for w in words}
    assert len(set(alone.values())) == len(words)
    rnd = np.random.default_rng(4)
    picked = [words[k] for k in rnd.choice(len(words), 60_000, p=[0.3, 0.3, 0.2, 0.1999, 0.00004, 0.00003, 0.00003])] + words
    got = textkernel.Words(pa.array(["a word", " ".join(picked), None, "ünï"]))
    want = [alone[w] for w in ["a", "word", *picked, "ünï"]]
    assert got.hash.tolist() == want
    assert got.first.tolist() == [0, 2, 2 + len(picked), 2 + len(picked), 3 + len(picked)]


def test_windows_over_blocks_are_those_of_short_texts():
    words = [f"w{k % 997}" for k in range(120_000)]
    at, hashes = textkernel.Words(pa.array([" ".join(words)])).runs(13)
    assert len(at) == len(words) - 12
    for k in (0, 1, 40_000, 65_535, len(at) - 1):
        assert textkernel.Words(pa.array([" ".join(words[k : k + 13])])).runs(13)[1][0] == hashes[k]


def test_terms_end_with_their_rows():
    got = Terms(pa.array(["ab", "AB c", "", None, "é-é", "9"]))
    assert got.first.tolist() == [0, 1, 3, 3, 3, 5, 6]
    assert got.hash[0] == got.hash[1] and got.hash[3] == got.hash[4]
    row, term, count = got.counted(np.sort(got.hash[[0, 3]].view(np.int64)))
    assert list(zip(row.tolist(), count.tolist())) == [(0, 1), (1, 1), (4, 2)]
