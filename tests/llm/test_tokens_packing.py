"""Token counts and packing against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import awkward_rows

from tarn.llm import entry, packing, tokens
from tarn.llm.packing import pack_lengths

PIECES, WORDS = public_tokenizers.path(entry.PIECES), public_tokenizers.path(entry.WORD_BPE)


def greedy(word: str, vocab: set[str], most: int) -> int:
    n = i = 0
    while i < len(word):
        for j in range(min(len(word), i + most), i, -1):
            if word[i:j] in vocab:
                n, i = n + 1, j
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=9), st.text("abcdé", max_size=15))
def test_automaton_equals_greedy_matching(vocab, word):
    assert tokens.LongestMatch(vocab).count(word) == greedy(word, vocab, 5)


def count_all(text, vocab, most):
    words = (text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    return len(words), sum(greedy(tokens.START + w, vocab, most) for w in words)


def test_counts_of_real_and_awkward_texts(spark, documents, awkward, empty, clashing):
    vocab = set(tokens.vocabulary(PIECES))
    most = max(map(len, vocab))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.token_counts(documents, PIECES).collect()}
    assert got == {r.doc_id: count_all(r.text, vocab, most) for r in documents.collect()}
    expected = sorted((str(r[0]), *count_all(r[1], vocab, most)) for r in awkward_rows())
    for df in (awkward, clashing):
        assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in tokens.token_counts(df, PIECES).collect()) == expected
    assert tokens.token_counts(empty, PIECES).count() == 0


lengths = st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12)


@settings(max_examples=200, deadline=None)
@given(lengths)
def test_lengths_are_packed_whole(counts):
    back: dict[int, int] = {}
    for held, many in pack_lengths(counts, 30):
        assert sum(a * b for a, b in held) <= 30 and many > 0
        assert sum(b for a, b in held if 3 * a > 30) <= 2
        for a, b in held:
            back[a] = back.get(a, 0) + b * many
    assert back == counts


def test_large_lengths_pair_with_the_longest_that_fits():
    assert sorted(pack_lengths({20: 1, 15: 1, 11: 1, 10: 1}, 30)) == [(((15, 1), (11, 1)), 1), (((20, 1), (10, 1)), 1)]
    assert pack_lengths({15: 5}, 30)[0] == (((15, 2),), 2)
    with pytest.raises(ValueError, match="outside"):
        pack_lengths({31: 1}, 30)


def test_few_sequences():
    pick = random.Random(4)
    counts: dict[int, int] = {}
    for _ in range(20_000):
        k = min(4096, int(pick.lognormvariate(6.3, 1)) + 1)
        counts[k] = counts.get(k, 0) + 1
    n = sum(m for _, m in pack_lengths(counts, 4096))
    assert n <= 1.001 * sum(k * v for k, v in counts.items()) / 4096 + 1


def checked_pieces(df, texts: dict, capacity: int = 4096):
    """Holds a packing against ids of whole texts; texts by doc_id, whose rows must be alike."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    rows = df.toPandas()
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        ends = group.offset + group.length
        assert list(group.offset) == [0, *ends[:-1]] and ends.iloc[-1] <= capacity
    seen = {}
    for r in rows.itertuples():
        seen.setdefault(None if r.doc_id != r.doc_id else r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.piece))
    expected: dict = {}
    for doc, text in texts:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.setdefault(doc, []).extend((s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes()), k) for k, s in enumerate(range(0, len(ids), capacity)))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in expected.items()}
    return rows


def test_packing_of_real_texts(documents):
    rows = checked_pieces(packing.pack(documents, WORDS), [(r.doc_id, r.text) for r in documents.collect()])
    assert rows.sequence_id.nunique() <= rows.length.sum() // 4096 + 2


def test_packing_of_awkward_texts(awkward, clashing, empty):
    for df in (awkward, clashing):
        checked_pieces(packing.pack(df, WORDS), [(r[0], r[1]) for r in awkward_rows()])
    assert packing.pack(empty, WORDS).count() == 0


def test_sequences_hold_the_ids(documents):
    from tokenizers import Tokenizer

    packed = packing.pack(documents, WORDS, with_ids=True)
    held = packing.sequences(packed).collect()
    model, texts = Tokenizer.from_file(WORDS), {r.doc_id: r.text for r in documents.collect()}
    parts: dict = {}
    for r in held:
        assert len(r.ids) <= 4096
        for doc, start, end in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)], strict=True):
            parts.setdefault(doc, []).append(r.ids[start:end])
    for doc, text in texts.items():
        ids = [*model.encode(text, add_special_tokens=False).ids, 1]
        assert sorted(map(tuple, parts[doc])) == sorted(tuple(ids[i : i + 4096]) for i in range(0, len(ids), 4096))


def test_words_are_encoded_as_in_a_text():
    import pyarrow as pa

    pick, encode = random.Random(3), packing._Encoder(WORDS)
    encode.MOST = 2000
    letters = "क़가abÉéİßΣς'd12.,!#–日ǅ́s<|>"
    words = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 7))) for _ in range(5000)]
    words += ["x" * 100 + ",", "long" + "!" * 100, "!" * 100, "<|endoftext|>", "a<|endoftext|>b,", "<|startoftext|><|endoftext|>.", "<|ENDOFTEXT|>", "<|endoftext|", "Word<|startoftext|>!!"]
    for _ in range(2):
        flat, starts, first, second = encode(pa.array(words))
        cut = lambda k: flat[starts[k] : starts[k + 1]].tolist()
        assert [cut(a) + cut(b) for a, b in zip(first, second, strict=True)] == [encode.model.encode(x, add_special_tokens=False).ids for x in words]


def test_strings_of_special_tokens(spark):
    """They give the special tokens' ids, alone, within words and beside white space, as in the whole text."""
    texts = ["<|endoftext|>", "one <|startoftext|> two", "a<|endoftext|>b c", "<|startoftext|><|endoftext|>", "x\n<|endoftext|>\t y.", "Tail<|endoftext|>,", "<|endoftext| >"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    checked_pieces(packing.pack(df, WORDS), list(enumerate(texts)))


def packed_plainly(lengths: list[int], capacity: int) -> int:
    """The number of sequences by loops over single pieces: pairs of large ones, then best fit, longest first."""
    large, gaps = sorted((x for x in lengths if 3 * x > capacity), reverse=True), []
    while large:
        a = large.pop(0)
        fits = [i for i, b in enumerate(large) if a + b <= capacity]
        gaps.append(capacity - a - (large.pop(fits[0]) if fits else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= x), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(capacity - x)
        else:
            gaps[at] -= x
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(lengths)
def test_as_many_sequences_as_by_single_pieces(counts):
    one_by_one = packed_plainly([k for k, v in counts.items() for _ in range(v)], 30)
    assert sum(many for _, many in pack_lengths(counts, 30)) == one_by_one


def test_as_many_sequences_as_by_single_pieces_of_real_texts(documents):
    rows = packing.pack(documents, WORDS).toPandas()
    assert rows.sequence_id.nunique() == packed_plainly(rows.length.tolist(), 4096)


def test_one_length_for_all_rows(spark):
    """Ranks stay gapless when one length has all rows and is dealt into shares."""
    df = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "100L AS length")
    got = packing.place(df).toPandas()
    assert got.sequence_id.nunique() == 75 and sorted(set(got.offset)) == [100 * i for i in range(40)]
    assert not got.duplicated(["sequence_id", "offset"]).any()
