import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm.text import blocks, count_words, hash_texts

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé日 \t\n\x0b\x0c\r\xa0\x1c", max_size=12)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 20))
def test_words_are_those_of_bytes_split(values, limit):
    array = pa.array(["xx", *values], pa.string()).slice(1)
    found = [[] for _ in values]
    for b in blocks(array, limit):
        for s, e, o in zip(*b.words(), strict=True):
            found[b.first + o].append(b.data[s:e].tobytes())
    assert found == [(v or "").encode().split() for v in values]
    assert count_words(array).tolist() == [len(f) for f in found]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_hashes_tell_texts_apart(values):
    array = pa.array(values, pa.string())
    plain, folded = hash_texts(array), hash_texts(array, fold=True)
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            assert (plain[i] == plain[j]) == ((a or "") == (b or ""))
            assert (folded[i] == folded[j]) == ((a or "").encode().lower().split() == (b or "").encode().lower().split())
