import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm.words import Block, blocks, find_words, hash_words, lower_ascii, lower_latin


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t.,🙂x", max_size=30)), st.integers(1, 40))
def test_words_of_blocks_are_those_of_split(texts, limit):
    got, seen = [], {}
    for block in blocks(pa.array(texts, pa.string()), limit):
        words = find_words(block)
        hashes = hash_words(block.data, words)
        for i in range(len(block)):
            own = [bytes(block.data[a:b]).decode() for a, b in zip(words.start[words.first[i] : words.first[i + 1]], words.end[words.first[i] : words.first[i + 1]])]
            got.append(own)
            for w, h in zip(own, hashes[words.first[i] : words.first[i + 1]].tolist()):
                assert seen.setdefault(w, h) == h
    assert got == [[w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w] for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_nulls_slices_and_case():
    column = pa.array(["x", None, "Yé É"], pa.string()).slice(1)
    (block,) = blocks(column)
    assert block.offsets.tolist() == [0, 0, 6]
    assert bytes(lower_ascii(block.data)).decode() == "yé É" and bytes(lower_latin(block.data)).decode() == "yé é"
    assert list(blocks(pa.array([], pa.string()))) == []
    words = find_words(Block(0, 1, np.zeros(0, np.uint8), np.array([0, 0])))
    assert len(words.start) == 0 and words.first.tolist() == [0, 0]
