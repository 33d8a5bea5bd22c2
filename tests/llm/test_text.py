import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from topiclake.llm.text import ALNUM, LOWER, SOLID, Words, buffers, large, slices

ALPHABET = st.text(st.sampled_from("aB9 \t\n-é中😀."), max_size=30)
AZ = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SPLITS = {"solid": (SOLID, r"[^\x20\x09-\x0D]+"), "alnum": (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in SPLITS.values():
        data, offsets = buffers(large(pa.array(texts, pa.string())))
        lower = LOWER[data]
        words = Words(lower, offsets, table)
        found = [lower[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
        expected = [re.findall(pattern, (t or "").translate(AZ)) for t in texts]
        assert found == [w for e in expected for w in e]
        assert words.counts.tolist() == [len(e) for e in expected]
        same = {}
        for word, hash_ in zip(found, words.hashes().tolist()):
            assert same.setdefault(word, hash_) == hash_
        assert len(set(same.values())) == len(same)


def test_slices_cover_all_rows_and_bytes():
    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else "x" * rng.randrange(50) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"n": list(range(200)), "t": texts}).slice(7, 180)
    seen = []
    for rows, data, offsets in slices(batch, "t", 100):
        assert rows.num_rows == 1 or len(data) <= 100
        for n, a, b in zip(rows.column(0).to_pylist(), offsets[:-1], offsets[1:]):
            seen.append((n, data[a:b].tobytes().decode()))
    assert seen == [(i, texts[i] or "") for i in range(7, 187)]
