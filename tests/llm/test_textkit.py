import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import textkit as tk

TEXT = st.text(alphabet="ab \n\té.A", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
def test_words_and_hashes(texts, limit):
    seen, by_hash = [], {}
    for lo, hi, data, offsets in tk.chunks(pa.array(texts, pa.string()), limit):
        starts, ends, bounds = tk.word_spans(data, offsets)
        hashes = tk.Hasher(data).spans(starts, ends)
        for t in range(hi - lo):
            words = [bytes(data[a:b]) for a, b in zip(starts[bounds[t] : bounds[t + 1]], ends[bounds[t] : bounds[t + 1]], strict=True)]
            seen.append(words)
        for a, b, h in zip(starts, ends, hashes, strict=True):
            assert by_hash.setdefault(int(h), bytes(data[a:b])) == bytes(data[a:b])
    assert seen == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert len(by_hash) == len({w for x in seen for w in x})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=50), st.integers(1, 12))
def test_sliding_min(values, width):
    x = np.array(values, dtype=np.uint64)
    assert tk.sliding_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_sliced_batches():
    whole = pa.array(["aa", None, "bb cc", ""]).slice(1)
    assert [(lo, hi, bytes(d)) for lo, hi, d, _ in tk.chunks(whole)] == [(0, 3, b"bb cc")]
