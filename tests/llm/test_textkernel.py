import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from eigenweave.llm import textkernel as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n\x0b.ñ-0", max_size=30)), max_size=8)


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_words(texts):
    buf, offsets = K.utf8(pa.array(texts, pa.string()))
    starts, ends, first = K.words(buf, offsets)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    want = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    h = K.word_hashes(buf, starts, ends)
    names = {}
    for w, x in zip([w for ws in want for w in ws], h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    s, at = K.shingles(h, first, 3)
    for k, ws in enumerate(want):
        n = len(ws) - 2 if len(ws) >= 3 else int(bool(ws))
        assert at[k + 1] - at[k] == n


def test_shingles_tell_short_from_long():
    buf, offsets = K.utf8(pa.array(["a b", "a b c", "c a b", "a b"]))
    starts, ends, first = K.words(buf, offsets)
    s, at = K.shingles(K.word_hashes(buf, starts, ends), first, 3)
    assert s[0] == s[3] and len({int(s[0]), int(s[1]), int(s[2])}) == 3


def test_long_words_cross_blocks():
    word = "x" * (K._BLOCK + 5)
    buf, offsets = K.utf8(pa.array([f"a {word} b", word]))
    starts, ends, _ = K.words(buf, offsets)
    h = K.word_hashes(buf, starts, ends)
    assert h[1] == h[3] and h[0] != h[2]
