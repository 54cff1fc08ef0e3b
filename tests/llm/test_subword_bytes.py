"""The subword encoder reads the bytes of words where Arrow holds them."""

import pyarrow as pa

from sluice.llm import subwords


def test_stems_of_a_part_of_an_array_use_its_own_bytes():
    words = pa.array(["first,", "كلمة.", "", "plain", "x!!", "12,"])
    for part in (words, words.slice(1, 4), words.slice(3), words.slice(2, 1)):
        stem, close = subwords._stem_and_close(part)
        assert [a + b for a, b in zip(stem.to_pylist(), close.to_pylist(), strict=True)] == part.to_pylist()
        assert subwords._bytes_of(part).tobytes().decode() == "".join(part.to_pylist())
