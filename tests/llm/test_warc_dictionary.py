"""Archives of few, long records have a dictionary too."""

import io
import random
import struct

import pytest
import zstandard

from riskcard.llm import warc


@pytest.mark.parametrize("n,size", [(42, 400_000), (1, 3_000_000), (7, 3_000), (8, 20_000)])
def test_few_long_records_have_a_dictionary(n, size):
    rnd = random.Random(n)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 12))) for _ in range(2000)]
    recs = []
    for i in range(n):
        text = " ".join(rnd.choices(words, k=size // 7)).encode()
        recs.append(warc.record(i, f"http://x/{i}", text, None))
    data = warc.archive(recs)
    magic, length = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE
    assert zstandard.ZstdCompressionDict(data[8: 8 + length]).dict_id() != 0
    assert [b for _, b in warc.records_of(io.BytesIO(data))] == [r[r.index(b"\r\n\r\n") + 4: -4] for r in recs]


def test_small_and_uniform_archives_have_none():
    assert warc.dictionary([b"x" * 3_000] * 6) is None
    assert warc.dictionary([b""]) is None
