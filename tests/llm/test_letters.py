"""Words without a letter have no script, in any block of Unicode."""

import pyarrow as pa

from textloom.llm import langid


def test_signs_and_digits_have_no_script():
    none = ["★★★", "😀", "5€", "٣٤", "12", "__"]
    some = ["5a", "word", "слово", "漢", "ไทย", "µ", "𐌰", "𠀀", "5é"]
    scripts = langid._scan(pa.array([*none, *some]))[1].tolist()
    assert scripts[: len(none)] == [-1] * len(none) and all(k >= 0 for k in scripts[len(none) :]) and len(scripts) == len(none) + len(some)
