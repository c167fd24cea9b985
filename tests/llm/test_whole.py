"""Passages that ordinary characters hide."""

from __future__ import annotations

import pytest

from pkgloom.llm.leakage import plain, word_lists


@pytest.mark.parametrize("accent", ["", " é"])
def test_control_characters_in_words(accent):
    for k in range(128):
        x = chr(k)
        if x in " \t\n\v\f\r" or x.isprintable():
            continue
        assert plain(f"The la{x}zy dog{accent}") == f"the lazy dog{accent}"
    assert word_lists(f"sk\x01\x7fips la\x01\x7fzy \x1cdogs{accent}")[0][:3] == ["skips", "lazy", "dogs"]
