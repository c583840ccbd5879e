"""The sentence automaton takes time in proportion to the text."""

import time

import pytest

from dyadlens.llm.sentences import sentences


@pytest.mark.parametrize("unit", ["Mr. Abc ", "(", "(] ", '"a ', "- 1. x\n", "Dr. \n- ", "。「", "etc. 3 ", "„x“ y "])
def test_twice_the_text_takes_about_twice_the_time(unit):
    took = []
    for n in (4_000, 16_000):
        t = time.perf_counter()
        sentences("Start " + unit * n)
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0] + 0.15
