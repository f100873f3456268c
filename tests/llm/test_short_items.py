"""Short benchmark items at the end of one text, followed by another in the same batch."""

import random

from tracewell.llm import decontaminate as D
from llm.test_decontaminate import _text


def test_short_item_belongs_to_the_text_that_holds_it():
    rng = random.Random(7)
    for width in (8, 12, 16, 24, 32, 38, 45, 80, 100):
        item = D.normalise(_text(rng, 60).encode())[:width].strip()
        bench = D.Benchmark([(1, item)])
        for before in range(12):
            texts = [_text(rng, 20).encode(), f"{_text(rng, before)} ".encode() + item, _text(rng, 3).encode(), b"",
                     item + f" {_text(rng, 9)}".encode(), _text(rng, 2).encode()]
            assert [list(x) for x in D.leaks_of(texts, bench)] == [[], [0], [], [], [0], []]
