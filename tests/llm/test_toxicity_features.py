"""Rarer marks of toxic texts are learnt from."""

from __future__ import annotations

import numpy as np

from ledgerloom.llm import toxicity


def test_a_word_of_five_toxic_rows_counts():
    texts = [f"zork filler{k % 3}" if k < 5 else f"filler{k % 3}" for k in range(400)]
    sample = toxicity.Sample(texts)
    chosen = sample.telling(np.ones(400, bool), (np.arange(400) < 40).astype(float))
    assert "zork" in {sample.names[c] for c in chosen}
