"""What a packing worker keeps of the words it has met."""

import numpy as np

from pitloom.llm import packing, queries


def test_words_held_are_bounded():
    """Texts of half a million different words, then again: the same ids, and no more words held than a worker may keep beside the JVM."""
    tokens, seen = packing.Tokens(queries.tokenizer_path()), []
    for at in [*range(0, 500_000, 100_000), 0]:
        buf = np.frombuffer(" ".join(f"w{i}" for i in range(at, at + 100_000)).encode(), np.uint8)
        seen.append(tokens.ids(buf, np.array([0, len(buf)]))[0])
        assert len(tokens.hashes) <= 400_000
    assert np.array_equal(seen[0], seen[-1])
