"""Words hash alike however the blocks of bytes fall."""

import random

import numpy as np

from modsplit_spark.llm import wordhash


def test_blocks_do_not_change_hashes(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \té") for _ in range(rng.randrange(400))).encode() for _ in range(60)] + [b"", b" ", b"x" * 5000, b"end"]
    whole = wordhash.word_hashes(texts)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(wordhash, "BLOCK_BYTES", size)
        assert all(np.array_equal(x, y) for x, y in zip(whole[:4], wordhash.word_hashes(texts)[:4], strict=True))
    words, owner, start, end, buffer = whole
    seen = {buffer[i:j]: h for i, j, h in zip(start.tolist(), end.tolist(), words.tolist(), strict=True)}
    assert len(set(seen.values())) == len(seen) and all(seen[buffer[i:j]] == h for i, j, h in zip(start.tolist(), end.tolist(), words.tolist(), strict=True))
