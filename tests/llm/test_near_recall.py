"""Recall of the near-dedup's candidates for pairs of 0.80 to 0.85 shared five-word shingles, by kind of change and length.

Texts that repeat themselves or have words replaced are found. New words at the end, or a missing end, change as large a share of word pairs
as of shingles; ten fingerprints at 4 bits find about half of such pairs there (README), and 6 bits, which cost more buckets, nine of ten.
"""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import simhash

WORDS = [f"w{i}" for i in range(3000)]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def changed(kind, base, rng):
    words = list(base)
    if kind == "repeated beginning":
        return words + words[: rng.randint(2, len(words))] * rng.randint(1, 3)
    if kind == "appended":
        return words + [rng.choice(WORDS) for _ in range(rng.randint(1, max(1, len(words) // 4)))]
    if kind == "cut":
        return words[: -rng.randint(1, max(1, len(words) // 4))]
    for _ in range(rng.randint(1, max(1, len(words) // 40))):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


@pytest.mark.parametrize("length", [(15, 30), (30, 60), (60, 300)])
@pytest.mark.parametrize(("kind", "radius"), [("repeated beginning", 4), ("replaced", 4), ("replaced", 5), ("appended", 6), ("cut", 6)])
def test_recall(kind, radius, length):
    if (kind, radius, length) == ("replaced", 4, (15, 30)) or (kind, length) == ("repeated beginning", (60, 300)):
        pytest.skip("one replaced word in so few is a large change; a repeat in a long text leaves more than 0.85")
    rng, pairs = random.Random(f"{kind}{length}"), []
    while len(pairs) < 150:
        base = [rng.choice(WORDS) for _ in range(rng.randint(*length))]
        other = changed(kind, base, rng)
        a, b = shingles(base), shingles(other)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs.append((base, other))
    prints = simhash.pair_prints(pa.array([" ".join(w) for pair in pairs for w in pair]))
    near = (np.bitwise_count(prints[::2] ^ prints[1::2]) <= radius).any(axis=1)
    assert near.mean() >= (0.9 if radius < 6 else 0.88)
