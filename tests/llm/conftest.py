import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SYLLABLES = ["an", "the", "in", "ou", "re", "on", "er", "st", "É", "ñ", "ing"]


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences: prose(seed, words)."""

    def make(seed, n):
        chance = random.Random(seed)
        return " ".join("".join(chance.choices(SYLLABLES, k=chance.randint(1, 4))) for _ in range(n))

    return make
