"""Lines are compared by numbers instead of strings; the similarity stays that of the sets of strings."""

import random

import numpy as np
import pytest

from inkveil.llm import line_dedup


def expected(a: str, b: str) -> bool:
    size = line_dedup.SHORT_SHINGLE if max(len(a), len(b)) < line_dedup.SHORT else line_dedup.SHINGLE
    return line_dedup.jaccard(line_dedup.shingles(a, size), line_dedup.shingles(b, size)) >= line_dedup.THRESHOLD


#: ASCII, Latin, a few other letters, more letters than bytes have values, and characters of the value zero.
ALPHABETS = ["abc ", "abà\xff ", "абв\U0001f600 ", "".join(map(chr, range(0x4E00, 0x4F90))), "\x00\x01a"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("most", [2, 1 << 20])
def test_numbers_stand_for_shingles(alphabet, most, monkeypatch):
    monkeypatch.setattr(line_dedup, "_SETS", most)
    monkeypatch.setattr(line_dedup, "_NUMBERS", most)
    rnd = random.Random(7)
    lines = {alphabet[0] * n for n in (1, 2, 3, 7, 8, 99, 100, 140)}
    for n in (1, 2, 4, 7, 8, 40, 97, 100, 150):
        line = [rnd.choice(alphabet) for _ in range(n)]
        for _ in range(5):
            lines.add("".join(line))
            line[rnd.randrange(n)] = rnd.choice(alphabet)
    lines = sorted(lines)
    sets = line_dedup.Sets(lines)
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            assert sets.similar(i, j) == expected(a, b), (a, b)
    for size in (line_dedup.SHORT_SHINGLE, line_dedup.SHINGLE):
        index = line_dedup.Index(line_dedup.Sets(lines), list(range(len(lines))), size)
        for k, a in enumerate(lines):
            whole = [j for j, b in enumerate(lines) if min(len(a), len(b)) >= size and line_dedup.jaccard(line_dedup.shingles(a, size), line_dedup.shingles(b, size)) >= 0.8]
            assert index.similar(k).tolist() == whole


def test_sets_are_ordered_numbers():
    sets = line_dedup.Sets(["abcabcabcabd", "x" * 200])
    for size, n in ((line_dedup.SHORT_SHINGLE, 4), (line_dedup.SHINGLE, 4)):
        made = sets.of(0, size)
        assert isinstance(made, np.ndarray) and len(made) == n and (made[1:] > made[:-1]).all()
    assert len(sets.of(1, line_dedup.SHINGLE)) == 1
