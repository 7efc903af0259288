"""Lines of large groups are looked up in an index; the components are those of all pairs."""

import random

import pytest

from inkveil.llm import line_dedup


def by_all_pairs(names, lines):
    sets, root = line_dedup.Sets(lines), list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if sets.similar(i, j):
                root[find(i)] = find(j)
    found = {}
    for i, name in enumerate(names):
        found.setdefault(find(i), set()).add(name)
    return sorted(sorted(v) for v in found.values() if len(v) > 1)


@pytest.mark.parametrize("seed", range(8))
def test_components_of_a_large_group(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(30)]
    # short and long lines, and lines about as long as the bound between them
    templates = [[rnd.choice(words) for _ in range(n)] for n in (1, 8, 16, 17, 30)]
    lines = {"a", "a b"}
    for _ in range(200):
        line = list(rnd.choice(templates))
        for _ in range(rnd.randint(0, 3)):
            line[rnd.randrange(len(line))] = rnd.choice(words)
        lines.add(" ".join(line))
    lines = sorted(lines)
    rnd.shuffle(lines)
    names = [b"%04d" % i for i in range(len(lines))]
    rnd.shuffle(names)
    assert len(lines) > line_dedup._MANY
    found = {}
    for least, name in line_dedup.linked(names, lines):
        assert least < name
        found.setdefault(least, {least}).add(name)
    assert sorted(sorted(v) for v in found.values()) == by_all_pairs(names, lines)
