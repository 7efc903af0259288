"""Families of near copies with own edits: lines that are like no other must not cost a comparison with all of them, or one by one."""

import random

from inkveil.llm import line_dedup
from inkveil.llm.line_dedup import Index, Sets, jaccard, linked, shingles


def family(copies: int, apart: int, words: int = 60) -> list[str]:
    """Lines that have no partner before copies of one line with one other word; all have words of the same line."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(words)]

    def edited(n: int) -> str:
        own = base[:]
        for i in r.sample(range(words), n):
            own[i] = word()
        return " ".join(own)

    return [*[edited(words // 5) for _ in range(apart)], *[edited(1) for _ in range(copies)]]


def components(lines: list[str], found: list[tuple[bytes, bytes]]) -> dict[int, int]:
    least = {int(b): int(a) for a, b in found}
    return {i: least.get(i, i) for i in range(len(lines))}


def brute(lines: list[str]) -> dict[int, int]:
    sets, root = [shingles(x) for x in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return dict(enumerate(root))


def names(lines: list[str]) -> list[bytes]:
    return [f"{i:04}".encode() for i in range(len(lines))]


def counted(monkeypatch, kind, name: str) -> list:
    calls, method = [], getattr(kind, name)
    monkeypatch.setattr(kind, name, lambda self, *a: calls.append(a) or method(self, *a))
    return calls


def test_copies_are_not_looked_up(monkeypatch):
    lines = family(copies=150, apart=20)
    looked_up = counted(monkeypatch, Index, "similar")
    assert components(lines, linked(names(lines), lines)) == brute(lines)
    assert len(looked_up) <= 21  # one of the copies, and the lines without partner


def test_many_characters_are_not_compared_one_by_one(monkeypatch):
    monkeypatch.setattr(line_dedup, "_INDEXED", 20_000)
    lines = family(copies=150, apart=20)
    assert sum(map(len, lines)) > 3 * 20_000
    compared, built = counted(monkeypatch, Sets, "similar"), counted(monkeypatch, Index, "__init__")
    assert components(lines, linked(names(lines), lines)) == brute(lines)
    assert len(compared) == 0
    assert all(sum(len(lines[i]) for i in members) <= 20_000 + 2 * max(map(len, lines)) for _, members, _ in built)


def test_rare_and_frequent_shingles_count_together():
    lines = family(copies=60, apart=0) + family(copies=2, apart=8, words=50) + ["z" * 90, "short"]
    sets = Sets(lines)
    index = Index(sets, list(range(len(lines))), 8)
    for k, line in enumerate(lines[:-1]):
        own = shingles(line)
        assert index.similar(k).tolist() == [j for j, other in enumerate(lines) if len(other) >= 8 and jaccard(own, shingles(other)) >= 0.8]
