"""Which of a text's capitalised words are names: a token automaton over lexicon classes.

A trie holds the lexicon's entries of one and more words. A run of capitalised words is walked once through it, which gives
each word its classes and finds compound surnames and places. Then every word is a wall (ends a name), a part of a
name, or a link (a particle that joins a given name with what follows). Stretches between walls of two to four words
are names if enough of their words are evidence: one in prose, two elsewhere, where a single one is a suspect.

Words around the run decide too. What stands before it is read backwards in blocks that grow (``words_before``), only as far as the
decision needs, so a name costs what is read and not the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from .lexicon import BIT, LONGEST

GIVEN, SURNAME, COMMON, ENTITY, SITE, PLACE, PARTICLE, ARTICLE, QUALIFIER, ACRONYM, AMBIGUOUS, JOB = BIT.values()
NAME = GIVEN | SURNAME

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_WORD = rf"[{_UP}][{_LOW}]*['’][{_UP}][{_LOW}]+|[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*"
_LINK = r"(?:de|di|da|del|della|dello|degli|van|von|der|den|la|lo)"
_RUN = re.compile(rf"(?<![\w{{])(?:{_WORD})(?:[ \t](?:(?:{_LINK}[ \t]){{0,2}}(?:{_WORD})))*(?![\w}}])")
_LOUD = re.compile(rf"(?<![\w{{])[{_UP}]{{3,}}(?:[ \t](?:DE|DI|DA|LO|LA|[{_UP}]{{3,}})){{1,3}}(?![\w}}])")
#: How every capitalised word begins, and an apostrophe inside one.
_BEGINS = re.compile(rf"[{_UP}][{_UP}{_LOW}]*")
_ELIDED = re.compile(rf"['’][{_UP}]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SHORT_FORM = re.compile(rf"(?<![\w.])([{_UP}][{_UP}.]{{1,11}})[ \t]*$")
_EDGES = "'’-.,;:"
MOST_WORDS = 4
#: How far back the words before a run of several names are read at most: what touches it.
TOUCHING = 120
#: Endings of nouns and adjectives: a lone word that ends so is no evidence, whatever the lexicon says.
_ENDINGS = (
    "zione", "zioni", "sione", "mento", "menti", "aggio", "anza", "enza", "ismo", "ista", "isti", "tore", "trice", "ezza", "orio", "ario", "evole",
    "logia", "grafia", "metro", "tion", "sion", "ness", "ment", "ship", "ology", "ography",
)


def bare(token: str) -> str:
    return token.lower().strip(_EDGES)


class Trie:
    """Entries of one or more words with the bits of their classes."""

    def __init__(self, entries: Mapping[str, int]):
        self.root: dict = {}
        for entry, bits in entries.items():
            node = self.root
            for word in entry.split(" "):
                node = node.setdefault(word, {})
            node[""] = node.get("", 0) | bits

    def one(self, word: str) -> int:
        return self.root.get(word, {}).get("", 0)

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(from, to, bits) of every entry of two or more words, in one walk over ``words``."""
        for i, word in enumerate(words):
            node, j = self.root.get(word), i + 1
            while node is not None and j < len(words) and j - i < LONGEST:
                node = node.get(words[j])
                j += 1
                if node and "" in node:
                    yield i, j, node[""]


def words_before(text: str, at: int, block: int = 64) -> Iterator[tuple[str, int, int]]:
    """(word, from, to) of the words of letters before ``at``, the nearest first.

    Blocks of 64 characters, then four times as many, and so on, are read as they are asked for; a word cut by a block's
    edge is read whole.
    """
    end = at
    while end > 0:
        start = max(0, end - block)
        # a block never begins inside a word
        while start > 0 and text[start].isalpha() and text[start - 1].isalpha():
            start -= 1
        for m in reversed(list(_LETTERS.finditer(text, start, end))):
            yield m[0], m.start(), m.end()
        end, block = start, block * 4


@dataclass(frozen=True)
class Found:
    decision: str
    start: int
    end: int
    why: str = ""


class Grammar:
    def __init__(self, entries: Mapping[str, int]):
        self.trie = Trie(entries)
        self.begins = frozenset(e.split("-")[0] for e, bits in entries.items() if bits & NAME and " " not in e)

    def may_hold(self, text: str) -> bool:
        """Whether a capitalised word of the text begins as a listed name does, or has an apostrophe: without one nothing is found, as only such
        words are evidence, and what else counts in a name stands beside one."""
        if not self.begins.isdisjoint(w.lower() for w in _BEGINS.findall(text)):
            return True
        return _ELIDED.search(text) is not None

    # ---- words around

    def _site(self, word: str) -> bool:
        return bool(self.trie.one(word) & (SITE | ENTITY))

    def _acronym(self, token: str) -> bool:
        plain = token.strip(_EDGES + "()[]").replace(".", "")
        return len(plain) >= 2 and plain.isupper() and bool(self.trie.one(plain.lower()) & ACRONYM)

    def _short_form_before(self, text: str, at: int) -> bool:
        m = _SHORT_FORM.search(text[max(0, at - 24) : at])
        return m is not None and self._acronym(m[1])

    def named_after(self, text: str, at: int) -> bool:
        """A building, event or institution touches the run of names at ``at``: only letters, blanks and apostrophes lie between."""
        if self._short_form_before(text, at):
            return True
        last, article = at, False
        for word, start, end in words_before(text, at):
            if start < at - TOUCHING or text[end:last].strip(" \t'’"):
                return self._short_form_before(text, last)
            low = word.lower()
            bits = self.trie.one(low)
            if bits & (SITE | ENTITY):
                return True
            if self._acronym(word) and not article:
                return True
            if bits & ARTICLE:
                article = True
            elif not (word[0].isupper() or bits & QUALIFIER):
                return False
            last = start
        return self._short_form_before(text, last)

    def alone_named_after(self, text: str, at: int) -> bool:
        """As ``named_after`` for one name, the weakest sign: first back through the capitalised words that touch it, then the last word
        that is neither article nor qualifier decides, whatever lies between."""
        if self._short_form_before(text, at):
            return True
        last, climbing = at, True
        for word, start, end in words_before(text, at):
            low = word.lower()
            bits = self.trie.one(low)
            climbing = climbing and word[0].isupper() and not text[end:last].strip(" \t'’-")
            if climbing:
                if bits & (SITE | ENTITY) or self._acronym(word):
                    return True
                last = start
            elif not bits & (ARTICLE | QUALIFIER):
                return bool(bits & (SITE | ENTITY))
        return False

    def entity_after(self, text: str, at: int) -> bool:
        """Among the capitalised words that follow is one of an institution or building."""
        for m in re.compile(r"[^\W\d_]+|\S").finditer(text, at):
            if not m[0][0].isupper():
                return False
            if self._site(m[0].lower()):
                return True
        return False

    # ---- runs

    def _apostrophe(self, word: str) -> int:
        """Classes of a surname with an elided particle: D'Amico is found as damico, or by what follows the apostrophe."""
        parts = re.split("['’]", word)
        if len(parts) != 2 or not parts[1] or not (self.trie.one(parts[0]) & PARTICLE or parts[0] in ("d", "l", "dell", "dall", "sant")):
            return 0
        return SURNAME if self.trie.one("".join(parts)) & SURNAME or self.trie.one(parts[1]) & NAME else 0

    def _classes(self, words: list[str]) -> tuple[list[int], list[bool], dict[int, int]]:
        """Per word its bits and whether a place covers it; compound surnames by the place of their first word: where they end."""
        bits = [self.trie.one(w) or self._apostrophe(w) for w in words]
        place, compound = [False] * len(words), {}
        for i, j, b in self.trie.spans(words):
            if b & PLACE:
                place[i:j] = [True] * (j - i)
            if b & SURNAME:
                compound[i] = max(j, compound.get(i, 0))
        for i in range(len(words) - 1):
            if bits[i] & PARTICLE and self.trie.one(words[i] + words[i + 1]) & SURNAME:
                compound[i] = max(i + 2, compound.get(i, 0))
        return bits, place, compound

    def decide(self, run: str, prose: bool | None = None, text: str | None = None, at: int = 0) -> list[Found]:
        """What the words of a run are: stretches that are names, suspects or parts of a place; ``at`` is where it begins in ``text``."""
        tokens = list(re.finditer(r"\S+", run))
        words = [bare(t[0]) for t in tokens]
        bits, place, compound = self._classes(words)
        places = [Found("place", t.start(), t.end()) for t, p in zip(tokens, place, strict=True) if p]
        head = re.split("['’]", words[0])[0]
        if any(b & ENTITY for b in bits) or self.trie.one(head) & (SITE | ENTITY) or self._acronym(tokens[0][0]):
            return places
        upper = [t[0][0].isupper() for t in tokens]
        wall = [p or bool(b & COMMON) or not u for b, p, u in zip(bits, place, upper, strict=True)]
        evidence = [bool(b & NAME) and not w for b, w in zip(bits, wall, strict=True)]
        given = lambda k: 0 <= k < len(words) and not wall[k] and bool(bits[k] & GIVEN)
        # a surname that is also a common word counts behind a name: Tommaso Gentile, but not Gentile Cliente
        for k in range(1, len(words)):
            if wall[k] and not place[k] and upper[k] and bits[k] & SURNAME and not wall[k - 1] and bits[k - 1] & NAME:
                wall[k], evidence[k] = False, True
        # particles join only what has a given name beside it, and are no evidence themselves
        k = 0
        while k < len(words) - 1:
            end = compound.get(k, 0)
            joins = bits[k] & PARTICLE and given(k - 1) and not wall[k + 1] and (upper[k] or bits[k + 1] & NAME)
            if end and not any(place[k:end]) and (given(k - 1) or given(end)):
                wall[k:end] = [False] * (end - k)
                evidence[k:end] = [False] * (end - k - 1) + [True]
                k = end
            else:
                if joins and not place[k]:
                    wall[k] = evidence[k] = False
                k += 1
        found, k = places, 0
        while k < len(words):
            if wall[k]:
                k += 1
                continue
            end = k
            while end < len(words) and not wall[end]:
                end += 1
            hits, start, stop = sum(evidence[k:end]), tokens[k].start(), tokens[end - 1].end()
            if 2 <= end - k <= MOST_WORDS + any(i in compound for i in range(k, end)):
                if hits >= (1 if prose else 2):
                    if text is None or not self.named_after(text, at + start):
                        found.append(Found("replace", start, stop))
                elif hits == 1:
                    found.append(Found("suspect", start, stop, "one word is a name"))
            k = end
        return found

    def decide_alone(self, word: str, alone: bool, text: str, start: int, end: int) -> str:
        """What a single listed word is: replace, suspect or leave."""
        low = bare(word)
        bits = self.trie.one(low)
        if len(low) < 4 or bits & (AMBIGUOUS | COMMON) or not bits & NAME or low.endswith(_ENDINGS):
            return "leave"
        if alone and bits & GIVEN and not self.alone_named_after(text, start) and not self.entity_after(text, end):
            return "replace"
        return "suspect"

    def find(self, text: str, prose: bool | None = None, alone: bool = False) -> list[Found]:
        """All names and suspects of a text, in order, none inside a placeholder or another."""
        found: list[Found] = []
        taken = [(m.start(), m.end()) for m in re.finditer(r"\{\{[^{}]*\}\}", text)]
        for pattern in (_RUN, _LOUD):
            for m in pattern.finditer(text):
                if " " in m[0] or "\t" in m[0]:
                    found += [Found(f.decision, m.start() + f.start, m.start() + f.end, f.why) for f in self.decide(m[0], prose, text, m.start())]
        taken = sorted(taken + [(f.start, f.end) for f in found])
        k = 0
        for m in re.finditer(rf"(?<![\w{{])(?:{_WORD})(?![\w}}])", text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k < len(taken) and taken[k][0] < m.end():
                continue
            decision = self.decide_alone(m[0], alone, text, m.start(), m.end())
            if decision != "leave":
                found.append(Found(decision, m.start(), m.end(), "a listed name with nothing around it"))
        return sorted((f for f in found if f.decision != "place"), key=lambda f: f.start)

    # ---- names that a label, a title or an address points at

    def trim_tail(self, tokens: list[str]) -> int:
        """How many of ``tokens`` stay when common words at the end go; a surname that is also a common word stays behind a name."""
        words, n = [bare(t) for t in tokens], len(tokens)
        while n:
            bits, place, compound = self._classes(words[:n])
            if not (bits[-1] & COMMON or place[-1]):
                break
            if n >= 2 and not place[-1] and (
                bits[-1] & SURNAME and bits[-2] & NAME and not bits[-2] & COMMON
                or any(end == n for end in compound.values())
                or (n >= 3 and bits[-2] & PARTICLE and bits[-1] & NAME and bits[-3] & NAME)
            ):
                break
            n -= 1
        return n
