"""Per-word memory for tokenizers whose tokens never cross the start of a word.

Where a tokenizer splits before every space that follows a non-space, the tokens of a text are
those of its words, each with the space before it. Texts repeat words, so a worker process keeps
the result of each word. Memory is bounded: two generations of at most ``limit`` short words.
"""

from __future__ import annotations

from collections.abc import Callable

#: Words in one generation of the memory, and the longest word that is kept.
LIMIT = 400_000
LONGEST = 48


class Unsplittable(Exception):
    """A text has white space next to a space, so plain splitting would cut a run of white space."""


class Words(dict):
    """word -> value; a value is computed when a word is first met.

    ``at_edge`` tells words after which a text may not be cut; they raise ``Unsplittable``.
    """

    def __init__(self, compute: Callable[[str], object], at_edge: Callable[[str], bool], limit: int = LIMIT):
        super().__init__()
        self.compute, self.at_edge, self.limit, self.older = compute, at_edge, limit, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            if self.at_edge(word):
                raise Unsplittable
            value = self.compute(word)
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


def ends_open(word: str) -> bool:
    """Whether the space after this word belongs to a longer run of white space."""
    return not word or word[-1].isspace()


def lines_of(word: str) -> list[str] | None:
    """The parts of a word between its line ends, if each line end is white space by itself; else nothing."""
    if "\n" not in word:
        return None
    parts = word.split("\n")
    if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        return None
    return parts


def chunks(text: str) -> list[str]:
    """The text cut before each space that follows a character other than white space."""
    out, chunk = [], None
    for word in text.split(" "):
        if chunk is None:
            chunk = word
        elif ends_open(chunk):
            chunk += " " + word
        else:
            out.append(chunk)
            chunk = " " + word
    return out + [chunk] if chunk else out
