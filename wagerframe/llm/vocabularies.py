"""Public tokenizers inside tasks, with caches that live as long as the Python worker."""

from __future__ import annotations

import re
import string
import struct
from functools import lru_cache

#: Entries of a generation of a cache; about 200 bytes each.
CACHE = 500_000
#: Longer pieces of text are tokenized but not kept.
KEPT_CHARS = 100
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation


@lru_cache(maxsize=4)
def load(name: str, path: str | None):
    """The tokenizer file ``path``, or the installed public tokenizer ``name`` where no path is given."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Tokenizer.from_file(path)


class Recent(dict):
    """A cache of two generations: when the young one is full it becomes the old one, which is dropped."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PreTokens:
    """Byte-level pre-tokens of texts, by the tokenizer's own normalizer and pre-tokenizer.

    Words of letters with ASCII punctuation behind them, which are most, split in
    one place; their letters are mapped by a table that was asked of the library
    letter by letter. Letters that do not map one to one are left to the library.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        mapped = {c: self.of_text(c) for c in map(chr, range(0x250)) if c.isalpha()}
        letters = {c: m[0] for c, m in mapped.items() if len(m) == 1}
        self.letters = {ord(c): m for c, m in letters.items()}
        self.known = re.compile(f"[{''.join(map(re.escape, letters))}]+")

    def of_text(self, text: str) -> list[str]:
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [mapped for mapped, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def of_plain_word(self, word: str) -> tuple[str, str] | None:
        """The mapped letters of a word and the marks behind them; None where the library must split it."""
        letters = word.rstrip(MARKS)
        if letters.isalpha() and (letters.isascii() or self.known.fullmatch(letters)):
            return letters.translate(self.letters), word[len(letters) :]
        return None


class Encoder:
    """Ids of whole texts, equal to ``tokenizer.encode(text, add_special_tokens=False).ids``.

    For byte-level tokenizers that split off words with at most one leading space
    and normalize nothing. Such a split falls between a space and what precedes
    it, unless the space has white space on both sides or ends the text; so other
    texts are cut at their spaces and each word is encoded once, whatever marks
    stand behind it; where the library splits off a single line feed, the words
    around it are encoded by themselves. Texts with those spaces or with an added
    token's string go to the library whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.pre_tokens = PreTokens(tokenizer)
        self.space = self.pre_tokens.of_text(" ")[0]
        self.maybe, self.whole = re.compile(r" \s"), re.compile(r"\s \s")
        self.words, self.starts = Recent(self._word), Recent(self._start)
        self.marks = Recent(self._any)
        self.feed = self._line_feed()
        letters = self.pre_tokens.letters
        self.plain_ascii = all(letters.get(ord(c)) == c for c in string.ascii_letters)

    def _line_feed(self) -> bytes | None:
        """Ids of a line feed, if it is a pre-token of its own between whatever is not white space."""
        of_text = self.pre_tokens.of_text
        ends = ["a", "A", "1", "é", "中", "'", *MARKS]
        alone = all(of_text(f"{a}\n{b}") == [*of_text(a), *of_text("\n"), *of_text(b)] for a in ends for b in ends)
        return self._any("\n") if alone else None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        odd = text.endswith(" ") or (self.maybe.search(text) and self.whole.search(text))
        if odd or any(added in text for added in self.pre_tokens.added):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        return self._any(first) + b"".join(map(self.words.__getitem__, rest))

    def _split(self, word: str, known: Recent) -> bytes | None:
        """Ids of a word put together from those of its lines, or of its letters and marks; None if it has neither."""
        letters = word.rstrip(MARKS)
        if letters.isalpha():
            if len(letters) < len(word) and (letters.isascii() or self.pre_tokens.known.fullmatch(letters)):
                return known[letters] + self.marks[word[len(letters) :]]
        elif self.feed is not None and "\n" in word:
            head, *lines = word.split("\n")
            # White space beside a line feed may belong to its pre-token.
            if head and all(lines) and not any(c.isspace() for line in (head, *lines) for c in (line[0], line[-1])):
                return known[head] + b"".join([self.feed + self.starts[line] for line in lines])
        return None

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space."""
        if word.isalpha() and word.isascii() and self.plain_ascii:
            return self._pre_token(self.space + word)
        ids = self._split(word, self.words)
        if ids is not None:
            return ids
        plain = self.pre_tokens.of_plain_word(word)
        return self._any(" " + word) if plain is None else self._pre_token(self.space + plain[0])

    def _start(self, word: str) -> bytes:
        """Ids of a word at the start of a line."""
        if word.isalpha() and word.isascii() and self.plain_ascii:
            return self._pre_token(word)
        ids = self._split(word, self.starts)
        return self._any(word) if ids is None else ids

    def _any(self, text: str) -> bytes:
        return b"".join(map(self._pre_token, self.pre_tokens.of_text(text))) if text else b""

    def _pre_token(self, mapped: str) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(mapped)])


@lru_cache(maxsize=2)
def encoder(name: str, path: str | None) -> Encoder:
    return Encoder(load(name, path))


class WordSplitter:
    """Pre-tokens of white-space separated words, and the number of pieces of a pre-token.

    For tokenizers whose normalizer and pre-tokenizer treat such words one by one
    and drop the white space. An added token's string inside a text is one piece;
    it is returned as the pre-token ``ADDED``.
    """

    ADDED = "\x00"  # no pre-token holds this character, as byte-level mapping replaces it

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.pre_tokens = PreTokens(tokenizer)
        self.added = re.compile("|".join(map(re.escape, self.pre_tokens.added))) if self.pre_tokens.added else None

    def split(self, word: str) -> list[str]:
        plain = self.pre_tokens.of_plain_word(word)
        if plain is not None:
            return [*plain] if plain[1] else [plain[0]]
        out: list[str] = []
        for k, part in enumerate(self.added.split(word) if self.added else [word]):
            if k:
                out.append(self.ADDED)
            if part:
                out += self.pre_tokens.of_text(part)
        return out

    def n_pieces(self, pre_token: str) -> int:
        return 1 if pre_token == self.ADDED else len(self.tokenizer.model.tokenize(pre_token))


@lru_cache(maxsize=2)
def word_splitter(name: str, path: str | None) -> WordSplitter:
    return WordSplitter(load(name, path))
