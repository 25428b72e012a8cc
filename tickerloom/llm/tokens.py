"""Ids of whole texts from a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Sequence

import regex

#: Name of the default vocabulary file; its place is looked up where a task runs.
VOCABULARY = "byte_bpe_50k.json"
#: Words of a generation of the cache, of which two are kept, some 200 bytes a word: as a rule, for workers that hold other
#: large arrays, and for those that hold little else.
CACHE_WORDS, SMALL_CACHE, LARGE_CACHE = 800_000, 120_000, 1_200_000

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same of printable ASCII, where the letters, digits and white space are these.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+| +(?![^ ])| +")
#: Marks that end words; an apostrophe may begin a piece of letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD = re.compile(r" (?:\s|\Z)")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter: those that print stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Ids of words, without line breaks; one not held yet moves up from the generation before or is spelled out."""

    def __init__(self, spell: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.spell, self.older = spell, older

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:  # two words as a rule, and a pair seldom comes again
            return self.spell(" " + word)
        got = self.older.get(word)
        got = self[word] = self.spell(" " + word) if got is None else got
        return got


class Encoder:
    """Whole texts to ids, as the vocabulary file's own pipeline gives them.

    For a byte-level vocabulary without a normaliser, text falls apart into pieces that the merge
    model treats alone, and a single space before a word always begins a piece. So each distinct
    word is encoded once and looked up from then on. Other vocabularies and texts with runs of
    spaces go through the whole pipeline.
    """

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        conf = json.loads(self.tokenizer.to_str())
        pre = conf.get("pre_tokenizer") or {}
        self.by_word = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                        and conf.get("normalizer") is None and conf["model"]["type"] == "BPE")
        self.cache_words = cache_words
        self.letters = _byte_letters()
        self.space = self.letters[ord(" ")]
        self.numbers = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.words = _Words(self._pieces, {})  # the word with a space before it
        self.others: dict[str, bytes] = {}  # pieces without a space
        self.model = self.tokenizer.model

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # of these only the space has another letter
            spelled = piece.replace(" ", self.space)
        else:
            spelled = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([self.numbers[t.id] for t in self.model.tokenize(spelled)])

    def _known(self, piece: str) -> bytes:
        held, key = (self.words, piece[1:]) if piece[0] == " " and len(piece) > 1 else (self.others, piece)
        got = held.get(key)
        if got is None:
            got = held.older.get(key) if held is self.words else None
            got = held[key] = self._piece(piece) if got is None else got
        return got

    def _pieces(self, text: str) -> bytes:
        if "\n" in text:
            before, mid, after = text.partition("\n")
            if before and after and not before[-1].isspace() and after.isprintable() and after[0] != " ":
                return self._pieces(before) + self._known(mid) + self._pieces(after)
        stem = text.rstrip(_MARKS)
        letters = stem[1:] if stem[:1] == " " else stem
        if letters.isalpha() and (letters.isascii() or max(letters) < "\u0100"):  # one piece, and the marks another
            if len(stem) < len(text):
                return self._known(stem) + self._known(text[len(stem):])
            return self._piece(text) if text[0] == " " else self._known(text)
        plain = text.isascii() and text.isprintable()
        return b"".join(map(self._known, (_PLAIN if plain else _PIECES).findall(text)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null is an empty text."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if not self.by_word or _ODD.search(text):
                out.append(self._whole(text))
                continue
            if len(self.words) > self.cache_words:
                older, self.words.older = self.words, {}
                self.words = _Words(self._pieces, older)
            if len(self.others) > self.cache_words:
                self.others.clear()
            first, *rest = text.split(" ")
            tail = b"".join(map(self.words.__getitem__, rest))
            out.append(self._pieces(first) + tail if first else tail)
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str | None = None, cache_words: int = CACHE_WORDS) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    key = (vocabulary_path(path), cache_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
