"""Ids of texts from a lower-casing vocabulary with word ends, by white-space units and a bounded cache."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

from tickerloom.llm.tokens import _byte_letters, vocabulary_path

#: Units of a generation of the cache, of which two are kept.
CACHE_UNITS = 300_000
#: Characters of a text that are encoded at once.
SLICE = 1 << 20


class UnitEncoder:
    """A whole text to ids, a slice at a time, as the vocabulary file's own pipeline gives them.

    Such a vocabulary drops white space, and no piece, composition or merge reaches across it, so every unit between
    spaces and newlines is encoded alone and looked up from then on. Units of letters, bare or before
    a comma or full stop, go to the merge model directly; all others through the whole pipeline. Latin-1
    texts are lower-cased first, where that can't change a composition. A file with another pipeline
    is encoded text by text.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        conf = json.loads(self.tokenizer.to_str())
        kinds = [n.get("type") for n in (conf.get("normalizer") or {}).get("normalizers", [])]
        pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_unit = (kinds == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
                        and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and "\\s" in str(pre[0].get("pattern"))
                        and not pre[1].get("add_prefix_space") and conf["model"].get("end_of_word_suffix"))
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.cache_units = cache_units
        self.units: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _unit(self, unit: str, latin: bool) -> bytes:
        if not latin:
            return self._whole(unit)
        if unit.isalpha():
            return self._letters(unit)
        if unit[-1] in ",." and unit[:-1].isalpha():
            return self._look_up(unit[:-1], True) + self._look_up(unit[-1], False)
        return self._whole(unit)

    def _look_up(self, unit: str, latin: bool) -> bytes:
        got = self.units.get(unit)
        if got is None:
            got = self.older.get(unit)
            got = self.units[unit] = self._unit(unit, latin) if got is None else got
        return got

    def _slice(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            latin, text = True, text.lower()
        except UnicodeEncodeError:
            latin = False
        if len(self.units) > self.cache_units:
            self.units, self.older = {"": b""}, self.units
        units = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.units.__getitem__, units))
        except KeyError:
            for unit in set(units).difference(self.units):
                self._look_up(unit, latin)
            return b"".join(map(self.units.__getitem__, units))

    def slices(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, of one stretch of the text after the other."""
        text = text or ""
        if not self.by_unit:
            yield self._whole(text)
            return
        at = 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):  # up to the next space
                end = min((p for p in (text.find(" ", end), text.find("\n", end)) if p >= 0), default=len(text))
            yield self._slice(text if not at and end >= len(text) else text[at:end])
            at = end


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def unit_encoder(path: str, cache_units: int = CACHE_UNITS) -> UnitEncoder:
    """The encoder of this Python worker, kept from task to task."""
    key = (vocabulary_path(path), cache_units)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(*key)
    return _ENCODERS[key]
