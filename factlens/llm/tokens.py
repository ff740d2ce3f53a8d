"""Token ids of whole texts by the tokenizers library, with each distinct chunk encoded once while it is remembered.

A text is cut only where the tokenizer itself always cuts, so the ids are those of the whole text:

* spaces kept (byte-level pattern, no normaliser): before a single blank or newline that stands between two
  non-space characters. A pre-token that begins at a non-space character never runs into white space.
* spaces dropped (white space is removed by the pre-tokenizer): at every blank or newline.

Any other tokenizer gets the whole text, and so does a text that holds an added token of the vocabulary (special tokens
stand for themselves in a text, as the library has it).
"""

from __future__ import annotations

import array
import json
import os
import re

_ODD = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Stripped from a chunk's end, where a run of punctuation after a letter is a pre-token of its own.
_PUNCTUATION = ".,;:!?#$%&*|"


class _Memo(dict):
    """Ids by chunk. Two generations: a chunk that is not asked for while `keep` others come is forgotten."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key: str) -> bytes:
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "kept"
    first = (pre.get("pretokenizers") or [{}])[0]
    if pre.get("type") == "Sequence" and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" in str(first.get("pattern")):
        return "dropped"
    return "whole"


def _lowers(path: str) -> bool:
    """Whether the normaliser leaves white-space-free words of precomposed Latin letters as they are, but for lower case."""
    with open(path, encoding="utf-8") as f:
        steps = (json.load(f).get("normalizer") or {}).get("normalizers") or []
    return [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": r"\s+"}


class ChunkEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.kind = "whole" if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added) else _kind(path)
        self.letters = _byte_letters()
        self.lowers = _lowers(path)
        self.tokenize = self.tok.model.tokenize
        self.bare = _Memo(lambda k: self._chunk(k, ""), keep // 4 if self.kind == "kept" else keep * 3 // 4)
        self.led = _Memo(lambda k: self._chunk(k, " "), keep)  # chunks with a blank before them
        assert array.array("I").itemsize == 4

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, key: str, lead: str) -> bytes:
        base = key.rstrip(_PUNCTUATION)
        if base and base.isalpha() and max(base) < "\u0250" and "\u0130" not in base:  # one pre-token, and perhaps one of punctuation (U+0130 gains a mark in lower case)
            if base != key:
                return (self.led if lead else self.bare)[base] + self.bare[key[len(base) :]]
            word = lead + key if self.kind == "kept" else key.lower() if self.lowers else self.tok.normalizer.normalize_str(key)
            if lead or not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            return array.array("I", [t.id for t in self.tokenize(word)]).tobytes()
        return self._ids([lead + key])[0] if key or lead else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self._ids(texts)
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if not whole:
            return self._encode(texts)
        out = self._encode(["" if any(x in t for x in self.added) else t for t in texts])
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain, blank, join, out = self.bare.__getitem__, self.led.__getitem__, b"".join, []
        if self.kind == "dropped":
            return [join(map(plain, t.replace("\n", " ").split(" "))) for t in texts]
        newline = plain("\n")
        for t in texts:
            lines = t.split("\n")
            odd = not t or t[0] in " \n" or t[-1] in " \n" or "  " in t or " \n" in t or "\n " in t or "\n\n" in t
            if odd or not all(map(str.isprintable, lines)) and _ODD.search(t):
                out.append(join(map(plain, _CUT.split(t))) if t else b"")
                continue
            done = []
            for x in lines:
                words = iter(x.split(" "))
                done.append(plain(next(words)) + join(map(blank, words)))
            out.append(newline.join(done))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees this worker's encoders, where a later stage does not encode."""
    _ENCODERS.clear()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
