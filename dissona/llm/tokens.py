"""Token ids of whole texts by the tokenizers library, with a cache of words.

A byte-level BPE splits a text before each single space, and around each single line end, between two characters that aren't white
space, whatever stands around, so the ids of a text are those of its pieces between them in order. Pieces recur; each worker keeps the ids of those it has
seen, up to a bound, and asks the library's model only for new ones. A text that holds the content of an added token, and every
text under a tokenizer of another kind, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

CACHE = 600_000
_PIECE = re.compile(r"([^\W\d_]+)([.,;:!?%#*$&|()\[\]{}<>=+@^~/\\\"-]*)")
_coders: dict[str, Coder] = {}


def odd(c: str) -> bool:
    """White space, for any of the libraries at work."""
    return c.isspace() or c == "\u180e"


class Coder:
    """ids(text) are little-endian unsigned 32-bit ids, as bytes: those of the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]  # the library looks for these in the text itself
        self.regular = self.splits_at_spaces()
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and up
        rest = [b for b in range(256) if b not in kept]
        self.alphabet = {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}
        self.blank = chr(self.alphabet[32])
        self.packed = [np.uint32(i).astype("<u4").tobytes() for i in range(self.library.get_vocab_size())]
        self.line = self.whole("\n")
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def splits_at_spaces(self) -> bool:
        """Whether the file describes the byte-level BPE that this class knows the boundaries of."""
        known = json.loads(self.library.to_str())
        split, model = known["pre_tokenizer"] or {}, known["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        return known["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and model["type"] == "BPE" and plain

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def unit(self, text: str, space: str = "") -> bytes:
        """Of one pre-token without a space, or with the one before it."""
        mapped = space + (text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])

    def marks(self, text: str) -> bytes:
        if (out := self.units.get(text)) is None:
            out = self.units[text] = self.unit(text)
        return out

    def piece(self, text: str, space: bool) -> bytes:
        """Of a piece that regular boundaries enclose; letters, then marks, are two pre-tokens at most."""
        letters, marks = text, ""
        if not text.isalpha():
            m = _PIECE.fullmatch(text)
            if not m or not m[1].isalpha():
                return self.whole(" " + text if space else text)
            letters, marks = m.groups()
        if not space:
            return self.unit(letters) + (self.marks(marks) if marks else b"")
        if (out := self.pieces.get(letters)) is None:
            out = self.pieces[letters] = self.unit(letters, self.blank)
        return out + self.marks(marks) if marks else out

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.regular or any(t in text for t in self.added):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")  # a line's first word goes with the line end before it
        if not first or odd(first[-1]) or odd(first[0]):
            return self.irregular(text)
        known = self.pieces
        found = list(map(known.get, rest))
        try:
            return self.piece(first, False) + b"".join(found)
        except TypeError:  # some aren't known
            pass
        for i, x in enumerate(found):
            if x is None:
                w = rest[i]
                if (x := known.get(w)) is None:
                    if w.isalpha():
                        x = self.unit(w, self.blank)
                    elif not w or odd(w[-1]) or odd(w[0]) and (w[0] != "\n" or odd(w[1])):
                        return self.irregular(text)  # such pieces are never kept, so they are always noticed here
                    else:
                        x = self.line + self.piece(w[1:], False) if w[0] == "\n" else self.piece(w, True)
                    known[w] = x
                found[i] = x
        self.bound()
        return self.piece(first, False) + b"".join(found)

    def bound(self) -> None:
        """Forgets the later half when full: what came early comes often."""
        for cache in (self.pieces, self.units):
            if len(cache) > CACHE:
                for k in list(cache)[CACHE // 2 :]:
                    del cache[k]

    def irregular(self, text: str) -> bytes:
        """Joins pieces next to other white space before they are encoded."""
        runs: list[list[str]] = []
        before = " "
        for x in text.split(" "):
            if runs and x and not odd(x[0]) and before and not odd(before[-1]):
                runs.append([x])
            elif runs:
                runs[-1].append(x)
            else:
                runs.append([x])
            before = x
        return b"".join(self.whole(("" if i == 0 else " ") + " ".join(r)) if len(r) > 1 or i == 0 or any(map(odd, r[0])) else self.piece(r[0], True) for i, r in enumerate(runs))


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
