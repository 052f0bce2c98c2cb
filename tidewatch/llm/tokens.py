"""Whole-text tokenizing with the public tokenizer files, exact and memoised.

Both public BPE models split a text into pieces before any merge, and no piece
crosses from a non-space character into a following U+0020.  Cutting a text
there and encoding the cuts one by one therefore gives the same ids as encoding
the whole text.  Words repeat, so each worker keeps a bounded memo of cut -> ids
and hands only unseen cuts to the tokenizers library.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

# A run of Latin letters, then symbols if any (but the apostrophe, which may begin a piece with
# letters): one or two pieces under both models.  "\0" ahead marks a cut without a space before it.
_PLAIN = re.compile(r"(\0?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
_LINES = re.compile(r"\S+(?:\n\S+)+\Z")
_CUT = re.compile(r"(?<=\S)(?= )")

# A remembered cut takes about ENTRY_BYTES besides its own characters and ids.
LONGEST, ENTRY_BYTES, MEMO_BYTES = 64, 160, 200 << 20
_LOADED: dict[tuple[str, int], "MemoTokenizer"] = {}


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file `name` lies; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable Latin-1 characters for
    themselves, characters from U+0100 on for the rest in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """cut -> its ids' bytes; unseen cuts are encoded when asked for."""

    def __init__(self, lib, code: str, spaced: bool):
        super().__init__()
        self.lib, self.model, self.code, self.spaced = lib, lib.model, code, spaced
        self.lead = " " if spaced else ""
        self.letters = _byte_letters()
        self.space = self.letters[0x20] if spaced else ""
        self.raw = [array(code, [k]).tobytes() for k in range(lib.get_vocab_size())]
        self.ends = {"": b""}
        self.newline = self.piece("\n") if spaced else b""
        self.strict = True
        self.held = 0
        self._begin()

    def _begin(self) -> None:
        if self.spaced:
            self["\1"] = self.newline  # a line end between two characters that aren't white space

    def clear(self) -> None:
        super().clear()
        self.held = 0
        self._begin()

    def piece(self, piece: str) -> bytes:
        if piece.isascii():  # printable ASCII stands for itself
            mapped = piece.replace(" ", self.letters[0x20]).replace("\n", self.letters[0x0A])
        else:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
        return self.ids_of(mapped)

    def ids_of(self, mapped: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(mapped)])

    def __missing__(self, cut: str) -> bytes:
        if cut.isascii() and cut.isalpha():  # the usual word, spelled as the model spells it
            return self._kept(cut, self.ids_of(self.space + cut if self.spaced else cut.lower()))
        m = _PLAIN.match(cut)
        if m:
            bare, word, end = m.groups()
            if end:
                last = self.ends.get(end)
                if last is None:
                    last = self.piece(end)
                    if len(end) <= LONGEST and len(self.ends) < 1 << 16:
                        self.ends[end] = last
                ids = self[bare + word] + last
            else:
                ids = self.piece((word if bare else " " + word) if self.spaced else word.lower())
        elif self.spaced and (not cut or cut == "\0" or cut[-1].isspace() or (cut[0] == "\0" and cut[1].isspace())):
            if self.strict:
                raise _Loose
            return self.whole(cut)  # not to be found by the strict way
        elif "\n" in cut and self.spaced and _LINES.match(cut):
            first, *rest = cut.split("\n")
            ids = self.newline.join([self[first], *[self["\0" + x] for x in rest]])
        else:
            ids = self.whole(cut)
        return self._kept(cut, ids)

    def _kept(self, cut: str, ids: bytes) -> bytes:
        if len(cut) <= LONGEST:
            self[cut] = ids
            self.held += len(cut) + len(ids) + ENTRY_BYTES
        return ids

    def whole(self, cut: str) -> bytes:
        text = cut[1:] if cut[:1] == "\0" else self.lead + cut
        return array(self.code, self.lib.encode(text, add_special_tokens=False).ids).tobytes()


class _Loose(Exception):
    """White space stands next to white space: the text must be cut with care."""


class MemoTokenizer:
    """encode(texts) -> one numpy id array per text, equal to the library's ids.

    `memo` bounds the number of remembered cuts and MEMO_BYTES their size; when either is reached,
    the memo starts anew.  Cuts of over LONGEST characters are never remembered.
    Plain words go straight to the library's model, other cuts through its whole pipeline.  A
    text that holds one of the file's own special tokens is left to the library as a whole,
    which gives that token its id.
    """

    def __init__(self, name: str, memo: int = 1_200_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(tokenizer_path(name))
        small = self.lib.get_vocab_size() <= 1 << 16
        self.dtype = np.dtype("<u2") if small else np.dtype("<u4")
        self.spaced = "Lowercase" not in str(self.lib.normalizer)  # a leading space is part of a piece
        # Markers of cuts, and the file's added tokens, which are found before anything else.
        self.whole = ["\0", "\1", *(t.content for t in self.lib.get_added_tokens_decoder().values())]
        self.most = memo
        self.memo = _Memo(self.lib, "H" if small else "I", self.spaced)

    def _cuts(self, text: str) -> list[str]:
        """Cuts in memo form: plain ones follow a space, "\0..." ones don't, "\1" is a line end."""
        if not self.spaced:
            try:  # this model lower-cases; for Latin-1 characters Python does the same
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return text.replace("\n", " ").split(" ")
        # If no white space meets other white space, each line end is a piece of its own.
        return ("\0" + text.replace("\n", " \1 \0")).split(" ")

    def _carefully(self, text: str) -> bytes:
        """Ids of a text in which white space stands together: cut only where a space follows a
        character that isn't white space."""
        self.memo.strict = False
        ids = b"".join([self.memo[c[1:] if c[:1] == " " else "\0" + c] for c in _CUT.split(text)])
        self.memo.strict = True
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out, memo = [], self.memo
        for t in texts:
            if len(memo) > self.most or memo.held > MEMO_BYTES:
                memo.clear()
            if not t:
                out.append(np.zeros(0, self.dtype))
            elif any(x in t for x in self.whole):
                out.append(np.array(self.lib.encode(t, add_special_tokens=False).ids, self.dtype))
            else:
                try:
                    ids = b"".join(map(memo.__getitem__, self._cuts(t)))
                except _Loose:
                    ids = self._carefully(t)
                out.append(np.frombuffer(ids, self.dtype))
        return out


def load(name: str, memo: int = 1_200_000) -> MemoTokenizer:
    """The worker's own tokenizer, loaded once per process."""
    key = (name, memo)
    if key not in _LOADED:
        _LOADED[key] = MemoTokenizer(name, memo)
    return _LOADED[key]
