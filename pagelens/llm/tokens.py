"""Token ids of whole texts by a public tokenizer, in tasks.

The vocabulary splits at white space before anything else, so a text's ids are those of its
white-space-delimited pieces in turn. Pieces recur: a worker process keeps the ids of those it has seen, packed as
little-endian unsigned 32-bit numbers, in caches of bounded size that all its tasks share.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Callable

VOCABULARY = "word_bpe_49k.json"
# Pieces that a process remembers (about 120 MB), besides those of the text at hand.
CACHE_PIECES = 600_000
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4
# The public byte-level alphabet, a rule. Printable bytes stand for themselves, the others for
# the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _alphabet() -> dict[int, int]:
    others = [b for b in range(256) if b not in _PRINTABLE]
    return {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(others)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else b"".join(i.to_bytes(4, "little") for i in ids)


class _Remembered(dict):
    """Results of a function for the keys asked for. What was used since the last turn stays for another one, so what is
    frequent is never forgotten."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


def _latin(text: str) -> bool:
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def _worker_state() -> dict:
    """A dictionary of this Python process. Functions travel to workers by value, module globals included, so what
    should outlive a task is kept under a name of its own among the process's modules."""
    return sys.modules.setdefault("_pagelens_worker_state", types.ModuleType("_pagelens_worker_state")).__dict__


def worker_encoder(path: str | None = None) -> Callable[[str | None], bytes]:
    """The encoder of this worker process, made once: its pieces serve all tasks that the process runs."""
    made = _worker_state().setdefault("encoders", {})
    if path not in made:
        made[path] = encoder(path)
    return made[path]


def encoder(path: str | None = None, cache_pieces: int = CACHE_PIECES) -> Callable[[str | None], bytes]:
    """A function from text to its ids as bytes. Null is the empty text.

    ``path``: the vocabulary file on every worker (default: the installed public one). ``cache_pieces`` are remembered: words
    in lower case, and whatever else stands between blanks.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path or vocabulary_path())
    whole.encode_special_tokens = True  # their strings in a text are ordinary text
    model, alphabet = whole.model, _alphabet()
    # A lower-case word of letters that need no normalising is what the normaliser and the pre-tokenizer leave as it is,
    # so it may go straight to the model.
    plain = re.compile("[a-zß-öø-ÿ]+").fullmatch
    ascii_blanks = re.compile(r"[^\x20\x09-\x0d]+").findall
    marks = {m: _packed([x.id for x in model.tokenize(m)]) for m in ".,;:!?"}

    def of_piece(piece: str) -> bytes:
        last = piece[-1]
        if last in marks and piece[-2:-1].isalpha():  # a single mark between a letter and a blank is a token of its own
            return pieces[piece[:-1]] + marks[last]
        if plain(piece):
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(alphabet)
            return _packed([x.id for x in model.tokenize(mapped)])
        return _packed(whole.encode(piece, add_special_tokens=False).ids)

    pieces = _Remembered(of_piece)

    def encode(text: str | None) -> bytes:
        text = text or ""
        if _latin(text):  # one form of each piece; elsewhere lower-casing may depend on what stands beside a letter
            text = text.lower()
        if len(pieces) > cache_pieces // 2:
            pieces.turn()
        # str.split() also cuts at four control characters that are no white space to the vocabulary.
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return b"".join(map(pieces.__getitem__, ascii_blanks(text) if odd else text.split()))

    return encode
