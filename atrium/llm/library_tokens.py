"""Encoders over the tokenizers library, with memories of pieces and chunks in front of it.

A piece that is new goes to the library's model; a text that may be split differently by two Unicode
versions, or that has white space in a row, goes to the whole library pipeline.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Callable

import regex

from atrium.llm.chunks import Memory, SpacedEncoder, printable

_MADE: dict[str, Callable[[str], bytes]] = {}
#: Signs that often end a word; with one of them such a chunk is two pieces.
STOPS = frozenset(",.!?;:")
#: Fixed value: the split of byte-level tokenizers that name no pattern of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def without_feeds(text: str) -> str:
    """``text`` without the white space beside the space on which libraries of any Unicode version agree."""
    return text.replace("\n", "").replace("\t", "").replace("\r", "")


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, following = [], 0x100
    for byte in range(256):
        if byte in printing:
            letters.append(chr(byte))
        else:
            letters.append(chr(following))
            following += 1
    return letters


def encoder(json_file: bytes, words: bool) -> Callable[[str], bytes]:
    """Text -> ids as native 32-bit bytes.  ``words``: the tokenizer lower-cases, drops white space and never joins across it.

    Strings of special tokens in a text are ordinary text.  One encoder for each process.
    """
    key = hashlib.md5(json_file).hexdigest() + str(words)
    if key in _MADE:
        return _MADE[key]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(json_file.decode())
    library.encode_special_tokens = True
    model, letter = library.model, byte_letters().__getitem__
    pattern = json.loads(json_file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if words else BYTE_LEVEL
    split = regex.compile(pattern)

    def whole(text: str) -> bytes:
        return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()

    tokenize, space = model.tokenize, letter(0x20)

    def piece(text: str) -> bytes:
        body = text[1:] if text[0] == " " else text
        if body.isascii() and body.isalnum():  # such letters stand for themselves
            text = text if body is text else space + body
        else:
            text = "".join(map(letter, text.encode()))
        return array("I", [t.id for t in tokenize(text)]).tobytes()

    if words:

        def chunk(low: str) -> bytes:
            """A word in lower case; its parts are remembered as words are, so a word and its copy before a comma are new once."""
            if low.isalpha():
                return piece(low)
            if low[-1] in STOPS and low[:-1].isalpha():
                return memory[low[:-1]] + memory[low[-1]]
            parts = split.findall(low)
            return b"".join(map(memory.__getitem__, parts)) if len(parts) > 1 else piece(low)

        memory = Memory(chunk, 500_000)

        def encode(text: str) -> bytes:
            return b"".join(map(memory.__getitem__, text.lower().split())) if printable(without_feeds(text)) else whole(text)

    else:

        def chunk(text: str) -> bytes:
            body = text[1:] if text[0] == " " else text
            if not body.isalpha():
                if body[-1:] in STOPS and body[:-1].isalpha():
                    return (encode.bare if body is text else encode.spaced)[body[:-1]] + encode.bare[body[-1]]
                parts = split.findall(text)
                if len(parts) > 1:
                    return b"".join(encode.spaced[p[1:]] if p[0] == " " and len(p) > 1 else encode.bare[p] for p in parts)
            return piece(text)

        def spaced(text: str) -> bytes:
            """The ids of a chunk with the space before it."""
            if text.isascii() and text.isalpha():  # one piece, and its letters stand for themselves
                return array("I", [t.id for t in tokenize(space + text)]).tobytes()
            return chunk(" " + text)

        encode = SpacedEncoder(chunk, whole, 700_000, spaced)
    _MADE[key] = encode
    return encode
