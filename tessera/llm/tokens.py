"""Token ids of whole texts, for operators that only need the ids."""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

#: A space beside other white space: there the pieces of a text are not those of its space-led chunks.
UNSAFE = re.compile(r" \s|\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Chunk -> make(chunk). When `most` chunks are held they become the old ones, from which those asked
    for again come back: what is frequent stays."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, chunk: str):
        made = self.old.get(chunk)
        if made is None:
            made = self.make(chunk)
            if len(chunk) > 48:
                return made
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = made
        return made


class Chunked:
    """make(text) for each space-led chunk of a text, remembered by chunk.

    Byte-level pieces hold no space but a leading one, so that texts whose spaces stand alone may be cut
    before every space; other texts go through make() whole."""

    def __init__(self, make, most: int = 100_000):
        self.make = make
        self.head, self.rest = Memo(make, 20_000), Memo(lambda chunk: make(" " + chunk), most)

    def __call__(self, text: str) -> list:
        if UNSAFE.search(text):
            return [self.make(text)]
        rest = text.split(" ")
        first = rest[0]
        if first:
            found = list(map(self.rest.__getitem__, rest[1:]))
            found.insert(0, self.head[first])
            return found
        return list(map(self.rest.__getitem__, rest[1:]))


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """(content, id) of what a tokenizers file adds to its vocabulary: it is one id wherever a text has it."""
    with open(json_path, encoding="utf-8") as f:
        return tuple((x["content"], int(x["id"])) for x in json.load(f).get("added_tokens", []))


@lru_cache(4)
def id_bytes(ranks_path: str, added: tuple[tuple[str, int], ...] = ()):
    """text -> its ids as little-endian unsigned 32-bit integers; ranks_path holds the same vocabulary as the .json.

    added: strings that are one id each, as tokenizers has it, whatever stands around them."""
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks_path), special_tokens=dict(added))
    encode, strings = encoding.encode_ordinary, [x for x, _ in added]
    chunked = Chunked(lambda x: array("I", encode(x)).tobytes())

    def run(text: str) -> bytes:
        if any(x in text for x in strings):
            return array("I", encoding.encode(text, allowed_special="all")).tobytes()
        return b"".join(chunked(text))

    return run
