"""Exact token ids by a byte-level BPE vocabulary file, Arrow batch by batch; the estimates are in tokens.py."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IDS = T.ArrayType(T.IntegerType())


@lru_cache(2)
def _encoding(ranks_path: str | None):
    """The vocabulary in ranks_path, by default the one that public_tokenizers has."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_arrays(texts, ranks_path: str | None = None):
    """A series of texts as arrays of four bytes an id: lists of whole numbers would take ten times that for all of a batch."""
    encode = _encoding(ranks_path).encode_ordinary
    return texts.map(lambda t: np.array(encode(t or ""), "i4"))


def ids(text, ranks_path: str | None = None) -> Column:
    """The text's ids; none for a null text."""

    @F.pandas_udf(_IDS)
    def run(texts):
        return id_arrays(texts, ranks_path)

    return run(F.col(text) if isinstance(text, str) else text)


def text_of(tokens, ranks_path: str | None = None) -> Column:
    """The text that ids spell; unfinished characters become U+FFFD."""

    @F.pandas_udf(T.StringType())
    def run(values):
        decode = _encoding(ranks_path).decode
        return values.map(lambda x: None if x is None else decode(np.asarray(x, "i4").tolist()))

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)


def count(text, ranks_path: str | None = None) -> Column:
    """How many ids a text has; they stay in Python."""

    @F.pandas_udf(T.IntegerType())
    def run(texts):
        encode = _encoding(ranks_path).encode_ordinary
        return texts.map(lambda t: len(encode(t or ""))).astype("i4")

    return run(F.col(text) if isinstance(text, str) else text)


def truncated(text, most: int, suffix: str = "", ranks_path: str | None = None) -> Column:
    """The text if it has at most `most` ids, else that of the first ones and a suffix."""
    t = F.col(text) if isinstance(text, str) else text
    found = ids(t, ranks_path)
    return F.when(F.size(found) <= most, t).otherwise(F.concat(text_of(F.slice(found, 1, most), ranks_path), F.lit(suffix)))


def boundary(text, target: int, ranks_path: str | None = None) -> Column:
    """(position, head): how many characters the first `target` ids spell, and they."""
    head = truncated(text, target, "", ranks_path)
    return F.struct(F.length(head).alias("position"), head.alias("head"))


def windows(text, size: int, overlap: int = 0, ranks_path: str | None = None) -> Column:
    """The texts of windows of `size` ids, each beginning `overlap` before the last one's end.

    An edge within a character moves back to where that begins, so that windows hold whole characters and without an overlap join to the text."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts):
        encoding = _encoding(ranks_path)

        def cut(text):
            found, start, out = encoding.encode_ordinary(text or ""), 0, []

            def edge(i: int) -> int:
                """The nearest place before i, or where that is not behind start, after it, at which a character begins."""
                within = lambda i: i < len(found) and encoding.decode_single_token_bytes(found[i])[0] & 0xC0 == 0x80
                back = i
                while back > start and within(back):
                    back -= 1
                if back > start:
                    return back
                i = max(i, start + 1)
                while within(i):
                    i += 1
                return i

            while start < len(found):
                end = edge(min(start + size, len(found)))
                out.append(encoding.decode(found[start:end]))
                start = edge(end - overlap) if end < len(found) else end
            return out

        return texts.map(cut)

    return run(F.col(text) if isinstance(text, str) else text)
