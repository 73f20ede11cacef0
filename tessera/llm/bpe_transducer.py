"""Byte-level BPE by a lazily determinised transducer; decoding by an incremental UTF-8 machine.

Encoding. A run of ids is the BPE encoding of its bytes exactly if each pair of neighbours is that of
its own bytes, so that the encoding of a prefix follows from those of shorter ones: its last token is
the one that ends there and may follow the last token where it begins. A state holds every position
from which a token may still run on: its node in the vocabulary's trie and the tokens up to it that are
not yet emitted. What all of them have in common is emitted, after no more lookahead than the longest
token. States and their arcs are made when first met.

Decoding. The machine's state is the bytes of an unfinished character. One arc per state and id holds
the characters that the id completes. Bytes that no UTF-8 text has become U+FFFD.

Nulls: a null text is empty (no ids), null ids give an empty text. Repeated rows and rows without an id are
rows like others. Very long texts go through whole: states, arcs, pair tests and remembered chunks are
forgotten when they are too many. Columns beyond the id and the text are ignored by digests() and kept by
encode() and decode(), but for one of the name they are asked to write, which is replaced. An empty table
gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens


#: Pair tests that are remembered.
MOST_PAIRS = 500_000


class Transducer:
    """encode(piece) -> ids of one pre-token."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for word, i in ranks.items():
            node = 0
            for byte in word:
                if (nxt := self.children[node].get(byte)) is None:
                    nxt = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.reset()

    def reset(self) -> None:
        start = (-1, ((0, ()),))
        self.number, self.states = {start: 0}, [start]
        #: state * 256 + byte -> (state, emitted)
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the token's left (0) or right (1) end while its bytes merge: (part, rank that ends it), last the whole."""
        found = self.spines.get((token, side))
        if found is None:
            parts = [bytes([x]) for x in self.bytes_of[token]]
            found, at = [], 0
            while True:
                end = parts[-side]
                if not found or found[-1][0] != end:
                    found.append((end, at))
                if len(parts) == 1:
                    break
                at, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if at == 1 << 60:  # a token that merging does not reach
                    found = []
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            # from "made at this rank" to "gone at the rank at which the next is made"
            found = [(part, found[k + 1][1] if k + 1 < len(found) else 1 << 60) for k, (part, _) in enumerate(found)]
            self.spines[token, side] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b stay two when their bytes merge: no part at a's right end and one at b's left end,
        while both are there, make a token of a rank that comes before either ends (of equal ranks, the left one first)."""
        if a < 0:
            return bool(self.spine(b, 0))
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            left, right = self.spine(a, 1), self.spine(b, 0)
            found, i, j, get = bool(left) and bool(right), 0, 0, self.ranks.get
            while found:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = get(x + y, 1 << 60)
                if rank < x_ends and rank <= y_ends and rank < 1 << 60:
                    found = False
                elif x_ends == y_ends == 1 << 60:
                    break
                elif x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after byte, and what is emitted on the way."""
        before, live = self.states[state]
        children, token_at = self.children, self.token_at
        onward, ending = [], []
        for node, pending in live:
            nxt = children[node].get(byte)
            if nxt is not None:
                if token_at[nxt] >= 0:
                    ending.append((pending, token_at[nxt]))
                if children[nxt]:
                    onward.append((nxt, pending))
        if not ending:
            raise ValueError(f"no token ends in byte {byte}: the vocabulary lacks single bytes")
        # One of them is right: the last needs no test if the others fail.
        last = len(ending) - 1
        for i, (pending, token) in enumerate(ending):
            if i == last or self.may_follow(pending[-1] if pending else before, token):
                break
        here = (*pending, token)
        onward.append((0, here))
        shared, stop = 0, min([len(p) for _, p in onward])
        while shared < stop:
            one = here[shared]
            for _, p in onward:
                if p[shared] != one:
                    break
            else:
                shared += 1
                continue
            break
        out = here[:shared]
        if shared:
            onward = [(n, p[shared:]) for n, p in onward]
            before = out[-1]
        if before >= 0 and stop > shared:  # every token to come follows a pending one
            before = -2
        made = (before, tuple(onward))
        number = self.number.get(made)
        if number is None:
            number = self.number[made] = len(self.states)
            self.states.append(made)
        self.arcs[state << 8 | byte] = (number, out)
        return number, out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.most_states:
            self.reset()
        state, out, get = 0, [], self.arcs.get
        for byte in piece:
            state, made = get(state << 8 | byte) or self.arc(state, byte)
            if made:
                out += made
        out += self.states[state][1][-1][1]  # the position at the end stands last
        return out


class Utf8Machine:
    """Feed ids one after the other; feed() returns the characters they complete."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.arcs: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}

    def arc(self, state: bytes, token: int) -> tuple[bytes, str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        machine.setstate((state, 0))
        text = machine.decode(self.bytes_of[token])
        hit = self.arcs[state][token] = (machine.getstate()[0], text)
        self.arcs.setdefault(hit[0], {})
        return hit

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        state, arcs = b"", self.arcs
        for token in ids:
            hit = arcs[state].get(token) or self.arc(state, token)
            state = hit[0]
            yield hit[1]
        if state:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.feed(ids))


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        import public_tokenizers
        import regex

        self.transducer = Transducer(tokens.read_ranks(ranks_path))
        self.machine = Utf8Machine(self.transducer.bytes_of)
        find, encode = regex.compile(pattern).findall, self.transducer.encode
        pieces = tokens.Memo(lambda piece: tuple(encode(piece.encode())), 50_000)

        known = pattern == public_tokenizers.PATTERN

        def chunk(text: str) -> tuple[int, ...]:
            # Latin letters after a space are one piece under the public pattern; the rest is for a pattern to say.
            if known and text[1:].isalpha() and text[0] == " " and max(text) < "\u0250":
                return tuple(encode(text.encode()))
            return tuple(chain.from_iterable(map(pieces.__getitem__, find(text))))

        self.chunked = tokens.Chunked(chunk, 400_000)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.chunked(text)))

    def decode(self, ids: Iterable[int]) -> str:
        return self.machine.decode(ids)


@lru_cache(1)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _settings(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_path or tokens.default_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with an array of the text's ids."""
    from pyspark.sql import types as T

    where = _settings(ranks_path, pattern)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts):
        return texts.map(lambda t: codec(*where).encode(t or ""))

    return docs.withColumn(ids, run(text))


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with the text that the ids spell; null ids give an empty text."""
    from pyspark.sql import types as T

    where = _settings(ranks_path, pattern)

    @F.pandas_udf(T.StringType())
    def run(values):
        return values.map(lambda x: "" if x is None else codec(*where).decode(map(int, x)))

    return docs.withColumn(text, run(ids))


def digests(docs: DataFrame, doc: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode each text; doc_id, n_tokens and the hashes of the ids and of the decoded bytes."""
    where = _settings(ranks_path, pattern)
    schema = f"doc_id {docs.schema[doc].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*where)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            n, hashes, back = [], [], []
            for t in b.column(1):
                found = c.encode(t.as_py() or "")
                n.append(len(found))
                hashes.append(sha(" ".join(map(str, found)).encode()))
                back.append(sha(c.decode(found).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
