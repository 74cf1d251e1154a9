"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the merge result of its bytes exactly if each token
alone, and each pair of neighbours, merges to itself.  So the last token of
every prefix is unique, and a left-to-right machine can follow all tokens that
are still possible.  A state is the set of tokens begun but not ended, each as
its place in the vocabulary's trie and the token before it; a transition reads
a byte and yields the token that ends there.  States and transitions are made
when first met and kept up to a bound.  A token is emitted once all open ones
agree on it, which takes a bounded lookahead.

Decoding joins token bytes and runs an incremental UTF-8 state machine, which
holds back at most three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import merge
from .shared import tidied

#: Pre-tokens whose ids a worker keeps.  It also bounds the transducer's transitions
#: and pair checks, hence a worker's memory: about 450 bytes for each.
CACHE = 1_000_000
#: Bytes read before settled tokens are emitted.
WINDOW = 4096
#: Bits of a token id plus one.
_ID = 20
_LOW = (1 << _ID) - 1


class Transducer:
    """Merges compiled to a machine from bytes to token ids."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        self.most_steps, self.most_pairs = cache * 5 // 6, cache * 2 // 3
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        if len(self.bytes_of) != len(self.ranks) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path}: ranks must be unique and hold every byte")
        self.child: dict[int, int] = {}
        self.token, self.inner, self.depth = [-1], bytearray(1), [0]
        for t, i in self.ranks.items():
            if len(t) > 1 and self.merged(t) != [i]:
                continue  # no merge ever yields it
            node = 0
            for b in t:
                self.inner[node] = 1
                step = node << 8 | b
                if step not in self.child:
                    self.child[step] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(0)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[step]
            self.token[node] = i
        self.length = {i: len(t) for t, i in self.ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def merged(self, piece: bytes) -> list[int]:
        """Ids by direct merging; used to compile and to check pairs of tokens."""
        get = self.ranks.get
        return [self.ranks[p] for p in merge([piece[i : i + 1] for i in range(len(piece))], lambda a, b: get(a + b), bytes.__add__)]

    def reset(self) -> None:
        """Forget all states met.

        An open token is one number: its place in the trie, and the token
        before it plus one in the low _ID bits.  So is a transition: the next
        state, and the token that ends plus one.
        """
        start = (0,)
        self.states, self.numbers = [start], {start: 0}
        self.steps: dict[int, int] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a."""
        found = self.pairs.get(key := a << _ID | b)
        if found is None:
            if len(self.pairs) > self.most_pairs:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def step(self, state: int, byte: int) -> int:
        """Determinise one transition."""
        here, after = -1, []
        for pair in self.states[state]:
            reached = self.child.get(pair >> _ID << 8 | byte)
            if reached is None:
                continue
            left = (pair & _LOW) - 1
            if here < 0 and (token := self.token[reached]) >= 0 and (left < 0 or self.follows(left, token)):
                here = token
            if self.inner[reached]:
                after.append(reached << _ID | left + 1)
        after.append(here + 1)
        new = tuple(after)
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        found = self.steps[state << 8 | byte] = number << _ID | here + 1
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(self.steps) > self.most_steps:
            self.reset()
        out: list[int] = []
        ends: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            found = steps.get(state << 8 | byte)
            if found is None:
                found = self.step(state, byte)
            state = found >> _ID
            ends.append((found & _LOW) - 1)
            if len(ends) >= WINDOW:
                ends = self._emit(ends, state, out)
        out += self._back(ends, len(ends))
        return out

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens that end at position ``at``, from the first."""
        found = []
        while at > 0:
            token = ends[at - 1]
            found.append(token)
            at -= self.length[token]
        found.reverse()
        return found

    def _emit(self, ends: list[int], state: int, out: list[int]) -> list[int]:
        """Move the tokens that all open ones agree on to ``out``; what remains of ``ends``."""
        at, chain = len(ends), {len(ends)}
        while at > 0:
            at -= self.length[ends[at - 1]]
            chain.add(at)
        settled = len(ends)
        for pair in self.states[state]:
            at = len(ends) - self.depth[pair >> _ID]
            while at not in chain:
                at -= self.length[ends[at - 1]]
            settled = min(settled, at)
        out += self._back(ends, settled)
        return ends[settled:]


class Utf8Stream:
    """Incremental UTF-8 state machine: bytes in, complete characters out."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue  # a continuation byte: its lead stands further left
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                second = data[-back + 1]
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= second <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        """The characters that are complete now; malformed bytes become U+FFFD."""
        data = self.held + data
        keep = self.unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        """What remains at the end of the stream."""
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


class Codec:
    """Texts to ids and back, for one vocabulary and split pattern."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE) -> None:
        self.machine = Transducer(path, cache)
        self.most = cache
        self.split = regex.compile(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.ids = {i: i for i in self.machine.bytes_of}  # one object for each id, which all entries share

    def missing(self, piece: str) -> tuple[int, ...]:
        """Ids of a pre-token that isn't in the younger half of the cache."""
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(map(self.ids.__getitem__, self.machine.encode(piece.encode("utf-8", "surrogatepass"))))
        if len(piece) < 64:
            if len(self.cache) >= self.most // 2:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        known = self.cache.get
        for piece in self.split.findall(text):
            ids = known(piece)
            if ids is None:
                ids = self.missing(piece)
                known = self.cache.get
            out += ids
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.machine.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """The text, block by block, with no character cut."""
        stream, some = Utf8Stream(), []
        for i in ids:
            some.append(i)
            if len(some) == block:
                yield stream.feed(self.decode_bytes(some))
                some = []
        yield stream.feed(self.decode_bytes(some)) + stream.close()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, cache: int = CACHE) -> Codec:
    """One codec per worker process, vocabulary, pattern and cache size."""
    return Codec(path, pattern, cache)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """id and ``ids`` (array of int) per input row.

    Null and empty texts give an empty array; repeated rows stay; other columns
    are ignored; an empty table gives an empty result.
    """

    @F.pandas_udf("array<int>")
    @tidied
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern, cache)
        for texts in batches:
            yield pd.Series([c.encode(t or "") for t in texts], dtype=object)

    return docs.select(F.col(id_col), ids(F.col(text_col).cast("string")).alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` per input row of ids; null ids give an empty text, malformed UTF-8 becomes U+FFFD."""

    @F.pandas_udf("string")
    @tidied
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for many in batches:
            yield pd.Series(["".join(c.decode_stream(x if x is not None else ())) for x in many], dtype=object)

    return encoded.select(F.col(id_col), texts(F.col(ids_col)).alias("text"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` per input row, without shipping the ids.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256``
    over the UTF-8 bytes of the text that the ids decode to.  Null counts as empty.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    @tidied
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                ids = c.encode(t or "")
                back = hashlib.sha256()
                for part in c.decode_stream(ids):
                    back.update(part.encode("utf-8", "surrogatepass"))
                rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), back.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(F.col(text_col).cast("string")).alias("r")).select(id_col, "r.*")
