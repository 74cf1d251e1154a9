"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is merged on its own: those that end as one
token and are one pre-token are *whole tokens*.  A text's pre-tokens that are
whole tokens count 1 without merging; only the rest are merged, and their counts
kept in a cache of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import merge
from .shared import tidied

#: Pre-tokens whose merged counts a worker keeps; beyond it the cache starts anew.
CACHE = 800_000
#: The split of the byte-level pre-tokenizer (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 onward.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """Pre-token (str) to its number of tokens, filled on demand."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.whole: dict[str, int] = {}
        for token in spec["model"]["vocab"]:
            try:
                text = bytes(back[c] for c in token).decode("utf-8")
            except (UnicodeDecodeError, KeyError):
                continue
            if self.split.findall(text) == [text] and len(self.merged(text)) == 1:
                self.whole[text] = 1
        self.update(self.whole)

    def merged(self, piece: str) -> list[str]:
        """The tokens of one pre-token, by merging."""
        letters = self.letters
        return merge([letters[b] for b in piece.encode("utf-8", "surrogatepass")], lambda a, b: self.ranks.get((a, b)), str.__add__)

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
            self.update(self.whole)
        n = len(self.merged(piece))
        if len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special token's string counts as that one token."""
        if not text:
            return 0
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split.findall(text)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker process and vocabulary."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``) per input row.

    ``path`` is a byte-level BPE file of the tokenizers library.  Null counts
    as empty: 0 bytes, 0 tokens.  Repeated rows stay; an empty table gives an
    empty result; other columns are ignored.
    """

    @F.pandas_udf("long")
    @tidied
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
