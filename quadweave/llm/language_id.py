"""Language identification by compression.

Per language, a raw-content zstandard dictionary is made of whole training
texts.  A text is compressed with each dictionary, block by block; the language
whose dictionary yields the fewest bytes wins, and a narrow margin is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import draw, tidied

#: Bytes of a language's dictionary, texts drawn to fill it, and languages at most.
DICTIONARY_BYTES, SAMPLE_TEXTS, MAX_LANGUAGES = 8 << 10, 64, 500
#: Bytes compressed at a time, so that a long text doesn't serve as its own dictionary.
BLOCK = 4096
#: Stands before each block and costs the same for every language: without it a
#: short text would be stored raw, whatever the dictionary.
CARRIER = bytes(256)
UNKNOWN = "und"
#: Margin (of the smallest to the next size) up to which a prediction counts as rejected.
MARGIN = 0.001
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    """What is compressed: case-folded letters, all else one space."""
    return _OTHER.sub(" ", text.casefold()).encode("utf-8", "surrogatepass")


def learn(training: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """A dictionary's content per language, from rows with text and language.

    Per language, at most SAMPLE_TEXTS distinct whole texts of 32 to
    DICTIONARY_BYTES bytes are drawn in hash order of ``key`` (thinned out before
    the shuffle), and taken while they fit.  Where a language has none, texts of
    fewer bytes and the beginnings of longer ones are drawn instead.  Of the drawn
    texts the driver gets twice DICTIONARY_BYTES per language at most, which is 8 MB in
    all.  The languages beyond the MAX_LANGUAGES most frequent are not learned.
    """
    text, size = F.col(text_col).cast("string"), F.octet_length("text")
    rows = training.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(key)).alias("h")).where(
        "lang is not null and octet_length(text) > 0"
    )
    # any character is four bytes at most
    rows = rows.select("lang", "h", size.between(32, DICTIONARY_BYTES).alias("fits"), F.when(size > DICTIONARY_BYTES, F.substring("text", 1, DICTIONARY_BYTES // 4 - 1)).otherwise(F.col("text")).alias("text"))
    rows = rows.withColumn("same", F.xxhash64("text"))
    # hashes only are sent to tell repeats
    texts = rows.groupBy("lang", "fits", "same").agg(F.min("h").alias("h"))
    best = texts.groupBy("lang").agg(F.max("fits").alias("fits"))
    few = draw(texts.join(best, ["lang", "fits"]), "lang", SAMPLE_TEXTS, ["same"], MAX_LANGUAGES)
    drawn = rows.join(F.broadcast(few), ["lang", "fits", "same", "h"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    before = F.sum(size).over(Window.partitionBy("lang").orderBy("rank")) - size
    drawn = drawn.withColumn("before", before).where(F.col("before") < DICTIONARY_BYTES).collect()
    out: dict[str, bytes] = {}
    for row in sorted(drawn, key=lambda r: (r.lang, r.rank)):
        content = letters(row.text)
        have = out.setdefault(row.lang, b"")
        if len(have) + len(content) + 1 <= DICTIONARY_BYTES:
            out[row.lang] = have + content + b" "
    return out


@lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    params = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=13, chain_log=13, search_log=4, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        made.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return made


def sizes(text: str, model: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """Bytes that the whole text takes with each language's dictionary."""
    raw = letters(text)
    blocks = [CARRIER + raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for _, c in _compressors(model)], float)


def predict_one(text: str | None, model: tuple[tuple[str, bytes], ...], margin: float = MARGIN) -> tuple[str, float, float, bool]:
    """Language, score, margin of one text, and whether it is rejected."""
    if not text or not model or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0, True
    size = sizes(text, model)
    order = np.argsort(size, kind="stable")
    if len(order) == 1:
        return model[0][0], 1.0, 1.0, False
    lead = float((size[order[1]] - size[order[0]]) / size[order[1]])
    weight = np.exp(-(size - size.min()) * np.log(2.0))
    return model[int(order[0])][0], float(1 / weight.sum()), lead, lead <= margin


def frozen(model: dict[str, bytes]) -> tuple[tuple[str, bytes], ...]:
    """The model as predictions take it, in order of language."""
    return tuple(sorted(model.items()))


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """id, ``lang_pred``, ``score``, ``margin``, ``rejected`` per input row.

    ``und``, score 0 and rejected where the text is null, empty or has no
    letter, or nothing was learned.  Equal sizes go to the first language in
    alphabetical order, with a margin of 0, and are rejected as all margins up to
    ``margin`` are, whatever the text's length.  Repeated rows stay, an empty table
    gives an empty result, other columns are ignored.
    """
    fixed = frozen(model)

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    @tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predict_one(t, fixed, margin) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col(id_col), run(F.col(text_col).cast("string")).alias("p")).select(id_col, "p.*")


def keep(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows, with all their columns, whose language is predicted and not rejected."""
    fixed = frozen(model)

    @F.pandas_udf("boolean")
    @tidied
    def sure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not predict_one(t, fixed, margin)[3] for t in texts], dtype=bool)

    return docs.where(sure(F.col(text_col).cast("string")))
