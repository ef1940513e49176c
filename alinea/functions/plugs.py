"""What SQL calls by name: the table function chunks(text, most), and the plugs embed(text) and judge(rule, text).

register() puts them into a session. Who has a model gives functions of batches of their own; ours are plain stand-ins that
give the same answer everywhere.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

JUDGED = "status string, confidence double, reasoning string"


class Chunks:
    """A row for each chunk: idx (from 0) and chunk, by the rule of chunk.split_text."""

    def eval(self, text: str, most: int) -> Iterator[tuple[int, str]]:
        current, done = "", 0
        for paragraph in (p.strip(" ") for p in re.split(r"\n\n+", text or "")):
            if len(current) + len(paragraph) <= most:
                current = f"{current}\n\n{paragraph}" if current and paragraph else current or paragraph
                continue
            if current:
                yield done, current
                done += 1
            whole = (len(paragraph) - 1) // most
            for k in range(whole):
                yield done, paragraph[k * most : (k + 1) * most]
                done += 1
            current = paragraph[whole * most :]
        if current:
            yield done, current


def hashed_words(texts: pd.Series, dim: int = 64) -> pd.Series:
    """Words by hash with a sign, to unit length: the same words give the same vector. No words give zeros."""

    def one(text: str | None) -> list[float]:
        out = [0.0] * dim
        for word in re.findall(r"\w+", (text or "").lower()):
            code = zlib.crc32(word.encode())
            out[code % dim] += 1.0 if code >> 31 else -1.0
        norm = math.sqrt(sum(v * v for v in out))
        return [v / norm for v in out] if norm else out

    return texts.map(one)


def shared_words(rules: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """Green where all words of a rule are in the text, Amber where half of them are, else Red; confidence is their share."""

    def one(rule: str | None, text: str | None) -> tuple[str, float, str]:
        wanted, had = (set(re.findall(r"\w+", (x or "").lower())) for x in (rule, text))
        share = len(wanted & had) / len(wanted) if wanted else 0.0
        return ("Green" if share == 1 else "Amber" if share >= 0.5 else "Red"), share, f"{len(wanted & had)} of {len(wanted)} words"

    return pd.DataFrame([one(r, t) for r, t in zip(rules, texts, strict=True)], columns=["status", "confidence", "reasoning"])


def register(spark: SparkSession, embed: Callable[[pd.Series], pd.Series] = hashed_words, judge: Callable[[pd.Series, pd.Series], pd.DataFrame] = shared_words) -> None:
    """embed: texts to vectors; judge: rules and texts to frames of status, confidence and reasoning."""

    def vectors(texts: pd.Series) -> pd.Series:
        return embed(texts)

    def judged(rules: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return judge(rules, texts)

    vectors.__annotations__, judged.__annotations__ = {"texts": pd.Series, "return": pd.Series}, {"rules": pd.Series, "texts": pd.Series, "return": pd.DataFrame}
    spark.udtf.register("chunks", udtf(Chunks, returnType="idx int, chunk string"))
    spark.udf.register("embed", pandas_udf(vectors, "array<float>"))
    spark.udf.register("judge", pandas_udf(judged, JUDGED))
