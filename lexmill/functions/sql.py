"""Functions callable from SQL: ``register(spark)``, then ``... documents d, LATERAL chunk_text(d.text, d.source) c``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .. import constants as C
from .text import TAG, unescape


@udtf(returnType="chunk_index INT, content STRING", useArrow=True)
class ChunkText:
    """A row per window of words of a text, as ``chunk_words`` cuts it; a text without words gives none."""

    def eval(self, body: str, title: str) -> Iterator[tuple[int, str]]:
        # str.split() cuts at the same white space, line separators and control characters included
        words = re.sub(TAG, " ", unescape(body or "")).split()
        head = f"{title}\n\n" if title else ""
        for n, start in enumerate(range(0, len(words), C.CHUNK_WORDS - C.CHUNK_OVERLAP)):
            part = words[start : start + C.CHUNK_WORDS]
            yield n, head + (part[0][: C.GIANT_WORD] if len(part) == 1 else " ".join(part))


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
