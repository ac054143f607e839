"""Chunking as a table function for SQL:

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text, 'recursive', 500, 50) c
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from skarn.operators import chunking


def fixed_ranges(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """The last window is the first that reaches the end; an empty text has one empty window."""
    step = size - overlap
    return [(k, min(k + size, len(text))) for k in range(0, max(len(text) - overlap, 1), step)]


STRATEGIES = {"fixed": fixed_ranges, "recursive": chunking.recursive_ranges, "semantic": chunking.semantic_ranges}


@udtf(returnType="chunk_index int, start_index int, end_index int, text string", useArrow=True)
class ChunkText:
    """Ranges of a text that are not blank, numbered by range."""

    def eval(self, text: str, strategy: str, size: int, overlap: int):
        chunking.check_size(size, overlap)
        for k, (a, b) in enumerate(STRATEGIES[strategy](text or "", size, overlap)):
            if (text or "")[a:b].strip():
                yield k, a, b, text[a:b]


@udtf(returnType="w int, passage string", useArrow=True)
class TokenWindows:
    """Windows of `size` tokens, each three quarters behind the one before."""

    def eval(self, tokens: list[str], size: int):
        for w, k in enumerate(range(0, len(tokens or ()), size - size // 4)):
            yield w, " ".join(tokens[k : k + size])


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("token_windows", TokenWindows)
