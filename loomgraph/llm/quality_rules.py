"""Quality rules with compression bands (operator 8).

Zstandard ratios (raw bytes over compressed bytes) of the whole text and of fixed chunks must lie inside bands that
depend on the length: a ratio above the band is repetitive text, one below it incompressible text. Base rules on
words, symbols, lines and repeated windows are counted beside it. Every row is judged alone: no shuffle.

Defined results: null counts as an empty text, which fails the base rules; repeated rows are judged alike; an empty
table gives an empty result. The last chunk ends at the text's end and may overlap the one before it, so every byte is in one. A ratio
equal to a limit is inside the band. Long texts are compressed and counted whole, chunk by chunk. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from loomgraph.llm.common import SPACE_BYTES, slices, texts

LEVEL = 3
CHUNK_BYTES = 4096
#: (fewest bytes, lowest ratio, highest ratio) of the whole text. Longer prose compresses better, so both limits rise.
BANDS = ((0, 0.90, 3.0), (512, 1.15, 3.2), (2048, 1.35, 3.5), (8192, 1.5, 3.8), (32768, 1.55, 4.2))
#: The same for one chunk; a text is rejected if more than this share of its chunks lies outside.
CHUNK_BAND = (1.25, 4.0)
CHUNK_SHARE = 0.25
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, lowest_chunk double, highest_chunk double, reason string"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) == n:
        return 0
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    begins = np.flatnonzero(count[at] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[begins + k] = True
    return int(hit.sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE_BYTES)]
    return len(lines) - len(set(lines))


def band(size: int) -> tuple[float, float]:
    return [x[1:] for x in BANDS if size >= x[0]][-1]


def verdict(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, float, float, str]:
    """Whole ratio, lowest and highest chunk ratio, and why the text is rejected (empty: it isn't)."""
    ratio = len(text) / len(zstd.compress(text)) if text else 1.0
    begins = [*range(0, len(text) - CHUNK_BYTES, CHUNK_BYTES), len(text) - CHUNK_BYTES]
    parts = [ratio] if len(text) <= CHUNK_BYTES else [len(c) / len(zstd.compress(c)) for c in (text[i : i + CHUNK_BYTES] for i in begins)]
    low, high = band(len(text))
    off_low, off_high = (sum(x < CHUNK_BAND[0] for x in parts), sum(x > CHUNK_BAND[1] for x in parts)) if len(text) > CHUNK_BYTES else (0, 0)
    why = "repetitive" if ratio > high else "incompressible" if ratio < low else "repetitive chunks" if off_high > CHUNK_SHARE * len(parts) else "incompressible chunks" if off_low > CHUNK_SHARE * len(parts) else "mixed chunks" if off_low + off_high > CHUNK_SHARE * len(parts) else ""
    return ratio, min(parts), max(parts), why


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    for batch in slices(batches):
        rows = []
        for text in texts(batch):
            words = text.split()
            n, repeats = len(words), repeat_words(words)
            chars = len(text.decode()) - (len(text) - len(text.translate(None, SPACE_BYTES)))
            failed = n < 50 or 100 * repeats > 50 * n
            ratio, low, high, why = verdict(text, zstd)
            rows.append((n, chars, len(text) - len(text.translate(None, SYMBOLS)), dup_lines(text), repeats, failed, not failed and not why, ratio, low, high, "base" if failed else why))
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)
