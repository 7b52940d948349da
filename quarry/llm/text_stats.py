"""Statistics of whole texts, one pass, computed inside tasks on Arrow batches.

Words are runs outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` splits on
exactly that set. A null text counts as empty; an empty text has all counts 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the symbol characters that are counted.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_chars", "n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_upper", "n_digits", "n_marks", "n_stops", "n_distinct", "n_adjacent")

_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(ids: np.ndarray, vocabulary: int, window: int = 5) -> int:
    """Words covered by a window of ``window`` words that occurs twice or more
    in the text, first occurrences included. Windows are compared exactly, by
    joining codes of adjacent shorter windows."""
    n = len(ids) - window + 1
    if n < 2 or vocabulary == len(ids):
        return 0
    code, width = ids, 1
    size = vocabulary
    while width < window:
        step = min(width, window - width)
        # code of [i, i+width) and of [i+step, i+step+width): their union is a window of width + step words
        pair = code[: len(code) - step] * size + code[step:]
        seen, code = np.unique(pair, return_inverse=True)
        size, width = len(seen), width + step
        if size == len(code):
            return 0
    often = np.bincount(code, minlength=size)[code] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(often), 1)
    np.add.at(cover, np.flatnonzero(often) + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def count_text(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    space = len(raw) - sum(map(len, words))

    def number(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    return (len(text), len(raw), n, len(text) - space, number(SYMBOLS), len(lines), len(lines) - len(set(lines)),
            repeated_words(ids, len(seen)), number(_UPPER), number(_DIGITS), number(b"!?"), number(b".,;:"),
            len(seen), int(np.count_nonzero(ids[1:] == ids[:-1])))


def text_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus one long column per name of ``COUNTS``."""
    cols = docs.select(*keep, *([] if text_col in keep else [text_col]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[: len(keep)]]
    schema = ", ".join(fields + [f"{c} long" for c in COUNTS])
    width, place = len(keep), cols.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [count_text(t or "") for t in b.column(place).to_pylist()]
            counts = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
            arrays = [b.column(i) for i in range(width)] + [pa.array(counts[:, j]) for j in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *COUNTS])

    return cols.mapInArrow(run, schema)
