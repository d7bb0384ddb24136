"""Token counts of sections: whole documents are encoded once and token spans are joined to sections by interval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.bpe import encoder, vocabulary_path
from ctxspark.llm.common import bound_arrow, text_slices

#: Who gets a token that crosses a boundary: the section with its middle character (of two middle ones the first), the
#: one with its first character, or each its share of the characters.
RULES = ("middle", "first", "share")


def token_spans(ids: np.ndarray, sizes: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first character, end) of each token. A token that holds part of a character's bytes spans that character."""
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    if text.isascii():
        return start, end
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    return char[start], char[end - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each line with its line feed."""
    sizes = np.fromiter((len(x) + 1 for x in text.split("\n")), np.int64)
    end = np.cumsum(sizes)
    start = end - sizes
    end[-1] -= 1
    keep = end > start
    return start[keep], end[keep]


def allocate(start: np.ndarray, end: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray, rule: str = "middle") -> np.ndarray:
    """Tokens of each section by the rule. Tokens come in order, so their ends are sorted and each section takes two
    binary searches; sections may overlap, nest, or leave gaps."""
    if rule == "share":
        width = np.maximum(end - start, 1)

        def upto(x: np.ndarray) -> np.ndarray:
            cover = np.concatenate([[0.0], np.cumsum(np.ones(len(start)))])
            k = np.searchsorted(end, x, "right")
            part = np.zeros(len(x))
            inside = k < len(start)
            # tokens of one split character overlap; each beyond k that starts before x adds its share
            for _ in range(4):
                at = np.minimum(k, max(0, len(start) - 1))
                hit = inside & (start[at] < x) & (end[at] > x) if len(start) else np.zeros(len(x), bool)
                part = part + np.where(hit, (x - start[at]) / width[at], 0) if len(start) else part
                k2 = k + hit
                inside = hit & (k2 < len(start))
                if not hit.any():
                    break
                k = np.where(hit, k2, k)
            return cover[np.searchsorted(end, x, "right")] + part

        return upto(sec_end) - upto(sec_start)
    at = start if rule == "first" else (start + end - 1) // 2
    return np.searchsorted(at, sec_end, "left") - np.searchsorted(at, sec_start, "left")


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], tuple[np.ndarray, np.ndarray]] = line_sections, rule: str = "middle", path: str | None = None) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing): one row per section of each document, in characters, with the
    tokens it is given and the tokens that touch it but reach over its ends. sections gives each text's spans, the
    lines by default; with spans that cover a text once, the counts of a document sum to its tokens.

    Each document is encoded once and whole. A null or empty text has no sections and gives no row; repeated rows give
    repeated rows; other columns are not read; an empty table gives an empty result."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for rows, texts in text_slices(batches):
            owner, parts = [], []
            for i, raw in enumerate(texts):
                if not raw:
                    continue
                text = raw.decode()
                start, end = token_spans(np.frombuffer(bpe.ids(text), "<u4"), bpe.sizes, raw)
                a, b = sections(text)
                given = allocate(start, end, a, b, rule)
                ends = np.maximum.accumulate(end) if len(end) else end
                # tokens with start < x < end, for both ends x; those over both ends count once
                (la, ra), (lb, rb) = ((np.searchsorted(start, x, "left"), np.searchsorted(ends, x, "right")) for x in (a, b))
                over = (la - ra) + (lb - rb) - np.maximum(la - rb, 0)
                owner.append(np.full(len(a), i))
                parts.append(np.stack([np.arange(len(a)), a, b, given, over]).astype(np.float64))
            at = np.concatenate(owner) if owner else np.empty(0, np.int64)
            n, a, b, given, over = np.concatenate(parts, 1) if parts else np.empty((5, 0))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), pa.array(n.astype(np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(given), pa.array(over.astype(np.int64))], ["id", "section", "start", "end", "n_tokens", "n_crossing"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, section int, start long, end long, n_tokens double, n_crossing long")
