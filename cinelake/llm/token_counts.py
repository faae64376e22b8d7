"""Operator 1, token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import Memo, id_and_text, slices

#: Before a space or a line break between two non-spaces a byte-level vocabulary always ends a pre-token, and no special token holds one: texts may be cut there.
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Where there is no special token, a letter and a sign that is none, nor space or apostrophe, are apart too, as in scripts without spaces.
SAFE_SIGN = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[^\W\d_])(?=[.,;:!?)\]}\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
#: Count of a piece that begins or ends with white space, or is empty: where it touches a space there is no safe cut.
UNSAFE = -(1 << 50)
#: Bytes of pieces in one call of the library.
BATCH_BYTES = 1 << 20


@lru_cache(maxsize=2)
def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, *(Memo(lambda new, lead=lead: _learn(tokenizer, new, lead)) for lead in (" ", ""))


def balanced(pieces: list[str], budget: int = BATCH_BYTES) -> list[list[str]]:
    """Pieces in batches of about `budget` bytes (UTF-8) each, so that no call waits for one that got all the long ones."""
    out, held = [[]], 0
    for piece in pieces:
        size = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
        if held and held + size > budget:
            out.append([])
            held = 0
        out[-1].append(piece)
        held += size
    return out


def safe_pieces(text: str, special: bool) -> list[str]:
    """The text in pieces whose tokens add up to its own; special: it holds a special token."""
    return (SAFE if special else SAFE_SIGN).split(text)


def _learn(tokenizer, new: list[str], lead: str) -> list[tuple[str, int]]:
    known, out = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()], list(zip(new, [UNSAFE] * len(new)))
    for batch in balanced(known):
        encoded = tokenizer.encode_batch_fast([lead + p for p in batch], add_special_tokens=False)
        out += zip(batch, map(len, encoded))
    return out


def _lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text. Texts are cut at spaces; equal pieces are encoded once while the memo holds them, and their lengths added up."""
    tokenizer, inner, first = _library(path)
    parts = [t.split(" ") for t in texts]
    later, begin = inner.of({w for p in parts for w in p[1:]}), first.of({p[0] for p in parts})
    out = []
    for text, p in zip(texts, parts):
        n = begin[p[0]] + sum(map(later.__getitem__, p[1:]))
        if n < 0:  # some cut isn't safe: only the others are made
            special = any(t.content in text for t in tokenizer.get_added_tokens_decoder().values())
            n = sum(len(e) for b in balanced(safe_pieces(text, special)) for e in tokenizer.encode_batch_fast(b, add_special_tokens=False))
        out.append(n)
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, as the library counts the whole text.

    Null and empty texts have 0 bytes and tokens. Every input row gives one row, repeated rows and
    null ids included; other columns of docs don't matter. `tokenizer_path` is a tokenizers .json
    file of a byte-level vocabulary that every executor can read. One pass, no shuffle.
    """

    def run(batches):
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(_lengths(texts.to_pylist(), tokenizer_path), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
