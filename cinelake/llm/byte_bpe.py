"""Operator 7, byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import Memo, id_and_text, slices
from cinelake.llm.token_counts import SAFE


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable, else 256 and up in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The library's encoder for a rank file, and the reversed byte table for decoding."""

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars, ranks = byte_characters(), read_ranks(path)
        shown = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        # any two neighbours whose concatenation has a rank may merge, lowest rank first
        merges = [
            (shown[token[:cut]], shown[token[cut:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: i for t, i in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values()) + 1
        self.table = [b""] * size
        for text, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.table[i] = bytes(map(byte_of.__getitem__, text))
        import regex

        # one character a byte, and matches of the pattern one by one: the model alone makes a third of the work of its whole pipeline
        self.model, self.pattern, self.shown = self.tokenizer.model, regex.compile(pattern), str.maketrans(dict(enumerate(chars)))
        self.inner, self.first = (Memo(lambda new, lead=lead: self._learn(new, lead)) for lead in (" ", ""))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Equal pieces between safe cuts are encoded once."""
        parts = [t.split(" ") for t in texts]
        inner, first = self.inner.of({w for p in parts for w in p[1:]}), self.first.of({p[0] for p in parts})
        out = []
        for text, p in zip(texts, parts):
            try:
                out.append(first[p[0]] + b"".join(map(inner.__getitem__, p[1:])))
            except TypeError:  # a piece has None: some cut isn't safe, only the others are made
                out.append(b"".join(map(self._encoded, SAFE.split(text))))
        return out

    def _learn(self, new: list[str], lead: str) -> list[tuple[str, bytes | None]]:
        return [(p, self._encoded(lead + p) if p and not p[0].isspace() and not p[-1].isspace() else None) for p in new]

    def _encoded(self, text: str) -> bytes:
        found = [t.id for m in self.pattern.finditer(text) for t in self.model.tokenize(m[0].encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown))]
        return struct.pack(f"<{len(found)}I", *found)

    def starts(self, text: str) -> bytes:
        """The character at which each token starts (that its first byte belongs to), as the library's offsets have it."""
        return _packed([start for start, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets])

    def decode(self, packed: bytes) -> bytes:
        """The bytes of the ids; a character whose bytes lie in several tokens comes whole again, as bytes are joined before any decoding."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _packed(numbers: list[int]) -> bytes:
    return np.array(numbers, "<u4").tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids[, starts]) for each row: packed little-endian unsigned 32-bit integers.

    With offsets, starts holds for each token the character where it starts; tokens that split a
    character share its offset. Null and empty texts have no tokens (an empty ids, not null). Every
    input row gives one row; other columns of docs don't matter. `ranks_path` must be readable on
    every executor. One pass, no shuffle.
    """

    def run(batches):
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            c = codec(ranks_path, pattern)
            ids = c.ids(texts)
            columns = {"id": batch.column("id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if offsets:
                columns["starts"] = pa.array(map(c.starts, texts), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids binary" + ", starts binary" * offsets)
    return out.withColumnRenamed("id", "doc_id")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds `decoded` (binary) to the rows of encode(): the bytes that the ids stand for. Null ids decode to no bytes."""

    def run(batches):
        for batch in slices(batches, "ids"):
            c = codec(ranks_path, pattern)
            decoded = [c.decode(x) for x in pc.fill_null(batch.column("ids"), b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of encode() and then decode(), in one Python step: two would keep two sets of workers, and their memory, at the same time."""

    def run(batches):
        for batch in slices(batches):
            c = codec(ranks_path, pattern)
            ids = c.ids(pc.fill_null(batch.column("text"), "").to_pylist())
            columns = [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def encoded_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of round_trip()."""
    both = round_trip(docs, ranks_path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
