"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention does. Per buffer of whole
sequences, pieces go in descending order to the lowest-cost sequence that has room for them; a piece
that fits nowhere whole is cut. A buffer's sequences are filled to the last token and what is left
over starts the next buffer; the end of a partition is cut into sequences whose lengths are powers
of two. So no sequence has padding. Buffers are per task, without a shuffle: memory is bounded by
the buffer and the largest document.

Null texts are empty: their only token is the end id. Rows with a null id keep it; repeated rows are
packed each. An empty table gives no pieces. Other columns of the input are not read. Sequence ids
hold the partition's number above 32 bits of a count, so that a task run again gives the same ids.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracequarry.llm.common import id_and_text, slices, texts_as_bytes
from tracequarry.llm.token_counts import byte_symbols

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[int, "Encoder"] = {}


class Ids(dict):
    """Ids of pieces without ASCII white space, as bytes, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        out = self[piece] = self.make(piece)
        return out


class Encoder:
    """Ids of texts by a tokenizer whose splitting drops white space, so that the pieces between ASCII white space are independent.

    Pieces recur; their ids are kept in maps that are cleared at a fixed size. Pieces of ASCII and
    Latin-1 letters are normalised and split here and go to the tokenizer's model directly; all
    others go through the whole tokenizer.
    """

    #: How the tokenizer splits, and characters that its normaliser only lower-cases.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SIMPLE = r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+"

    def __init__(self, spec: str, end_id: int, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_str(spec), keep
        self.model, self.split, self.simple = self.tokenizer.model, regex.compile(self.SPLIT), regex.compile(self.SIMPLE)
        plain = json.loads(spec)
        usual = sys.byteorder == "little" and [s["type"] for s in plain["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and plain["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == self.SPLIT
        self.specials, self.usual = [t["content"] for t in plain["added_tokens"]], usual
        self.byte_symbols = dict(enumerate(byte_symbols()))
        self.end, self.known, self.parts = np.array([end_id], "<u4").tobytes(), Ids(self.piece), Ids(self.part)

    def part(self, text: str) -> bytes:
        """Ids of one split and lower-cased part."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.byte_symbols)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def piece(self, raw: bytes) -> bytes:
        if self.usual:
            if raw.isalpha():  # ASCII letters
                return self.parts[raw.lower().decode()]
            if raw[-1:] in b".,;:!?" and raw[:-1].isalpha():
                return self.parts[raw[:-1].lower().decode()] + self.parts[raw[-1:].decode()]
            text = raw.decode()
            if self.simple.fullmatch(text) and not (b"<" in raw and any(s in text for s in self.specials)):
                return b"".join([self.parts[x] for x in self.split.findall(text.lower())])
        return array("I", self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        for known in (self.known, self.parts):
            if len(known) > self.keep:
                known.clear()
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, t.split())) + self.end, "<u4") for t in texts]


class Packer:
    """Packs documents given one after another; rows of SCHEMA come out per buffer."""

    def __init__(self, base: int, capacity: int, sequences: int, linear: float, quadratic: float):
        self.next, self.capacity, self.sequences = base, capacity, sequences
        self.cost = lambda n: linear * n + quadratic * n * n
        self.waiting: list[tuple] = []  # (doc_id, ids, start, end)
        self.tokens = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.waiting.append((doc, ids, 0, len(ids)))
        self.tokens += len(ids)

    def full(self) -> bool:
        return self.tokens >= self.capacity * self.sequences

    def row(self, doc, ids, a, b, sequence, offset):
        return doc, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids), sequence, offset

    def pack(self) -> list[tuple]:
        """Fills tokens // capacity sequences; the rest waits."""
        cap, rows = self.capacity, []
        n, pieces = self.tokens // cap, []
        for doc, ids, a, b in self.waiting:
            while b - a >= cap and n:
                rows.append(self.row(doc, ids, a, a + cap, self.next, 0))
                self.next, a, n = self.next + 1, a + cap, n - 1
            if b > a:
                pieces.append((doc, ids, a, b))
        pieces.sort(key=lambda p: p[2] - p[3])
        room, cost, left = np.full(n, cap), np.zeros(n), []
        for doc, ids, a, b in pieces:
            while a < b:
                fits = room >= min(b - a, cap)
                if not fits.any():
                    fits = room > 0
                    if not fits.any():
                        left.append((doc, ids, a, b))
                        break
                k = int(np.argmin(np.where(fits, cost, np.inf)))
                take = min(b - a, int(room[k]))
                rows.append(self.row(doc, ids, a, a + take, self.next + k, int(cap - room[k])))
                room[k] -= take
                cost[k] += self.cost(take)
                a += take
        self.next += n
        self.waiting, self.tokens = left, sum(b - a for _, _, a, b in left)
        return rows

    def finish(self) -> list[tuple]:
        """The rest, in sequences whose lengths are powers of two."""
        rows, size, offset = self.pack(), 0, 0
        for doc, ids, a, b in self.waiting:
            while a < b:
                if offset == size:
                    size, offset = 1 << (self.tokens.bit_length() - 1), 0
                    self.next += 1
                take = min(b - a, size - offset)
                rows.append(self.row(doc, ids, a, a + take, self.next - 1, offset))
                a, offset, self.tokens = a + take, offset + take, self.tokens - take
                if offset == size:
                    size = offset = 0
        self.waiting = []
        return rows


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, sequences: int = 256, linear: float = 1.0, quadratic: float = 1 / 4096, id_col: str = "doc_id", text_col: str = "text", keep: int = 500_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The tokenizer's file is read on the driver and broadcast; its size is fixed. A buffer holds the
    tokens of ``sequences`` sequences and one more document, a worker the ids of at most about ``keep``
    pieces of text, some 200 bytes each.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(spec), hash((spec, end_id, keep))

    def packed(batches):
        if key not in _encoders:
            _encoders[key] = Encoder(shared.value, end_id, keep)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, sequences, linear, quadratic)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], SCHEMA.replace(" long", "").split(", "))
        for batch in slices(batches, 500):
            for doc, ids in zip(batch["id"].to_pylist(), _encoders[key].encode(texts_as_bytes(batch["text"])), strict=True):
                packer.add(doc, ids)
                if packer.full() and (rows := packer.pack()):
                    yield made(rows)
        if rows := packer.finish():
            yield made(rows)

    return id_and_text(docs, id_col, text_col).mapInArrow(packed, SCHEMA)
