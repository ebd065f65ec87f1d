"""Token counts by heap-and-linked-list byte-pair merging.

A text is split as a byte-level BPE splits it. In each piece, the lowest-rank adjacent pair is
popped from a heap and merged in a linked list until no pair is left; a piece of n bytes with m
merges has n - m tokens. No identifier is made. Pieces recur, so that each worker keeps the counts
of recent pieces; the map is cleared at a fixed size.

Null texts count as empty. Rows with a null id keep it. Repeated rows are counted each. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracequarry.llm.common import id_and_text, slices

#: How byte-level BPE splits texts before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_counters: dict[int, "Counter"] = {}


def byte_symbols() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Counter:
    """Counts the tokens of texts for one vocabulary file's content."""

    def __init__(self, vocabulary: bytes, keep: int = 1_000_000):
        spec = json.loads(vocabulary)
        back = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda s: bytes(back[c] for c in s)
        self.ranks: dict[int, int] = {}  # by the two symbols, as one integer
        numbers = {bytes([b]): b for b in range(256)}
        self.made: list[int] = []  # the symbol that a rank's merge makes; equal strings are one symbol
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.made.append(numbers.setdefault(left + right, len(numbers)))
            self.ranks.setdefault(numbers[left] << 32 | numbers[right], rank)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.specials, self.pieces = specials, regex.compile(PIECES)
        self.known, self.keep = {}, keep

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes less the merges."""
        n = len(piece)
        if n < 2:
            return n
        rank_of, made, part = self.ranks.get, self.made, [*piece, -1]
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(part[i] << 32 | part[i + 1], -1)) >= 0]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        merges = 0
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j, left = after[i], part[i]
            # an entry is stale if either symbol has changed since
            if left < 0 or j >= n or rank_of(left << 32 | part[j], -1) != entry >> 32:
                continue
            part[i] = symbol = made[entry >> 32]
            part[j] = -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank_of(symbol << 32 | part[k], -1)) >= 0:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(part[h] << 32 | symbol, -1)) >= 0:
                heappush(heap, r << 32 | h)
        return n - merges

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.pieces.findall(text) if len(text) < 1 << 20 else (m[0] for m in self.pieces.finditer(text)):
            n = known.get(piece)
            if n is None:
                n = self.merged(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= self.keep:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; an added token's string inside it is one token, as the library's default has it."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    The vocabulary file is read on the driver and broadcast; its size is fixed (about 2 MB) and
    does not depend on the data.
    """
    with open(vocabulary_path, "rb") as f:
        content = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(content), hash(content)

    def counted(batches):
        if key not in _counters:
            _counters[key] = Counter(shared.value)
        counter = _counters[key]
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(counted, SCHEMA)
