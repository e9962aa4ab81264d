"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: a backtracking encoder.  A text is cut by the vocabulary's published
split pattern; each piece is encoded once per worker and remembered.  An
Aho-Corasick automaton over the vocabulary gives, for every byte position, the
tokens that start there, longest first.  The encoder takes the longest token
whose pair with the one before is *compatible* (the merges, run on the two
tokens' bytes, would leave exactly these two), and steps back where none is.
A position that failed once is never entered again, so the time is linear in
the piece, and the result equals that of the merges.

Decoding takes the bytes of all tokens as one string with an offset table.

Null and empty texts have no ids.  The strings of special tokens are ordinary
text.  The vocabulary file is read once on the driver and sent to the workers
(about 1 MB whatever the data's size).
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT_TOKENIZER = "byte_bpe_50k"

#: Unicode white space, as the published pattern means it.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The published split pattern, with white space spelt out.
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_ASCII_SPACE = r"\t\n\x0b\x0c\r "
_ASCII_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_ASCII_SPACE}A-Za-z0-9]+|[{_ASCII_SPACE}]+(?![^{_ASCII_SPACE}])|[{_ASCII_SPACE}]+"

#: Pieces a worker remembers before it forgets all of them (about 100 bytes each).
REMEMBERED = 400_000
#: Checked pairs of tokens a worker remembers before it forgets all of them.
MOST_PAIRS = 1_000_000
#: Roles that a line of a transcript may begin with, and those whose turns bear loss.
ROLES = ("system", "user", "human", "tool", "assistant", "agent")
LOSS_ROLES = ("assistant", "agent")


def read_ranks(name: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR) -> list[bytes]:
    """The byte strings of all tokens, by id."""
    tokens: dict[int, bytes] = {}
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        for line in lines:
            text, _, rank = line.strip().partition(b" ")
            if rank:
                tokens[int(rank)] = base64.b64decode(text)
    return [tokens[i] for i in range(len(tokens))]


class BytePairEncoder:
    """Exact byte-pair encoding by longest matches, pair checks and steps back."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.unicode_pieces = regex.compile(_PATTERN).findall
        self.ascii_pieces = re.compile(_ASCII_PATTERN).findall
        self.compatible: dict[tuple[int, int], bool] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._known: dict[str, int] = {}
        self._flat: list[int] = []
        self._starts: list[int] = [0]

    # -- the pair table -----------------------------------------------------
    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge joins into this one; itself twice if it is a byte."""
        found = self._parts.get(token)
        if found is None:
            b = self.tokens[token]
            if len(b) == 1:
                found = (token, token)
            else:
                # the merges below this token's rank, applied to its bytes, end in two parts
                own = [self.ids[b[i : i + 1]] for i in range(len(b))]
                while len(own) > 2:
                    joined = [self.ids.get(self.tokens[x] + self.tokens[y], token) for x, y in zip(own, own[1:], strict=False)]
                    best = min(joined)
                    if best >= token:
                        raise ValueError(f"token {token} can't be reached by merges")
                    i = joined.index(best)
                    own[i : i + 2] = [best]
                found = (own[0], own[1])
            self._parts[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens next to each other as they are.

        Undo the later of the two last merges, step by step: at each step the
        two tokens that face each other at the seam must not form a token of a
        rank that would have been merged earlier.
        """
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MOST_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        before = len(self.tokens)  # merges of a rank below this one have happened by now
        while True:
            across = self.ids.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < before:
                # it is one merge only if its own parts meet at this seam
                if self.parts(across) == (left, right):
                    return False
            undo_left = left > right
            if undo_left:
                inner = self.parts(left)[1]
                if inner != left:
                    before, left = left, inner
                    continue
                before, outer = right + 1, self.parts(right)[0]
                if outer == right:
                    return True
                right = outer
            else:
                outer = self.parts(right)[0]
                if outer != right:
                    before, right = right + 1, outer
                    continue
                before, inner = left, self.parts(left)[1]
                if inner == left:
                    return True
                left = inner

    # -- encoding -----------------------------------------------------------
    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        if n == 1:
            return [self.ids[piece]]
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            starting[end - size + 1].append(token)
        sizes = self.tokens
        for options in starting:
            if len(options) > 1:
                options.sort(key=lambda t: len(sizes[t]))  # the longest is taken from the end
        dead = bytearray(n + 1)
        out: list[int] = []
        at = 0
        choices = [starting[0].copy()]
        while at < n:
            options = choices[-1]
            taken = None
            while options:
                t = options.pop()
                end = at + len(sizes[t])
                if not dead[end] and (not out or self.fits(out[-1], t)):
                    taken = t
                    break
            if taken is None:
                dead[at] = 1
                choices.pop()
                if not out:
                    raise ValueError("the vocabulary doesn't cover this text")
                at -= len(sizes[out.pop()])
            else:
                out.append(taken)
                at += len(sizes[taken])
                if at < n:
                    choices.append(starting[at].copy())
        return out

    def pieces(self, text: str) -> list[str]:
        return self.ascii_pieces(text) if text.isascii() else self.unicode_pieces(text)

    def _code(self, piece: str) -> int:
        code = self._known[piece] = len(self._starts) - 1
        self._flat.extend(self.encode_piece(piece.encode()))
        self._starts.append(len(self._flat))
        return code

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the texts in it."""
        known, codes, counts = self._known, [], [0]
        if len(known) > REMEMBERED:
            known.clear()
            self._flat, self._starts = [], [0]
        for text in texts:
            if text:
                own = self.pieces(text)
                found = [known.get(p) for p in own] if len(own) < 64 else list(map(known.get, own))
                if None in found:
                    found = [self._code(p) if (c := known.get(p)) is None else c for p in own]
                codes.extend(found)
            counts.append(len(codes))
        starts = np.asarray(self._starts, dtype=np.int64)
        flat = np.asarray(self._flat, dtype=np.int32)
        code = np.asarray(codes, dtype=np.int64)
        size = starts[code + 1] - starts[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(starts[code] - ends[:-1], size) + np.arange(ends[-1])
        return flat[take] if len(take) else np.zeros(0, np.int32), ends[np.asarray(counts)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


class OffsetDecoder:
    """Bytes of ids by one string of all tokens and an offset table."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.offsets[ids] - ends[:-1], size) + np.arange(ends[-1])
        flat = self.blob[take].tobytes()
        cut = ends[offsets]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_SHARED: dict[tuple[str, str, str], object] = {}


def _shared_ranks(spark: SparkSession, tokenizer: str, folder: str):
    """The vocabulary as a broadcast, one for each application and vocabulary (a fixed file of about 1 MB)."""
    ship(spark)
    key = (spark.sparkContext.applicationId, tokenizer, folder)
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(read_ranks(tokenizer, folder))
    return _SHARED[key]


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def _encoder(shared, key: tuple[str, str]) -> BytePairEncoder:
    """The encoder of this worker process, made once for each vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(shared.value)
    return _ENCODERS[key]


def _slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice have about ``most`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    cut = np.cumsum(sizes) // most
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cut)) + 1]) if len(cut) else np.zeros(0, int)
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row per row of ``documents``: its id and ``ids``, the token ids of its text.

    Null and empty texts get an empty list; a null id stays null; repeated rows
    give repeated rows; other columns are ignored.
    """
    shared = _shared_ranks(documents.sparkSession, tokenizer, folder)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, (tokenizer, folder))
        for batch in batches:
            for part in _slices(batch, "text"):
                ids, offsets = encoder.encode_batch(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=[id_col, "ids"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """The id of each row and ``n_tokens`` of its text (0 for null and empty)."""
    shared = _shared_ranks(documents.sparkSession, tokenizer, folder)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, (tokenizer, folder))
        for batch in batches:
            for part in _slices(batch, "text"):
                offsets = encoder.encode_batch(part.column("text").to_pylist())[1]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets), pa.int64())], names=[id_col, "n_tokens"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def loss_spans(text: str, roles: tuple[str, ...] = ROLES, loss_roles: tuple[str, ...] = LOSS_ROLES) -> list[tuple[int, int]] | None:
    """Bytes of a transcript that bear loss: the turns of ``loss_roles``, without their marks.  None for a text without turns, of which all bears loss."""
    turns = list(re.finditer(rf"(?m)^({'|'.join(roles)}):", text))
    if not turns:
        return None
    ends = [*[t.start() for t in turns[1:]], len(text)]
    chars = [(t.end(), end) for t, end in zip(turns, ends, strict=True) if t.group(1) in loss_roles]
    if text.isascii():
        return chars
    at = lambda i: len(text[:i].encode())
    return [(at(a), at(b)) for a, b in chars]


def count_pieces(documents: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each text: the id, ``piece``, ``first_token``, ``n_tokens``, ``loss_tokens``.

    Loss-bearing are, in a transcript, the tokens that begin in the turns of an
    assistant, and in other texts all; of each piece the first token is not, as
    nothing precedes it.  Null and empty texts are one piece without tokens.
    """
    shared = _shared_ranks(documents.sparkSession, tokenizer, folder)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, (tokenizer, folder))
        lengths = np.array([len(t) for t in encoder.tokens], dtype=np.int64)
        for batch in batches:
            for part in _slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids, offsets = encoder.encode_batch(texts)
                bears = np.ones(len(ids), dtype=bool)
                for n, text in enumerate(texts):
                    spans = loss_spans(text) if text and ":" in text else None
                    if spans is not None:
                        a, b = offsets[n], offsets[n + 1]
                        begins = np.cumsum(lengths[ids[a:b]]) - lengths[ids[a:b]]
                        # between the edges of the spans a place is inside where an odd number of edges is passed
                        bears[a:b] = np.searchsorted(np.asarray(spans, np.int64).ravel(), begins, side="right") % 2 == 1
                count = np.diff(offsets)
                pieces = np.maximum(1, -(-count // capacity))
                row = np.repeat(np.arange(len(count)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = piece * capacity
                size = np.minimum(capacity, count[row] - first)
                begin = offsets[row] + first
                total = np.concatenate([[0], np.cumsum(bears)])
                loss = total[begin + size] - total[begin]
                loss -= np.where(size > 0, np.append(bears, False)[np.minimum(begin, len(bears))], 0)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(loss, pa.int64())], names=[id_col, "piece", "first_token", "n_tokens", "loss_tokens"])

    schema = f"`{id_col}` {kind}, piece int, first_token bigint, n_tokens bigint, loss_tokens bigint"
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def round_trip(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """The id of each row, its ``n_tokens`` and ``same``: whether decoding the ids gives the text."""
    shared = _shared_ranks(documents.sparkSession, tokenizer, folder)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared, (tokenizer, folder)), OffsetDecoder(shared.value)
        for batch in batches:
            for part in _slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids, offsets = encoder.encode_batch(texts)
                back = decoder.decode_batch(ids, offsets)
                same = [b == (t or "").encode() for b, t in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "same"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, same boolean")
