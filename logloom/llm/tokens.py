"""Token ids of whole texts, as flat arrays, by the tokenizers library.

The vocabulary that is used here drops white space and joins no tokens across it, so a text's
ids are the ids of its space-separated chunks one after another. Chunks repeat: each distinct one
is tokenized once and looked up from then on. It lower-cases and ends words at a full stop or comma, so ASCII chunks
are looked up in lower case and without the one mark behind them, which keeps the table small. The table is bounded in
bytes; when it is full, the half that was not used lately goes.

The marks of special tokens are ordinary text here (`encode_special_tokens`), as the vocabulary's own documentation
has it: a text that mentions one has the ids of its characters and no control token.

Null texts are empty; an empty text, or one of white space, has no ids but the end id. Texts may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Bytes that a table of known chunks may take, about.
MAX_BYTES = 240 << 20
#: What a known chunk takes besides its characters and ids.
ENTRY_BYTES = 180
#: Texts are tokenized in groups of about so many bytes.
GROUP_BYTES = 4 << 20
#: Letters that the vocabulary's normaliser only lower-cases, alone or before one run of marks, which is a piece of its own.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;=?@^_~-]*)")
#: ASCII words before one mark that is a token of its own.
STOPPED = "^[A-Za-z]+[.,]$"


class Encoder:
    """Encodes texts without special tokens; `end_id` follows each text."""

    def __init__(self, path: str, end_id: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end_id = end_id
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xC0, 0x100)]
        self.byte_names = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in letters})
        self.stop_ids = np.array([0, *[self.tokenizer.model.tokenize(mark)[0].id for mark in ".,"]], np.uint32)
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.used_in = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.characters, self.group = 0, 0

    def full(self) -> bool:
        return ENTRY_BYTES * len(self.known) + self.characters + 4 * self.used > MAX_BYTES

    def forget(self) -> None:
        """Drop the chunks whose last use is longest ago, half of them or more."""
        n = len(self.known)
        stay = self.used_in[:n] > np.median(self.used_in[:n])
        rows = np.flatnonzero(stay)
        sizes = self.sizes[rows].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(total)
        self.pool[:total] = self.pool[at]
        self.known = {c: i for i, c in enumerate(c for c, s in zip(self.known, stay.tolist(), strict=True) if s)}
        for values in (self.starts, self.sizes, self.used_in):
            values[: len(rows)] = values[rows]
        self.starts[: len(rows)] = ends - sizes
        self.used, self.characters = total, sum(map(len, self.known))

    def chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; plain words go straight to the model, others through all steps."""
        out: list[list[int] | None] = []
        model, rest = self.tokenizer.model, []
        for chunk in chunks:
            if (m := SIMPLE.fullmatch(chunk)) is None:
                rest.append(len(out))
                out.append(None)
                continue
            word, stop = m.groups()
            word = word.lower()
            ids = [t.id for t in model.tokenize(word if word.isascii() else word.translate(self.byte_names))]
            if stop:
                ids += [t.id for t in model.tokenize(stop)]
            out.append(ids)
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def places(self, chunks: list[str]) -> np.ndarray:
        """Row of each chunk in `starts` and `sizes`, after learning the unknown ones."""
        if self.full():
            self.forget()
        known = self.known
        self.group += 1
        new = [c for c in chunks if c not in known]
        if new:
            ids = self.chunk_ids(new)
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            first, rows = len(known), len(known) + len(new)
            while rows > len(self.starts):
                self.starts, self.sizes, self.used_in = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.used_in))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            self.sizes[first:rows] = sizes
            self.starts[first:rows] = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            self.characters += sum(map(len, new))
            known.update(zip(new, range(first, rows), strict=True))
        found = np.fromiter((known[c] for c in chunks), np.int64, len(chunks))
        self.used_in[found] = self.group
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin in them (one more entry than texts)."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        keys, stops = looked_up_as(coded.dictionary)
        rows = self.places(keys.dictionary.to_numpy(zero_copy_only=False).tolist())[keys.indices.to_numpy(zero_copy_only=False)]
        own_sizes = self.sizes[rows] + (stops > 0)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = own_sizes[index].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[rows][index] - (ends - sizes), sizes)
        at += np.arange(len(at))
        stops = stops[index]
        stopped = np.flatnonzero(stops)
        at[ends[stopped] - 1] = 0  # a mark's place is not in the pool
        ids = self.pool[at]
        ids[ends[stopped] - 1] = self.stop_ids[stops[stopped]]
        bounds = np.concatenate([[0], ends])[bounds]
        if self.end_id is None:
            return ids, bounds
        whole = np.empty(len(ids) + len(texts), np.uint32)
        bounds = bounds + np.arange(len(bounds))
        last = np.zeros(len(whole), bool)
        last[bounds[1:] - 1] = True
        whole[last], whole[~last] = self.end_id, ids
        return whole, bounds


def looked_up_as(chunks: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The text under which each chunk is known, and the mark behind it: 0 for none, 1 or 2 for a full stop or comma."""
    # Only ASCII: a capital before a combining mark has other ids than its small letter.
    keys = pc.if_else(pc.string_is_ascii(chunks), pc.ascii_lower(chunks), chunks)
    stopped = pc.match_substring_regex(chunks, STOPPED)
    keys = pc.if_else(stopped, pc.ascii_rtrim(keys, characters=".,"), keys)
    marks = pc.if_else(stopped, pc.if_else(pc.ends_with(chunks, "."), 1, 2), 0)
    return keys.dictionary_encode(), marks.to_numpy(zero_copy_only=False).astype(np.int64)


def groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text, one row at least.

    What Arrow held for a range is given back before the next: a worker that lives long stays small.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            pa.default_memory_pool().release_unused()
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
    pa.default_memory_pool().release_unused()


def encoded(texts: pa.Array, encoder: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of rows: first row, row behind the last, ids and bounds. Null texts are empty."""
    texts = pc.fill_null(texts, "")
    for start, stop in groups(texts):
        yield start, stop, *encoder.encode(texts[start:stop])


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder_for(path: str, end_id: int | None) -> Encoder:
    """One encoder per Python worker, so that what it has learned serves later tasks too."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
