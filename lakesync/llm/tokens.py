"""Token ids of Arrow text columns through the tokenizers library.

Natural text repeats its words, so a task cuts each text where the cut provably
cannot change the ids, hands every distinct part to the tokenizer once and
gathers the ids of all texts from that table with numpy.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# White space of any Unicode definition; a cut next to two of them is not safe.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f"[ \\n]{_WS}|{_WS}[ \\n]"
_SPACED = f"^ [^{_WS[1:]}+$"
_SOLID = f"^[^{_WS[1:]}+$"
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class PartTable:
    """Ids of the distinct text parts seen so far by this Python worker.

    Arrow strings beside flat arrays (about 30 bytes a part), emptied beyond
    ``limit`` parts or 64 bytes for each of these, so the memory of a worker is
    bounded, also where parts are long."""

    def __init__(self, encode, limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self):
        self.known = pa.array([], pa.large_string())
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def rows(self, parts: pa.Array) -> np.ndarray:
        """Row numbers of ``parts`` (distinct) in the table."""
        if len(self.known) > self.limit or self.known.nbytes + self.flat.nbytes > 64 * self.limit:
            self._clear()
        found = pc.index_in(parts, value_set=self.known)
        out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = parts.take(pa.array(missing))
            flat, lens = self.encode(new)
            out[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(lens)))
            self.flat = np.concatenate((self.flat, flat))
        return out

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.start[rows + 1] - self.start[rows]

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of ``rows`` in order, concatenated."""
        lens = self.lengths(rows)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.start[rows] - (ends - lens), lens)
        return self.flat[np.arange(total) + shift]


def joined_encoder(tok, joint: str, joinable: str, line: int = 128):
    """A function from distinct parts to (flat ids, ids per part).

    A call of the library costs more than a short word, so parts that match
    ``joinable`` (and hold no special string) go to it in lines of ``line``
    parts joined by ``joint``; the offsets of the ids tell the parts apart.
    All other parts are encoded alone."""

    def encode(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.and_(pc.match_substring_regex(parts, joinable), pc.invert(pc.match_substring(parts, "<|")))
        plain = plain.to_numpy(zero_copy_only=False)
        strings = parts.to_pylist()
        lens = np.zeros(len(strings), np.int64)
        order, chunks = [], []
        at = np.flatnonzero(plain)
        groups = [at[k:k + line] for k in range(0, len(at), line)]
        # an encoding keeps much beside its ids, so few are held at a time
        few = (tok.encode_batch([joint.join([strings[i] for i in g]) for g in groups[k:k + 32]], add_special_tokens=False)
               for k in range(0, len(groups), 32))
        for own, e in zip(groups, (e for some in few for e in some)):
            size = np.fromiter((len(strings[i]) for i in own), np.int64, len(own)) + len(joint)
            begin = np.cumsum(size) - size
            where = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            lens[own] = np.bincount(np.searchsorted(begin, where, side="right") - 1, minlength=len(own))
            chunks.append(np.asarray(e.ids, np.uint32))
        order.append(at)
        alone = np.flatnonzero(~plain)
        few = (tok.encode_batch([strings[i] for i in alone[k:k + 1024]], add_special_tokens=False) for k in range(0, len(alone), 1024))
        for i, e in zip(alone, (e for some in few for e in some)):
            lens[i] = len(e.ids)
            chunks.append(np.asarray(e.ids, np.uint32))
        order.append(alone)
        order = np.concatenate(order)
        flat = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
        if len(alone) == 0 or len(at) == 0:
            return flat, lens
        # back to the order of the parts
        own = lens[order]
        begin = np.empty(len(strings), np.int64)
        begin[order] = np.cumsum(own) - own
        ends = np.cumsum(lens)
        return flat[np.arange(int(ends[-1])) + np.repeat(begin - (ends - lens), lens)], lens

    return encode


def _parts_to_rows(part_table: PartTable, parts: pa.Array) -> np.ndarray:
    coded = parts.dictionary_encode()
    rows = part_table.rows(coded.dictionary)
    return rows[coded.indices.to_numpy(zero_copy_only=False)]


def unsliced(text: pa.Array) -> pa.Array:
    """The strings in buffers of their own (some Arrow string kernels misread the offset of a slice)."""
    return text.cast(pa.large_string()).take(pa.array(np.arange(len(text))))


def whitespace_parts(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts between ASCII white space and the n + 1 bounds of the texts.

    For tokenizers whose pattern never matches white space, whose normalizer
    maps characters on their own and makes them lower case.  A full stop or
    comma after a letter and before white space is a part of its own, and ASCII
    letters are made lower case first, which leaves fewer distinct parts; texts
    that may hold special strings are left as they are."""
    text = unsliced(text)
    special = pc.match_substring(text, "<|")
    lower = pc.replace_substring_regex(pc.ascii_lower(text), r"(\p{L})([.,])(\s|$)", r"\1 \2\3")
    if pc.any(special).as_py():
        lower = pc.if_else(special, text, lower)
    lists = pc.ascii_split_whitespace(lower)
    parts, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    return parts, bounds - bounds[0]


def spaced_parts(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts that each begin at a pre-token bound of the byte-level pattern.

    A space or line break between two characters that are no white space always
    begins a match of that pattern, and what precedes it never looks past it; so
    the ids of a text are those of its parts in order.  Texts where a space or
    line break has white space beside it are cut by a slower expression."""
    text = unsliced(text)
    n = len(text)
    unsafe = pc.match_substring_regex(text, _UNSAFE).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.replace_substring(text, "\n", " \n"), " ")
    parts, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    bare = pc.starts_with(parts, "\n").to_numpy(zero_copy_only=False).copy()
    bare[bounds[:-1]] = True
    joint = pa.array(["", " "], pa.large_string()).take(pa.array((~bare).astype(np.int64)))
    spaced = pc.binary_join_element_wise(joint, parts, pa.scalar("", pa.large_string()))
    if not unsafe.any():
        return spaced, bounds
    chunks, counts, at = [], np.diff(bounds), 0
    for i in np.flatnonzero(unsafe):
        one = [x for x in _SAFE_CUT.split(text[int(i)].as_py()) if x]
        chunks.append(spaced.slice(int(bounds[at]), int(bounds[i] - bounds[at])))
        chunks.append(pa.array(one, pa.large_string()))
        counts[i] = len(one)
        at = i + 1
    chunks.append(spaced.slice(int(bounds[at]), int(bounds[n] - bounds[at])))
    return pa.concat_arrays(chunks), np.concatenate(([0], np.cumsum(counts)))


def encode_column(part_table: PartTable, text: pa.Array, cut) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a text column, concatenated, and the n + 1 bounds of its rows."""
    parts, bounds = cut(text)
    rows = _parts_to_rows(part_table, parts)
    ends = np.concatenate(([0], np.cumsum(part_table.lengths(rows))))
    return part_table.gather(rows), ends[bounds]


def count_column(part_table: PartTable, text: pa.Array, cut) -> np.ndarray:
    """The number of ids of each text."""
    parts, bounds = cut(text)
    ends = np.concatenate(([0], np.cumsum(part_table.lengths(_parts_to_rows(part_table, parts)))))
    return np.diff(ends[bounds])


_LOADED: dict[tuple, object] = {}


def loaded(key: tuple, make):
    """One object per Python worker (a vocabulary is read once, not per batch)."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def json_tokenizer(path: str):
    """The tokenizers file at ``path`` as the library runs it by default."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_part_table(path: str) -> PartTable:
    """For a tokenizers file that drops white space (parts by :func:`whitespace_parts`)."""
    return loaded(("words", path), lambda: PartTable(joined_encoder(json_tokenizer(path), " ", _SOLID)))


def byte_part_table(key: tuple, make, limit: int = 1_000_000) -> PartTable:
    """For a byte-level tokenizer from ``make`` (parts by :func:`spaced_parts`)."""
    return loaded(("bytes", *key), lambda: PartTable(joined_encoder(make(), "", _SPACED), limit))


__all__ = ["PartTable", "joined_encoder", "whitespace_parts", "spaced_parts", "encode_column", "count_column", "loaded",
           "json_tokenizer", "word_part_table", "byte_part_table"]
