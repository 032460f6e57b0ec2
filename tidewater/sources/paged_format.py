"""The paged columnar file format, version 3: encoding and selective decoding.

    magic | pages of each column of each row group | footer | footer bytes (u32) | magic

A page is a header (u32 size, then kind u8, encoding u8, rows, plain and stored bytes u32) and
plain values; strings are their total bytes (u32), rows + 1 offsets (u32) and the bytes. The
footer holds names and types, and least and greatest value, place and size of each column
chunk and page. Numbers are little-endian. Nulls can't be held.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the format: magic, version, type numbers.
MAGIC = b"FVX3"
VERSION = 3
INTEGER, BIGINT, VARCHAR = 3, 4, 7

_ARROW = {INTEGER: pa.int32(), BIGINT: pa.int64(), VARCHAR: pa.string()}
_KIND = {v: k for k, v in _ARROW.items()}
_NUMBER = {INTEGER: "<i", BIGINT: "<q"}
PAGE = struct.Struct("<BBIII")
COMPARE = {"EQ": pc.equal, "NE": pc.not_equal, "LT": pc.less, "LE": pc.less_equal, "GT": pc.greater, "GE": pc.greater_equal}


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


def _least_greatest(kind: int, column: pa.Array) -> bytes:
    if kind == VARCHAR:
        as_bytes = column.cast(pa.binary())  # strings compare by their bytes
        low, high = (pc.min_max(as_bytes).as_py()[k] for k in ("min", "max"))
        return struct.pack("<I", len(low)) + low + struct.pack("<I", len(high)) + high
    bounds = pc.min_max(column).as_py()
    return struct.pack(_NUMBER[kind], bounds["min"]) + struct.pack(_NUMBER[kind], bounds["max"])


def _payload(kind: int, column: pa.Array) -> bytes:
    if kind != VARCHAR:
        return column.to_numpy().tobytes()
    parts = [x.encode() for x in column.to_pylist()]
    offsets = np.cumsum([0, *map(len, parts)]).astype("<u4")
    return struct.pack("<I", int(offsets[-1])) + offsets.tobytes() + b"".join(parts)


def encode(table: pa.Table, row_group: int = 1024, page: int = 256) -> bytes:
    """A whole file; 0 rows a group (or page) means no limit."""
    if not table.num_columns:
        raise ValueError("at least one column")
    kinds = []
    for name, column in zip(table.column_names, table.columns):
        if column.type not in _KIND:
            raise ValueError(f"{name}: the format holds INTEGER, BIGINT and VARCHAR")
        if column.null_count:
            raise ValueError(f"{name}: the format holds no nulls")
        kinds.append(_KIND[column.type])
    table = table.combine_chunks()
    group_rows = row_group or max(1, table.num_rows)
    page_rows = page or group_rows
    out = bytearray(MAGIC)
    footer = bytearray(struct.pack("<II", VERSION, len(kinds)))
    for name, kind in zip(table.column_names, kinds):
        footer += _text(name) + bytes([kind])
    groups = range(0, table.num_rows, group_rows)
    footer += struct.pack("<I", len(groups))
    for first in groups:
        group = table.slice(first, group_rows)
        footer += struct.pack("<I", group.num_rows)
        for kind, column in zip(kinds, group.columns):
            values = pa.concat_arrays(column.chunks)
            begin, described = len(out), bytearray()
            starts = range(0, len(values), page_rows)
            for at in starts:
                part = values.slice(at, page_rows)
                data = _payload(kind, part)
                place = len(out)
                out += struct.pack("<I", PAGE.size) + PAGE.pack(0, 0, len(part), len(data), len(data)) + data
                described += struct.pack("<IIQQII", at, len(part), place, len(out) - place, len(data), len(data)) + _least_greatest(kind, part)
            footer += struct.pack("<QQ", begin, len(out) - begin) + _least_greatest(kind, values) + struct.pack("<I", len(starts)) + described
    return bytes(out + footer + struct.pack("<I", len(footer)) + MAGIC)


@dataclass
class Page:
    start: int
    rows: int
    offset: int
    length: int
    low: object
    high: object


@dataclass
class Chunk:
    low: object
    high: object
    pages: list[Page]


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        found = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return found if len(found) > 1 else found[0]

    def raw(self) -> bytes:
        size = self.take("<I")
        self.at += size
        if self.at > len(self.data):
            raise ValueError("the footer is cut off")
        return self.data[self.at - size : self.at]

    def bound(self, kind: int):
        return self.raw() if kind == VARCHAR else self.take(_NUMBER[kind])


class PagedFile:
    """Reads a file through seek, read and size; counts the pages it decodes."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < 12 or self._bytes(0, 4) != MAGIC or self._bytes(size - 4, 4) != MAGIC:
            raise ValueError("not a paged file")
        length = struct.unpack("<I", self._bytes(size - 8, 4))[0]
        if length > size - 12:
            raise ValueError("the footer is longer than the file")
        cursor = _Cursor(self._bytes(size - 8 - length, length))
        if (version := cursor.take("<I")) != VERSION:
            raise ValueError(f"version {version}")
        self.names, self.kinds, self.groups = [], [], []
        for _ in range(cursor.take("<I")):
            self.names.append(cursor.raw().decode())
            self.kinds.append(cursor.take("<B"))
        if unknown := set(self.kinds) - set(_ARROW):
            raise ValueError(f"types {unknown}")
        for _ in range(cursor.take("<I")):
            rows, chunks = cursor.take("<I"), []
            for kind in self.kinds:
                cursor.take("<QQ")
                chunk = Chunk(cursor.bound(kind), cursor.bound(kind), [])
                expected = 0
                for _ in range(cursor.take("<I")):
                    start, count, offset, total, _, _ = cursor.take("<IIQQII")
                    if start != expected or offset + total > size:
                        raise ValueError("pages don't follow each other")
                    expected += count
                    chunk.pages.append(Page(start, count, offset, total, cursor.bound(kind), cursor.bound(kind)))
                if expected != rows:
                    raise ValueError("pages don't make up the row group")
                chunks.append(chunk)
            self.groups.append((rows, chunks))
        self.decoded = 0

    def _bytes(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def schema(self) -> pa.Schema:
        return pa.schema([(n, _ARROW[k]) for n, k in zip(self.names, self.kinds)])

    def place(self, number: int) -> int:
        """Where a row group begins in the file."""
        return min(p.offset for chunk in self.groups[number][1] for p in chunk.pages[:1])

    def _page(self, kind: int, page: Page) -> pa.Array:
        self.decoded += 1
        data = self._bytes(page.offset, page.length)
        head = struct.unpack_from("<I", data)[0]
        page_type, encoding, rows, plain, _ = PAGE.unpack_from(data, 4)
        if page_type or encoding or rows != page.rows:
            raise ValueError("not a plain data page")
        at = 4 + head
        if kind != VARCHAR:
            return pa.array(np.frombuffer(data, np.dtype(_NUMBER[kind]), rows, at))
        total = struct.unpack_from("<I", data, at)[0]
        offsets = pa.py_buffer(data[at + 4 : at + 8 + 4 * rows])
        return pa.StringArray.from_buffers(rows, offsets, pa.py_buffer(data[at + 8 + 4 * rows : at + 8 + 4 * rows + total]))

    def read_group(self, number: int, columns: Sequence[str] = (), filters: Iterable[tuple[str, str, object]] = ()) -> pa.Table:
        """The rows of a group that pass all filters (column, EQ NE LT LE GT GE, constant); the columns asked for, in that order.

        Least and greatest values rule out the group and pages. Filtered columns are decoded
        first, where rows are still in question; other columns only in pages that hold a row
        that is left. A constant of another type, or null, passes nothing.
        """
        rows, chunks = self.groups[number]
        columns = list(columns) or self.names
        for name in [*columns, *(f[0] for f in filters)]:
            if name not in self.names:
                raise ValueError(f"no column {name!r}")
        left = np.ones(rows, dtype=bool)
        for name, op, constant in filters:
            place = self.names.index(name)
            kind, chunk = self.kinds[place], chunks[place]
            fits = isinstance(constant, str) if kind == VARCHAR else isinstance(constant, int) and not isinstance(constant, bool)
            value = constant.encode() if fits and kind == VARCHAR else constant
            if not fits or not may_match(op, chunk.low, chunk.high, value):
                left[:] = False
                break
            for page in chunk.pages:
                part = left[page.start : page.start + page.rows]
                if not part.any():
                    continue
                if not may_match(op, page.low, page.high, value):
                    part[:] = False
                    continue
                data = self._page(kind, page)
                data = data.cast(pa.binary()) if kind == VARCHAR else data.cast(pa.int64())
                part &= COMPARE[op](data, pa.scalar(value, data.type)).to_numpy(zero_copy_only=False)
        out = []
        for name in columns:
            place = self.names.index(name)
            parts = [
                self._page(self.kinds[place], page).filter(pa.array(left[page.start : page.start + page.rows]))
                for page in chunks[place].pages
                if left[page.start : page.start + page.rows].any()
            ]
            out.append(pa.chunked_array(parts, _ARROW[self.kinds[place]]))
        return pa.table(out, names=columns)


def may_match(op: str, low, high, value) -> bool:
    """Whether a value between low and high can pass the comparison with a constant."""
    return {
        "EQ": low <= value <= high,
        "NE": not low == high == value,
        "LT": low < value,
        "LE": low <= value,
        "GT": high > value,
        "GE": high >= value,
    }[op]
