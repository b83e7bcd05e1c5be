"""The layout of NetCDF-4 files, which are HDF5 files: what a file holds and where its chunks lie.

Only metadata is walked here, by byte ranges: superblock, object headers, groups, attributes and chunk indexes. The bytes
of chunks are read elsewhere, by the tasks that need them. Read are superblocks 0 to 3, both kinds of object headers,
groups as symbol tables, links or dense links, attributes in headers or dense, and data stored compactly, contiguously or
in chunks under a version 1 B-tree, a fixed array, or by position. Data is found in the root group.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from math import prod

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
PAGE = 16_384
PAGES = 256
NO_VARIABLE = "This is a netCDF dimension but not a netCDF variable"

# Numbers of header messages.
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE = 0x01, 0x02, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C
CONTINUATION, SYMBOL_TABLE, ATTRIBUTE_INFO = 0x10, 0x11, 0x15
# Numbers of filters.
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3


class NotReadable(ValueError):
    """The file is not HDF5, or stores something in a way that is not read here."""


@dataclass
class Kind:
    """A datatype: a number, or a string, reference or variable-length sequence in attributes."""

    form: int
    size: int
    dtype: np.dtype | None = None
    base: Kind | None = None
    text: bool = False


@dataclass
class Array:
    """A dataset of the root group."""

    name: str
    address: int
    kind: Kind
    shape: list[int]
    attributes: dict
    layout: dict
    filters: list[tuple[int, int]]  # (number, first client value)
    fill: bytes
    dims: list[str] = field(default_factory=list)

    @property
    def chunk(self) -> list[int]:
        return self.layout["chunk"] if self.layout["form"] == "chunked" else list(self.shape)


class Pages:
    """Reads pages of a file and keeps the latest: metadata lies scattered in small pieces."""

    def __init__(self, file) -> None:
        self.file, self.held = file, OrderedDict()

    def page(self, number: int) -> bytes:
        if number in self.held:
            self.held.move_to_end(number)
        else:
            self.file.seek(number * PAGE)
            self.held[number] = self.file.read(PAGE)
            if len(self.held) > PAGES:
                self.held.popitem(last=False)
        return self.held[number]

    def read(self, at: int, size: int) -> bytes:
        if size > PAGE * 8:
            self.file.seek(at)
            found = self.file.read(size)
        else:
            first, last = at // PAGE, (at + max(size, 1) - 1) // PAGE
            joined = b"".join(self.page(n) for n in range(first, last + 1))
            found = joined[at - first * PAGE : at - first * PAGE + size]
        if len(found) < size:
            raise NotReadable(f"the file ends before byte {at + size}")
        return found


class Cursor:
    def __init__(self, data: bytes, offsets: int, lengths: int, at: int = 0) -> None:
        self.data, self.offsets, self.lengths, self.at = data, offsets, lengths, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise NotReadable("a block of metadata is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int | None:
        found = self.number(self.offsets)
        return None if found == (1 << 8 * self.offsets) - 1 else found

    def length(self) -> int:
        return self.number(self.lengths)


def size_for(limit: int) -> int:
    """Bytes that hold numbers up to ``limit``."""
    return (max(limit, 1).bit_length() - 1) // 8 + 1


class Container:
    """An open file."""

    def __init__(self, file) -> None:
        self.pages = Pages(file)
        start = 0
        while self.pages.read(start, 8) != SIGNATURE:  # a user block of a power of two may come first
            start = max(512, start * 2)
            if start > 1 << 20:
                raise NotReadable("not an HDF5 file")
        version = self.pages.read(start + 8, 1)[0]
        self.base = 0
        if version in (0, 1):
            self.offsets, self.lengths = self.pages.read(start + 13, 2)
            at = start + 24 + (4 if version == 1 else 0)
            head = self.cursor(at, 6 * self.offsets)
            self.base = head.address() or 0
            head.at = 5 * self.offsets  # past free space, end, driver information and the root's name
            self.root = head.address()
        elif version in (2, 3):
            self.offsets, self.lengths = self.pages.read(start + 9, 2)
            head = self.cursor(start + 12, 4 * self.offsets)
            self.base = head.address() or 0
            head.at = 3 * self.offsets
            self.root = head.address()
        else:
            raise NotReadable(f"superblock version {version}")

    def cursor(self, at: int, size: int) -> Cursor:
        return Cursor(self.pages.read(at + self.base, size), self.offsets, self.lengths)

    # Object headers

    def messages(self, address: int) -> list[tuple[int, int, bytes]]:
        """(type, flags, data) of an object's header messages, continuations included."""
        found: list[tuple[int, int, bytes]] = []
        if self.pages.read(address + self.base, 4) == b"OHDR":
            flags = self.cursor(address + 5, 1).number(1)
            at = address + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            blocks = [(at + width, self.cursor(at, width).number(width))]
            head, trail, signed = 4 + (2 if flags & 4 else 0), 0, True
        else:
            first = self.cursor(address, 16)
            if first.number(1) != 1:
                raise NotReadable(f"no object header at byte {address}")
            first.at = 8
            blocks = [(address + 16, first.number(4))]
            head, trail, signed = 8, 0, False
        for n, (at, size) in enumerate(blocks):  # continuations are added on the way
            if signed and n:
                at, size = at + 4, size - 8  # between a signature and a checksum
            block = self.cursor(at, size)
            while block.at + head <= size:
                if signed:
                    kind, length, flags = block.number(1), block.number(2), block.number(1)
                    block.take(head - 4)
                else:
                    kind, length, flags = block.number(2), block.number(2), block.number(1)
                    block.take(3)
                if block.at + length > size:
                    break
                data = block.take(length)
                if kind == CONTINUATION:
                    more = Cursor(data, self.offsets, self.lengths)
                    blocks.append((more.address(), more.length()))
                elif kind:
                    found.append((kind, flags, data))
        return found

    def shared(self, kind: int, data: bytes) -> bytes:
        """The message that another object holds, such as a named datatype."""
        cursor = Cursor(data, self.offsets, self.lengths)
        version, where = cursor.number(1), cursor.number(1)
        if version == 1:
            cursor.take(6)
        if version == 3 and where == 1:
            raise NotReadable("messages in a shared heap")
        owner = cursor.address()
        return next(d for k, _, d in self.messages(owner) if k == kind)

    # Groups

    def links(self, group: int) -> dict[str, int]:
        """Names and object headers in a group: by creation where the file keeps that order, else by name."""
        found: list[tuple[int, str, int]] = []
        for kind, _, data in self.messages(group):
            if kind == SYMBOL_TABLE:
                cursor = Cursor(data, self.offsets, self.lengths)
                tree, heap = cursor.address(), cursor.address()
                found += [(0, n, a) for n, a in self.symbols(tree, self.local_heap(heap))]
            elif kind == LINK:
                found += self.link(data)
            elif kind == LINK_INFO:
                cursor = Cursor(data, self.offsets, self.lengths, 1)
                cursor.take(8 if cursor.number(1) & 1 else 0)
                heap, names = cursor.address(), cursor.address()
                if heap is not None:
                    found += [f for record in self.dense(heap, names, 4) for f in self.link(record)]
        return {name: address for _, name, address in sorted(found)}

    def link(self, data: bytes) -> list[tuple[int, str, int]]:
        cursor = Cursor(data, self.offsets, self.lengths, 1)
        flags = cursor.number(1)
        form = cursor.number(1) if flags & 8 else 0
        order = cursor.number(8) if flags & 4 else 0
        cursor.take(1 if flags & 16 else 0)
        name = cursor.take(cursor.number(1 << (flags & 3))).decode()
        return [(order, name, cursor.address())] if form == 0 else []  # soft and external links are passed over

    def local_heap(self, address: int) -> int:
        head = self.cursor(address, 8 + 2 * self.lengths + self.offsets)
        head.at = 8 + 2 * self.lengths
        return head.address()

    def symbols(self, node: int, heap: int) -> Iterator[tuple[str, int]]:
        if self.cursor(node, 4).data == b"TREE":
            for _, child in self.tree_entries(node, self.lengths):
                yield from self.symbols(child, heap)
            return
        count = struct.unpack("<H", self.cursor(node + 6, 2).data)[0]
        width = 2 * self.offsets + 24
        entries = self.cursor(node + 8, count * width)
        for n in range(count):
            entries.at = n * width
            name, address = entries.number(self.offsets), entries.address()
            yield self.name_at(heap + name), address

    def name_at(self, at: int) -> str:
        raw = b""
        while b"\0" not in raw:
            raw += self.cursor(at + len(raw), 1).data
        return raw[:-1].decode()

    def tree_entries(self, node: int, key_size: int) -> list[tuple[bytes, int]]:
        """(key, child) of a version 1 B-tree node."""
        count = struct.unpack("<H", self.cursor(node + 6, 2).data)[0]
        block = self.cursor(node + 8 + 2 * self.offsets, count * (key_size + self.offsets))
        return [(block.take(key_size), block.address()) for _ in range(count)]

    # Dense storage: records of a version 2 B-tree point into a fractal heap

    def dense(self, heap: int, tree: int, before: int) -> Iterator[bytes]:
        """Objects of a heap that a B-tree lists. ``before`` bytes of each record precede the place in the heap."""
        read = self.fractal_heap(heap)
        for record in self.records(tree):
            yield read(record[before:])

    def records(self, tree: int) -> Iterator[bytes]:
        head = self.cursor(tree, 18 + self.offsets)
        if head.take(4) != b"BTHD":
            raise NotReadable(f"no B-tree at byte {tree}")
        head.take(2)
        node_size, size, depth = head.number(4), head.number(2), head.number(2)
        head.take(2)
        root, count = head.address(), head.number(2)
        most = [(node_size - 10) // size]
        total, width, total_widths = most[0], size_for(most[0]), [0]
        for _ in range(depth):
            pointer = self.offsets + width + total_widths[-1]
            most.append((node_size - 10 - pointer) // (size + pointer))
            total = (most[-1] + 1) * total + most[-1]
            total_widths.append(size_for(total))

        def walk(node: int, count: int, level: int) -> Iterator[bytes]:
            pointer = self.offsets + width + total_widths[level - 1] if level else 0
            block = self.cursor(node + 6, count * size + (count + 1) * pointer)
            yield from (block.take(size) for _ in range(count))
            for _ in range(count + 1 if level else 0):
                child, held = block.address(), block.number(width)
                block.take(total_widths[level - 1])
                yield from walk(child, held, level - 1)

        if root is not None and count:
            yield from walk(root, count, depth)

    def fractal_heap(self, address: int):
        """A function from heap ids to objects."""
        L = self.lengths
        head = self.cursor(address, 22 + 12 * L + 3 * self.offsets)
        if head.take(4) != b"FRHP":
            raise NotReadable(f"no heap at byte {address}")
        head.take(3)
        filtered, _flags, most_managed = head.number(2), head.number(1), head.number(4)
        head.take(10 * L + 2 * self.offsets)
        width = head.number(2)
        start, most_direct, bits = head.length(), head.length(), head.number(2)
        head.take(2)
        root, rows = head.address(), head.number(2)
        if filtered:
            raise NotReadable("a compressed heap of metadata")
        offset_size = -(-bits // 8)
        length_size = min(-(-(most_direct.bit_length() - 1) // 8), size_for(most_managed))

        def row_size(row: int) -> int:
            return start << max(row - 1, 0)

        def place(block: int, rows: int, offset: int) -> int:
            """Where in the file an offset of an indirect block lies."""
            at = 0
            entries = self.cursor(block + 5 + self.offsets + offset_size, rows * width * self.offsets)
            for row in range(rows):
                size = row_size(row)
                if offset < at + size * width:
                    entries.at = (row * width + (offset - at) // size) * self.offsets
                    child, inside = entries.address(), (offset - at) % size
                    if size <= most_direct:
                        return child + inside
                    return place(child, (size // (start * width)).bit_length(), inside)
                at += size * width
            raise NotReadable("a place beyond a heap")

        def read(key: bytes) -> bytes:
            form = key[0] >> 4 & 3
            if form == 2:
                return key[1 : 2 + (key[0] & 15)]
            if form:
                raise NotReadable("a huge object in a heap")
            offset = int.from_bytes(key[1 : 1 + offset_size], "little")
            length = int.from_bytes(key[1 + offset_size : 1 + offset_size + length_size], "little")
            return self.cursor(place(root, rows, offset) if rows else root + offset, length).data

        return read

    # Datatypes and attributes

    def datatype(self, cursor: Cursor) -> Kind:
        form, bits, size = cursor.number(1) & 15, cursor.number(3), cursor.number(4)
        order = ">" if bits & 1 else "<"
        if form == 0:
            cursor.take(4)
            return Kind(form, size, np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"))
        if form == 1:
            cursor.take(12)
            return Kind(form, size, np.dtype(f"{order}f{size}") if size in (2, 4, 8) else None)
        if form == 9:
            return Kind(form, size, base=self.datatype(cursor), text=bits & 15 == 1)
        return Kind(form, size, text=form == 3)

    def dataspace(self, data: bytes) -> list[int]:
        cursor = Cursor(data, self.offsets, self.lengths)
        version, rank = cursor.number(1), cursor.number(1)
        cursor.take(6 if version == 1 else 2)
        return [cursor.length() for _ in range(rank)]

    def attributes(self, messages: list[tuple[int, int, bytes]]) -> dict:
        raw = [d for kind, _, d in messages if kind == ATTRIBUTE]
        for kind, _, data in messages:
            if kind == ATTRIBUTE_INFO:
                cursor = Cursor(data, self.offsets, self.lengths, 1)
                cursor.take(2 if cursor.number(1) & 1 else 0)
                heap, names = cursor.address(), cursor.address()
                if heap is not None:
                    raw += self.dense(heap, names, 0)
        return dict(self.attribute(d) for d in raw)

    def attribute(self, data: bytes) -> tuple[str, object]:
        cursor = Cursor(data, self.offsets, self.lengths)
        version, flags = cursor.number(1), cursor.number(1)
        sizes = [cursor.number(2) for _ in range(3)]
        if version == 3:
            cursor.take(1)
        step = 8 if version == 1 else 1
        name, kind, space = (cursor.take(n + -n % step)[:n] for n in sizes)
        name = name.rstrip(b"\0").decode()
        if version > 1 and flags & 1:
            kind = self.shared(DATATYPE, kind)
        kind = self.datatype(Cursor(kind, self.offsets, self.lengths))
        return name, self.values(kind, prod(self.dataspace(space)), cursor)

    def values(self, kind: Kind, count: int, cursor: Cursor) -> object:
        """Numbers as an array, text as a string, references and sequences as lists; None for other types."""
        if kind.dtype is not None:
            return np.frombuffer(cursor.take(count * kind.size), kind.dtype)
        if kind.form == 3:
            return cursor.take(count * kind.size).split(b"\0")[0].decode("utf-8", "replace")
        if kind.form == 7:
            return [int.from_bytes(cursor.take(kind.size)[: self.offsets], "little") for _ in range(count)]
        if kind.form == 9:
            found = []
            for _ in range(count):
                length, heap, number = cursor.number(4), cursor.address(), cursor.number(4)
                data = self.global_object(heap, number) if length and heap else b""
                if kind.text:
                    found.append(data[:length].split(b"\0")[0].decode("utf-8", "replace"))
                elif kind.base is not None:
                    found.append(self.values(kind.base, length, Cursor(data, self.offsets, self.lengths)))
            return (found[0] if found else "") if kind.text else found
        return None

    def global_object(self, heap: int, number: int) -> bytes:
        total = Cursor(self.cursor(heap + 8, self.lengths).data, self.offsets, self.lengths).length()
        block = self.cursor(heap, total)
        block.at = 8 + self.lengths
        while block.at + 8 + self.lengths <= total:
            index = block.number(2)
            block.take(6)
            size = block.length()
            data = block.take(size + -size % 8)
            if index == number:
                return data[:size]
            if index == 0:
                break
        raise NotReadable(f"no object {number} in the heap at byte {heap}")

    # Datasets

    def arrays(self) -> list[Array]:
        """The datasets of the root group with their dimensions, in the file's order."""
        found = {}
        for name, address in self.links(self.root).items():
            messages = self.messages(address)
            by_kind = {kind: self.shared(kind, d) if flags & 2 else d for kind, flags, d in messages if kind != ATTRIBUTE}
            if LAYOUT not in by_kind:
                continue  # a group
            kind = self.datatype(Cursor(by_kind[DATATYPE], self.offsets, self.lengths))
            shape = self.dataspace(by_kind[DATASPACE])
            filters = self.filters(by_kind[FILTERS]) if FILTERS in by_kind else []
            layout = self.layout(by_kind[LAYOUT])
            fill = self.fill(by_kind.get(FILL, b""))
            found[address] = Array(name, address, kind, shape, self.attributes(messages), layout, filters, fill)
        scales = {a: v for a, v in found.items() if v.attributes.get("CLASS") == "DIMENSION_SCALE"}
        for address, v in found.items():
            listed = v.attributes.get("DIMENSION_LIST")
            if address in scales and len(v.shape) == 1:
                v.dims = [v.name]
            elif isinstance(listed, list) and len(listed) == len(v.shape):
                v.dims = [found[refs[0]].name if refs and refs[0] in found else f"dim_{n}" for n, refs in enumerate(listed)]
            else:
                v.dims = [f"dim_{n}" for n in range(len(v.shape))]
        return [v for a, v in found.items() if not str(v.attributes.get("NAME", "")).startswith(NO_VARIABLE) or a not in scales]

    def layout(self, data: bytes) -> dict:
        cursor = Cursor(data, self.offsets, self.lengths)
        version, form = cursor.number(1), cursor.number(1)
        if version not in (3, 4):
            raise NotReadable(f"data layout version {version}")
        if form == 0:
            return {"form": "compact", "data": cursor.take(cursor.number(2))}
        if form == 1:
            return {"form": "contiguous", "address": cursor.address()}
        if form != 2:
            raise NotReadable(f"data layout class {form}")
        if version == 3:
            rank, tree = cursor.number(1), cursor.address()
            return {"form": "chunked", "index": "tree", "address": tree, "chunk": [cursor.number(4) for _ in range(rank)][:-1]}
        flags, rank, width = cursor.number(1), cursor.number(1), cursor.number(1)
        chunk = [cursor.number(width) for _ in range(rank)][:-1]
        index = cursor.number(1)
        held = {"form": "chunked", "chunk": chunk}
        if index == 1:
            size = (cursor.length(), cursor.number(4)) if flags & 2 else None
            return {**held, "index": "single", "size": size, "address": cursor.address()}
        if index == 2:
            return {**held, "index": "implicit", "address": cursor.address()}
        if index == 3:
            cursor.take(1)
            return {**held, "index": "fixed", "address": cursor.address()}
        raise NotReadable(f"chunk index type {index}")

    def filters(self, data: bytes) -> list[tuple[int, int]]:
        cursor = Cursor(data, self.offsets, self.lengths)
        version, count = cursor.number(1), cursor.number(1)
        cursor.take(6 if version == 1 else 0)
        found = []
        for _ in range(count):
            number = cursor.number(2)
            name = cursor.number(2) if version == 1 or number >= 256 else 0
            cursor.take(2)
            values = cursor.number(2)
            cursor.take(name + (-name % 8 if version == 1 else 0))
            client = [cursor.number(4) for _ in range(values)]
            if version == 1 and values % 2:
                cursor.take(4)
            if number not in (DEFLATE, SHUFFLE, FLETCHER):
                raise NotReadable(f"filter {number}")
            found.append((number, client[0] if client else 0))
        return found

    def fill(self, data: bytes) -> bytes:
        if len(data) < 2:
            return b""
        cursor = Cursor(data, self.offsets, self.lengths)
        if cursor.number(1) == 3:
            defined = cursor.number(1) & 0x20
        else:
            cursor.take(2)
            defined = cursor.number(1)
        return cursor.take(cursor.number(4)) if defined and cursor.at + 4 <= len(data) else b""

    def chunks(self, v: Array) -> Iterator[tuple[tuple[int, ...], int | None, int, int]]:
        """(first cell, byte, bytes, mask of skipped filters) of each stored chunk. Chunks that were never written may be
        missing, or have no byte."""
        layout, size = v.layout, v.kind.size
        counts = [-(-n // c) for n, c in zip(v.shape, layout["chunk"])]
        if layout["address"] is None:
            return
        whole = prod(layout["chunk"]) * size
        firsts = product(*(range(0, n * c, c) for n, c in zip(counts, layout["chunk"])))
        if layout["index"] == "tree":
            yield from self.tree_chunks(layout["address"], len(v.shape))
        elif layout["index"] == "single":
            stored, mask = layout["size"] or (whole, 0)
            yield (0,) * len(v.shape), layout["address"], stored, mask
        elif layout["index"] == "implicit":
            for n, first in enumerate(firsts):
                yield first, layout["address"] + n * whole, whole, 0
        else:
            for first, (address, stored, mask) in zip(firsts, self.fixed_array(layout["address"], whole)):
                yield first, address, stored, mask

    def tree_chunks(self, node: int, rank: int) -> Iterator[tuple[tuple[int, ...], int | None, int, int]]:
        level = self.cursor(node + 5, 1).number(1)
        for key, child in self.tree_entries(node, 8 + 8 * (rank + 1)):
            if level:
                yield from self.tree_chunks(child, rank)
            else:
                stored, mask, *first = struct.unpack(f"<II{rank}Q", key[:-8])
                yield tuple(first), child, stored, mask

    def fixed_array(self, address: int, whole: int) -> Iterator[tuple[int | None, int, int]]:
        head = self.cursor(address, 8 + self.lengths + self.offsets)
        head.take(5)
        filtered, width, page_bits, count, block = head.number(1), head.number(1), head.number(1), head.length(), head.address()
        if block is None:
            return
        at, page = block + 6 + self.offsets, 1 << page_bits
        pages = -(-count // page) if count > page else 0
        if pages:
            at += -(-pages // 8) + 4
        for first in range(0, count, page if pages else max(count, 1)):
            held = min(page, count - first) if pages else count
            entries = self.cursor(at, held * width)
            for _ in range(held):
                where = entries.address()
                stored = entries.number(width - self.offsets - 4) if filtered else whole
                yield where, stored, entries.number(4) if filtered else 0
            at += held * width + 4
