"""Writes small NetCDF-4 (HDF5) files from the public layout, for trying the reader. Checksums are left 0: it checks none.

Styles: "old" (symbol table, version 1 headers), "new" (links in version 2 headers), "dense" (links and attributes in heaps
under version 2 B-trees), "latest" (as new, with the chunk indexes that came later).
"""

from __future__ import annotations

import struct
import zlib
from itertools import product

import numpy as np

NONE = b"\xff" * 8
CHILDREN = 64  # of a chunk B-tree node
SCALE_ONLY = "This is a netCDF dimension but not a netCDF variable. %10d"


def _number_type(dtype: np.dtype) -> bytes:
    big, size = dtype.str[0] == ">", dtype.itemsize
    if dtype.kind == "f":
        where = {4: (31, 23, 8, 23, 127), 8: (63, 52, 11, 52, 1023)}[size]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | big, where[0], 0, size, 0, size * 8, where[1], where[2], 0, where[3], where[4])
    return struct.pack("<BBBBIHH", 0x10, big | (8 if dtype.kind == "i" else 0), 0, 0, size, 0, size * 8)


REFERENCE = struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)
LIST_OF_REFERENCES = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + REFERENCE


class Writer:
    def __init__(self, style: str) -> None:
        self.style, self.modern = style, style != "old"
        self.out = bytearray(2048)  # room for a superblock

    def put(self, data: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        self.out += data
        return len(self.out) - len(data)

    def space(self, shape: tuple[int, ...]) -> bytes:
        head = struct.pack("<BBBB", 2, len(shape), 0, 1 if shape else 0) if self.modern else struct.pack("<BBB5x", 1, len(shape), 0)
        return head + b"".join(struct.pack("<Q", n) for n in shape)

    def attribute(self, name: str, value: object) -> bytes:
        if isinstance(value, str):
            raw = value.encode()
            kind, space, data = struct.pack("<BBBBI", 0x13, 0, 0, 0, len(raw) + 1), self.space(()), raw + b"\0"
        elif isinstance(value, list):  # of addresses, a dimension each
            refs = [struct.pack("<Q", a) for a in value]
            body = b"".join(struct.pack("<HHIQ", i + 1, 1, 0, 8) + r for i, r in enumerate(refs)) + struct.pack("<HHIQ", 0, 0, 0, 16)
            heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(body)) + body)
            kind, space = LIST_OF_REFERENCES, self.space((len(refs),))
            data = b"".join(struct.pack("<IQI", 1, heap, i + 1) for i in range(len(refs)))
        else:
            array = np.atleast_1d(value)
            kind, space, data = _number_type(array.dtype), self.space(array.shape), array.tobytes()
        raw = name.encode() + b"\0"
        if self.modern:
            return struct.pack("<BBHHHB", 3, 0, len(raw), len(kind), len(space), 0) + raw + kind + space + data
        parts = b"".join(p + b"\0" * (-len(p) % 8) for p in (raw, kind, space))
        return struct.pack("<BBHHH", 1, 0, len(raw), len(kind), len(space)) + parts + data

    def header(self, messages: list[tuple[int, bytes]], attributes: list[bytes]) -> int:
        """An object header; half of its attributes go to a continuation."""
        if self.style == "dense" and len(attributes) > 2:
            heap, places = self.heap(attributes, 40)
            records = [p + struct.pack("<BII", 0, i, 0) for i, p in enumerate(places)]
            messages = [*messages, (0x15, struct.pack("<BB", 0, 0) + struct.pack("<QQ", heap, self.tree(8, 17, records)))]
            attributes = []
        listed = [*messages, *((0x0C, a) for a in attributes)]
        cut = len(listed) - len(attributes) // 2
        if self.modern:
            def packed(part: list[tuple[int, bytes]]) -> bytes:
                return b"".join(struct.pack("<BHBH", kind, len(d), 0, 0) + d for kind, d in part)

            rest = b""
            if cut < len(listed):
                tail = b"OCHK" + packed(listed[cut:]) + b"\0" * 4
                rest = packed([(0x10, struct.pack("<QQ", self.put(tail), len(tail)))])
            body = packed(listed[:cut]) + rest
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 0x06, len(body)) + body + b"\0" * 4)

        def packed(part: list[tuple[int, bytes]]) -> bytes:
            padded = [(kind, d + b"\0" * (-len(d) % 8)) for kind, d in part]
            return b"".join(struct.pack("<HHB3x", kind, len(d), 0) + d for kind, d in padded)

        count, rest = len(listed), b""
        if cut < len(listed):
            tail = packed(listed[cut:])
            rest, count = packed([(0x10, struct.pack("<QQ", self.put(tail), len(tail)))]), count + 1
        body = packed(listed[:cut]) + rest
        return self.put(struct.pack("<BBHII4x", 1, 0, count, 1, len(body)) + body)

    # Dense storage

    def heap(self, objects: list[bytes], bits: int) -> tuple[int, list[bytes]]:
        """A fractal heap under one indirect block, and the ids of its objects."""
        width, start, size = 4, 512, bits // 8
        head = self.put(b"\0" * 146)
        blocks: list[bytearray] = []
        places, at, row = [], 0, 0
        prefix = 5 + 8 + size
        spans: list[int] = []
        for data in objects:
            while not blocks or len(blocks[-1]) + len(data) > spans[-1]:
                if blocks:
                    at += spans[-1]
                row = len(blocks) // width
                spans.append(start << max(row - 1, 0))
                blocks.append(bytearray(b"FHDB" + struct.pack("<BQ", 0, head) + at.to_bytes(size, "little")))
            places.append(b"\0" + (at + len(blocks[-1])).to_bytes(size, "little") + struct.pack("<H", len(data)))
            blocks[-1] += data
        assert all(len(b) >= prefix for b in blocks)
        addresses = [self.put(bytes(b).ljust(n, b"\0")) for b, n in zip(blocks, spans)]
        rows = row + 1
        listed = b"".join(struct.pack("<Q", a) for a in addresses).ljust(rows * width * 8, b"\xff")
        root = self.put(b"FHIB" + struct.pack("<BQ", 0, head) + (0).to_bytes(size, "little") + listed + b"\0" * 4)
        made = b"FRHP" + struct.pack("<BHHBI", 0, len(places[0]), 0, 0, 65_535) + struct.pack("<Q", 0) + NONE + struct.pack("<Q", 0) + NONE
        made += struct.pack("<8Q", *[0] * 8) + struct.pack("<HQQHH", width, start, 65_536, bits, 1) + struct.pack("<QH", root, rows)
        made += b"\0" * 4
        self.out[head : head + len(made)] = made
        return head, places

    def tree(self, kind: int, size: int, records: list[bytes]) -> int:
        """A version 2 B-tree of one or two levels."""
        node = 10 + 8 * size  # few records a node, so that small files have two levels
        per = (node - 10) // size
        leaf = lambda part: self.put((b"BTLF" + struct.pack("<BB", 0, kind) + b"".join(part)).ljust(node, b"\0"))
        if len(records) <= per:
            root, held, depth = leaf(records), len(records), 0
        else:
            parts, between = [records[i : i + per] for i in range(0, len(records), per + 1)], records[per :: per + 1]
            if len(between) == len(parts):
                parts.append([])
            children = b"".join(struct.pack("<QB", leaf(p), len(p)) for p in parts)
            root, held, depth = self.put(b"BTIN" + struct.pack("<BB", 0, kind) + b"".join(between) + children), len(between), 1
        return self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, kind, node, size, depth, 100, 40, root, held, len(records)) + b"\0" * 4)

    # Groups

    def group(self, members: dict[str, int]) -> int:
        if self.modern:
            links = []
            for order, (name, address) in enumerate(members.items()):
                raw = name.encode()
                links.append(struct.pack("<BBQB", 1, 0x04, order, len(raw)) + raw + struct.pack("<Q", address))
            if self.style != "dense":
                return self.header([(0x02, struct.pack("<BB", 0, 0) + NONE + NONE), *((0x06, k) for k in links)], [])
            heap, places = self.heap(links, 32)
            tree = self.tree(5, 11, [struct.pack("<I", 0) + p for p in places])
            return self.header([(0x02, struct.pack("<BBQQ", 0, 0, heap, tree))], [])
        names, at = b"\0" * 8, {}
        for name in sorted(members):
            at[name] = len(names)
            raw = name.encode() + b"\0"
            names += raw + b"\0" * (-len(raw) % 8)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 2**64 - 1, self.put(names)))
        nodes = []
        for i in range(0, len(at), 8):
            part = sorted(at)[i : i + 8]
            body = b"".join(struct.pack("<QQII16x", at[n], members[n], 0, 0) for n in part)
            nodes.append((part, self.put((b"SNOD" + struct.pack("<BBH", 1, 0, len(part)) + body).ljust(328, b"\0"))))
        tree = b"TREE" + struct.pack("<BBH", 0, 0, len(nodes)) + NONE * 2 + struct.pack("<Q", 0)
        tree += b"".join(struct.pack("<QQ", a, at[part[-1]]) for part, a in nodes)
        return self.header([(0x11, struct.pack("<QQ", self.put(tree), heap))], [])

    # Datasets

    def dataset(self, array: np.ndarray, attributes: list[bytes], chunk: tuple | None, filters: tuple, unwritten: set, fill: object) -> int:
        messages = [(0x01, self.space(array.shape)), (0x03, _number_type(array.dtype))]
        if fill is not None:
            raw = np.array(fill, array.dtype).tobytes()
            messages.append((0x05, struct.pack("<BBI", 3, 0x20, len(raw)) + raw if self.modern else struct.pack("<BBBBI", 2, 2, 2, 1, len(raw)) + raw))
        if chunk is None:
            if array.nbytes <= 64 and self.style == "new":
                layout = struct.pack("<BBH", 3, 0, array.nbytes) + array.tobytes()
            else:
                layout = struct.pack("<BBQQ", 3, 1, self.put(array.tobytes()), array.nbytes)
        else:
            layout = self.chunks(array, chunk, filters, unwritten)
            if filters:
                messages.append((0x0B, self.pipeline(filters, array.dtype.itemsize)))
        return self.header([*messages, (0x08, layout)], attributes)

    def pipeline(self, filters: tuple, size: int) -> bytes:
        number = {"deflate": (1, [4]), "shuffle": (2, [size]), "fletcher": (3, [])}
        out = struct.pack("<BB", 2, len(filters)) if self.modern else struct.pack("<BB6x", 1, len(filters))
        for name in filters:
            n, client = number[name]
            raw = b"" if self.modern else name.encode().ljust(16, b"\0")
            out += struct.pack("<HHH", n, 0, len(client)) if self.modern else struct.pack("<HHHH", n, len(raw), 0, len(client))
            out += raw + b"".join(struct.pack("<I", c) for c in client)
            if not self.modern and len(client) % 2:
                out += b"\0" * 4
        return out

    def stored(self, block: np.ndarray, filters: tuple) -> bytes:
        data, size = block.tobytes(), block.dtype.itemsize
        for name in filters:
            if name == "shuffle":
                data = np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes()
            else:
                data = zlib.compress(data, 4) if name == "deflate" else data + b"\0" * 4
        return data

    def chunks(self, array: np.ndarray, chunk: tuple, filters: tuple, unwritten: set) -> bytes:
        entries = []
        for first in product(*(range(0, n, c) for n, c in zip(array.shape, chunk))):
            part = array[tuple(slice(f, f + c) for f, c in zip(first, chunk))]
            block = np.full(chunk, 7, array.dtype)  # what lies beyond the array does not count
            block[tuple(slice(n) for n in part.shape)] = part
            data = self.stored(block, filters)
            entries.append((first, None if first in unwritten else self.put(data), len(data)))
        size, rank = array.dtype.itemsize, array.ndim
        if self.style == "latest":
            sides = b"".join(struct.pack("<I", c) for c in (*chunk, size))
            if len(entries) == 1:
                more = struct.pack("<QI", entries[0][2], 0) if filters else b""
                return struct.pack("<BBBBB", 4, 2, 2 if filters else 0, rank + 1, 4) + sides + b"\x01" + more + struct.pack("<Q", entries[0][1])
            bits, page = 2, 4
            cells = [
                (NONE if a is None else struct.pack("<Q", a)) + (struct.pack("<HI", n, 0) if filters else b"") for _, a, n in entries
            ]
            width = 14 if filters else 8
            head = self.put(b"\0" * 28)
            body = b"FADB" + struct.pack("<BBQ", 0, bool(filters), head)
            if len(cells) > page:
                pages = [cells[i : i + page] for i in range(0, len(cells), page)]
                body += b"\xff" * (-(-len(pages) // 8)) + b"\0" * 4 + b"".join(b"".join(p) + b"\0" * 4 for p in pages)
            else:
                body += b"".join(cells) + b"\0" * 4
            made = b"FAHD" + struct.pack("<BBBBQQ", 0, bool(filters), width, bits, len(cells), self.put(body)) + b"\0" * 4
            self.out[head : head + len(made)] = made
            return struct.pack("<BBBBB", 4, 2, 0, rank + 1, 4) + sides + struct.pack("<BBQ", 3, bits, head)

        def key(first: tuple, n: int) -> bytes:
            return struct.pack(f"<II{rank}QQ", n, 0, *first, 0)

        level, nodes = 0, [(key(f, n), a) for f, a, n in entries if a is not None]
        end = key(tuple(-(-n // c) * c for n, c in zip(array.shape, chunk)), 0)
        while level == 0 or len(nodes) > 1:
            upper = []
            for i in range(0, max(len(nodes), 1), CHILDREN):
                part = nodes[i : i + CHILDREN]
                body = b"".join(k + struct.pack("<Q", a) for k, a in part) + end
                upper.append((part[0][0] if part else end, self.put(b"TREE" + struct.pack("<BBH", 1, level, len(part)) + NONE * 2 + body)))
            level, nodes = level + 1, upper
        sides = b"".join(struct.pack("<I", c) for c in (*chunk, size))
        return struct.pack("<BBB", 3, 2, rank + 1) + struct.pack("<Q", nodes[0][1]) + sides

    def finish(self, root: int) -> bytes:
        end = len(self.out)
        if self.modern:
            head = struct.pack("<BBBBQ8sQQI", 3 if self.style == "latest" else 2, 8, 8, 0, 0, NONE, end, root, 0)
        else:
            head = struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<Q8sQ8sQQII16x", 0, NONE, end, NONE, 0, root, 0, 0)
        self.out[: 8 + len(head)] = b"\x89HDF\r\n\x1a\n" + head
        return bytes(self.out)


def hdf5_bytes(
    dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]], style: str = "old",
    chunks: dict[str, tuple] | None = None, filters: tuple = (), unwritten: dict[str, set] | None = None, fill: dict | None = None,
) -> bytes:
    """A file. Every dimension is a scale; variables of ``chunks`` are chunked and filtered, others lie together."""
    out, members = Writer(style), {}
    chunks, unwritten, fill = chunks or {}, unwritten or {}, fill or {}
    scales = {d: variables.get(d, ([d], np.zeros(n, "f4"), {"NAME": SCALE_ONLY % n})) for d, n in dims.items()}
    for name, (vdims, array, attributes) in {**scales, **variables}.items():
        own = dict(attributes)
        if name in dims:
            own = {"CLASS": "DIMENSION_SCALE", "NAME": name, **own}
        elif vdims:
            own["DIMENSION_LIST"] = [members[d] for d in vdims]
        members[name] = out.dataset(
            np.asarray(array, order="C"), [out.attribute(k, v) for k, v in own.items()], chunks.get(name),
            filters if name in chunks else (), unwritten.get(name, set()), fill.get(name),
        )
    return out.finish(out.group(members))
