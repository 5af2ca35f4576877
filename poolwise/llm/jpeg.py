"""Progressive JPEG in numpy: coefficient arrays to scans and back, and inverse transform to RGB.

``encode`` writes one frame of three components sampled 4:2:0 (or 4:4:4) in scans of spectral selection and
successive approximation; ``decode`` accumulates any such scans into coefficient arrays (one row of 64 in
zigzag order per block).  Stretches of equal symbols and end-of-band runs are packed and read as whole
arrays; everything else symbol by symbol, so other pictures decode as well.  Restart intervals bound the
bits that are held at once.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np

#: Row-major place of each zigzag position.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8, i % 8) if (i // 8 + i % 8) % 2 else (i % 8, i // 8))))
#: Blocks, or interleaved groups of them, between restart markers.
RESTART = 8192
#: (components, first and last position, high and low bit) of each scan.
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((0,), 6, 63, 0, 1),
    ((1,), 1, 63, 0, 0),
    ((2,), 1, 63, 0, 0),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 63, 1, 0),
)
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def _bits(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The lowest ``length`` bits of each value, one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.uint8)
    shift = np.repeat(ends, length) - 1 - np.arange(ends[-1])
    return ((np.repeat(value, length) >> shift) & 1).astype(np.uint8)


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


class Codes:
    """A Huffman table with codes of one length for all symbols used."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = sorted(set(symbols.tolist())) or [0]
        self.length = max(1, len(self.symbols).bit_length())  # the code of ones stays free
        self.code = np.zeros(256, np.int64)
        self.code[self.symbols] = np.arange(len(self.symbols))

    def segment(self, kind: int, slot: int) -> bytes:
        counts = [len(self.symbols) if k == self.length else 0 for k in range(1, 17)]
        return bytes([kind << 4 | slot, *counts, *self.symbols])


def _first_symbols(rows: np.ndarray, low: int) -> list[tuple[int, int, int]]:
    """(symbol, bits, their number) of a band's first scan; rows hold the band of each block."""
    out: list[tuple[int, int, int]] = []
    run = 0

    def flush() -> None:
        nonlocal run
        if run:
            n = run.bit_length() - 1
            out.append((n << 4, run - (1 << n), n))
            run = 0

    for row in (np.sign(rows) * (np.abs(rows) >> low)).tolist():
        zeros = 0
        last = max((k for k, v in enumerate(row) if v), default=-1)
        for v in row[: last + 1]:
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                out.append((0xF0, 0, 0))
                zeros -= 16
            size = abs(v).bit_length()
            out.append((zeros << 4 | size, v if v > 0 else v + (1 << size) - 1, size))
            zeros = 0
        if last + 1 < len(row):
            run += 1
            if run == 0x7FFF:
                flush()
    flush()
    return out


def _refine_symbols(rows: np.ndarray, low: int) -> list[tuple[int, int, int]]:
    """The same of a refining scan; correction bits follow their symbol as (-1, bit, 1)."""
    out: list[tuple[int, int, int]] = []
    run, held = 0, []

    def flush() -> None:
        nonlocal run, held
        if run:
            n = run.bit_length() - 1
            out.append((n << 4, run - (1 << n), n))
        out.extend((-1, b, 1) for b in held)
        run, held = 0, []

    for row in rows.tolist():
        mags = [abs(v) >> low for v in row]
        last = max((k for k, m in enumerate(mags) if m == 1), default=-1)
        zeros, bits = 0, []
        for k, m in enumerate(mags):
            if m == 0:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                flush()
                out.append((0xF0, 0, 0))
                out.extend((-1, b, 1) for b in bits)
                zeros, bits = zeros - 16, []
            if m > 1:
                bits.append(m & 1)
                continue
            flush()
            out.append((zeros << 4 | 1, int(row[k] > 0), 1))
            out.extend((-1, b, 1) for b in bits)
            zeros, bits = 0, []
        if zeros or bits:
            run += 1
            held += bits
            if run == 0x7FFF:
                flush()
    flush()
    return out


def _coded(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], codes: Codes) -> list[np.ndarray]:
    out = []
    for symbol, value, number in parts:
        is_symbol = symbol >= 0
        both = np.stack([codes.code[np.maximum(symbol, 0)], value], 1).ravel()
        out.append(_bits(both, np.stack([np.where(is_symbol, codes.length, 0), number], 1).ravel()))
    return out


def _scan_bits(coefs: list[np.ndarray], order: np.ndarray | None, scan: tuple) -> tuple[list[np.ndarray], Codes | None]:
    """Bits of each restart interval, and the table they use."""
    comps, first, last, high, low = scan
    if first == 0:
        owner, block = order
        values = np.concatenate([c[:, 0] for c in coefs])[block]
        step = RESTART * (len(owner) // len(coefs[1]))
        cuts = range(0, len(values), step)
        if high:
            return [((values[s : s + step] >> low) & 1).astype(np.uint8) for s in cuts], None
        parts = []
        for s in cuts:
            v, o = values[s : s + step] >> low, owner[s : s + step]
            diff = np.empty_like(v)
            for c in range(3):
                diff[o == c] = np.diff(v[o == c], prepend=0)
            size = _size(diff)
            parts.append((size, _extra(diff, size), size))
        codes = Codes(np.arange(12))
        return _coded(parts, codes), codes
    band = coefs[comps[0]][:, first : last + 1]
    rows = [band[s : s + RESTART] for s in range(0, len(band), RESTART)]
    if high:
        if (np.abs(band) >> high).all():  # every position corrects: nothing but end-of-band runs
            n = [(len(r).bit_length() - 1, len(r)) for r in rows]
            codes = Codes(np.array([k << 4 for k, _ in n]))
            heads = [_bits(np.array([codes.code[k << 4], c - (1 << k)]), np.array([codes.length, k])) for k, c in n]
            return [np.concatenate([h, ((np.abs(r) >> low) & 1).astype(np.uint8).ravel()]) for h, r in zip(heads, rows, strict=True)], codes
        found = [_refine_symbols(r, low) for r in rows]
    else:
        mags = np.abs(band) >> low
        top = int(mags.max()).bit_length()
        if top and mags.min() >> (top - 1):  # one size everywhere: rows of one width
            codes = Codes(np.array([top]))
            out = []
            for r in rows:
                v = (np.sign(r) * (np.abs(r) >> low)).ravel()
                wide = np.zeros((len(v), top + 1), np.uint8)
                if top == 8 and v.min() > 0:
                    wide[:, 1:] = np.unpackbits(v.astype(np.uint8)).reshape(-1, 8)
                else:
                    v = v if v.min() > 0 else _extra(v, np.int64(top))
                    wide[:, 1:] = np.unpackbits(v.astype(">u2").view(np.uint8)).reshape(-1, 16)[:, 16 - top :]
                out.append(wide.ravel())
            return out, codes
        found = [_first_symbols(r, low) for r in rows]
    parts = [tuple(np.array(x, np.int64).reshape(-1, 3).T) for x in found]
    codes = Codes(np.concatenate([p[0][p[0] >= 0] for p in parts]))
    return _coded(parts, codes), codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.lru_cache(512)
def block_order(wide: int, high: int, sampling: int) -> tuple[np.ndarray, np.ndarray]:
    """Component and row (of all components' blocks, one after the other) of interleaved blocks."""
    my, mx = np.divmod(np.arange(wide * high), wide)
    n, s = wide * high, sampling
    parts = [(my * s + j) * wide * s + mx * s + i for j in range(s) for i in range(s)]
    parts += [n * s * s + my * wide + mx, n * s * s + n + my * wide + mx]
    owner = np.tile(np.array([0] * (s * s) + [1, 2]), n)
    return owner, np.array(parts).T.ravel()


def encode(coefs: list[np.ndarray], wide: int, high: int, sampling: int = 2, comment: bytes = b"", scans: tuple = SCANS) -> bytes:
    """A progressive file of ``wide`` x ``high`` interleaved groups, each of ``8 * sampling`` pixels a side."""
    side, order = 8 * sampling, block_order(wide, high, sampling)
    out = [b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * side, wide * side, 3) + bytes([1, sampling << 4 | sampling, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xDD, struct.pack(">H", RESTART)))
    for scan in scans:
        comps, first, last, up, low = scan
        bits, codes = _scan_bits(coefs, order, scan)
        if codes:
            out.append(_segment(0xC4, codes.segment(int(first > 0), 0)))
        out.append(_segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), first, last, up << 4 | low])))
        for k, part in enumerate(bits):
            if k:
                out.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
            fill = -len(part) % 8
            packed = np.packbits(np.concatenate([part, np.ones(fill, np.uint8)]) if fill else part).tobytes()
            out.append(packed.replace(b"\xff", b"\xff\x00"))
    return b"".join([*out, b"\xff\xd9"])


class Table:
    """Symbol and length of the code at the head of any 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.symbol, self.length = [0] * 65536, [0] * 65536
        self.codes: dict[int, np.ndarray] = {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                lo, width = code << (16 - length), 1 << (16 - length)
                self.symbol[lo : lo + width] = [symbol] * width
                self.length[lo : lo + width] = [length] * width
                self.codes[symbol] = np.array([(code >> (length - 1 - k)) & 1 for k in range(length)], np.uint8)
                code += 1
            at += n
            code <<= 1


@functools.lru_cache(64)
def _table(counts: bytes, symbols: bytes) -> Table:
    return Table(counts, symbols)


class Reader:
    """The bits of one restart interval."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0
        self._raw = data.replace(b"\xff\x00", b"\xff") + b"\0\0\0\0"

    def peek(self) -> int:
        k, shift = self.at >> 3, self.at & 7
        return (int.from_bytes(self._raw[k : k + 3], "big") >> (8 - shift)) & 0xFFFF

    def take(self, n: int) -> int:
        out = 0
        while n > 16:
            out, n = out << 16 | self.take(16), n - 16
        if n:
            out = out << n | self.peek() >> (16 - n)
            self.at += n
        return out

    def symbol(self, table: Table) -> int:
        word = self.peek()
        self.at += table.length[word] or 16
        return table.symbol[word]


def _signed(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _read_dc(reader: Reader, table: Table | None, owner: np.ndarray, high: int, low: int, old: np.ndarray) -> np.ndarray:
    if high:
        bits = reader.bits[reader.at : reader.at + len(owner)].astype(np.int64)
        return old | (bits << low)
    diffs = np.empty(len(owner), np.int64)
    raw, at, symbols, lengths = reader._raw, 0, table.symbol, table.length
    whole = int.from_bytes
    for k in range(len(owner)):
        b = at >> 3
        word = (whole(raw[b : b + 4], "big") << (at & 7)) & 0xFFFFFFFF
        head = word >> 16
        size, used = symbols[head], lengths[head]
        value = (word >> (32 - used - size)) & ((1 << size) - 1) if used + size <= 25 else None
        at += used
        if value is None:
            reader.at = at
            value = reader.take(size)
        at += size
        diffs[k] = value if not size or value >> (size - 1) else value - (1 << size) + 1
    out = np.empty_like(diffs)
    for c in np.unique(owner):
        out[owner == c] = np.cumsum(diffs[owner == c])
    return out << low


def _read_first(reader: Reader, table: Table, flat: np.ndarray, width: int, low: int) -> None:
    """Fill ``flat``, the band of all blocks of an interval end to end."""
    at, end = 0, len(flat)
    while at < end:
        symbol = reader.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if not size:
            if zeros == 15:
                at += 16
                continue
            run = (1 << zeros) + reader.take(zeros)
            at = (at // width + run) * width
            continue
        if not zeros:  # as many equal symbols as follow
            code = table.codes[symbol]
            stride, start = len(code) + size, reader.at - len(code)
            most = min(end - at, (len(reader.bits) - start) // stride)
            seg = reader.bits[start : start + most * stride].reshape(most, stride)
            bad = np.flatnonzero((seg[:, : len(code)] != code).any(1))
            n = int(bad[0]) if len(bad) else most
            if n > 1:
                extra = seg[:n, len(code) :]
                if size == 8:
                    value = np.packbits(extra).astype(np.int16)
                else:
                    wide = np.zeros((n, 16), np.uint8)
                    wide[:, 16 - size :] = extra
                    value = np.packbits(wide).view(">u2").astype(np.int16)
                if value.min() < 1 << (size - 1):
                    value = np.where(value >> (size - 1), value, value - np.int16((1 << size) - 1))
                flat[at : at + n] = value << low
                at, reader.at = at + n, start + n * stride
                continue
        at += zeros
        flat[at] = _signed(reader.take(size), size) << low
        at += 1


def _read_refine(reader: Reader, table: Table, flat: np.ndarray, width: int, low: int) -> None:
    at, end, bit = 0, len(flat), 1 << low

    def correct(lo: int, hi: int) -> None:
        part = flat[lo:hi]
        if len(part) and part.min() > 0:
            part += reader.bits[reader.at : reader.at + len(part)].astype(part.dtype) << low
            reader.at += len(part)
            return
        old = np.flatnonzero(part)
        bits = reader.bits[reader.at : reader.at + len(old)].astype(np.int64) << low
        part[old] += (np.sign(part[old]) * bits).astype(part.dtype)
        reader.at += len(old)

    while at < end:
        symbol = reader.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if not size and zeros != 15:
            stop = min(end, (at // width + (1 << zeros) + reader.take(zeros)) * width)
            correct(at, stop)
            at = stop
            continue
        value = (bit if reader.take(1) else -bit) if size else 0
        new = np.flatnonzero(flat[at : (at // width + 1) * width] == 0)
        stop = at + int(new[zeros])
        correct(at, stop)
        flat[stop] = value
        at = stop + 1


def decode(data: bytes) -> tuple[list[np.ndarray], dict]:
    """Coefficient arrays of the components after all scans, and the frame.

    ``ValueError`` for frames that it does not read: not progressive, other components than three sampled 4:2:0
    or 4:4:4, sizes that do not fill groups, first coefficients coded apart or by several tables, broken files.
    """
    try:
        return _decode(data)
    except (IndexError, KeyError, AttributeError, TypeError, struct.error) as e:
        raise ValueError("not a whole progressive file") from e


def _decode(data: bytes) -> tuple[list[np.ndarray], dict]:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, tables, frame, coefs, restart = 2, {}, {}, [], 0
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            frame["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                if len(body) <= wide:
                    raise ValueError("a quantiser table ends early")
                frame.setdefault("quant", {})[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide > 64 else np.uint8).astype(np.int64)
                body = body[1 + wide :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            sampling = body[7] >> 4
            side = 8 * sampling
            if n != 3 or body[6::3] != b"\x01\x02\x03" or body[7::3] != bytes([sampling << 4 | sampling, 0x11, 0x11]) or not (height and width and sampling) or height % side or width % side:
                raise ValueError("components other than three of 4:2:0 or 4:4:4, or sizes that do not fill groups")
            frame["tables"] = tuple(body[8::3])
            frame |= {"height": height, "width": width, "sampling": sampling, "wide": -(-width // side), "high": -(-height // side)}
            n = frame["wide"] * frame["high"]
            coefs = [np.zeros((n * s * s, 64), np.int16) for s in (sampling, 1, 1)]
        elif marker == 0xDA:
            comps = [body[1 + 2 * k] - 1 for k in range(body[0])]
            slots = body[2]
            first, last, up, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            stop = at
            while not (data[stop] == 0xFF and data[stop + 1] != 0 and not 0xD0 <= data[stop + 1] <= 0xD7):
                stop = data.index(b"\xff", stop + 1)
            readers = [Reader(p) for p in _RST.split(data[at:stop])]
            at = stop
            if first == 0:
                if comps != [0, 1, 2] or last or (not up and len({body[2 + 2 * k] >> 4 for k in comps}) > 1):
                    raise ValueError("a scan of first coefficients with other than all components and one table")
                owner, block = block_order(frame["wide"], frame["high"], frame["sampling"])
                step = (restart or len(owner)) * (frame["sampling"] ** 2 + 2)
                every = np.concatenate([c[:, 0] for c in coefs])
                for k, reader in enumerate(readers):
                    part = slice(k * step, (k + 1) * step)
                    every[block[part]] = _read_dc(reader, tables.get(slots >> 4), owner[part], up, low, every[block[part]])
                for c, piece in zip(coefs, np.split(every, np.cumsum([len(c) for c in coefs])[:-1]), strict=True):
                    c[:, 0] = piece
            else:
                whole, table = coefs[comps[0]], tables[0x10 | slots & 15]
                for k, reader in enumerate(readers):
                    rows = slice(k * restart, (k + 1) * restart) if restart else slice(None)
                    band = np.ascontiguousarray(whole[rows, first : last + 1])
                    (_read_refine if up else _read_first)(reader, table, band.reshape(-1), band.shape[1], low)
                    whole[rows, first : last + 1] = band
    else:
        raise ValueError("no end of image")
    if not coefs or not set(frame["tables"]) <= set(frame.get("quant", {})):
        raise ValueError("no progressive frame, or no quantiser for a component")
    return coefs, frame


def _basis() -> np.ndarray:
    """From the 64 coefficients of a block, in zigzag order, to its 64 pixels, row by row."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG]


_BASIS = _basis()


@functools.lru_cache(16)
def _scaled(quant: bytes) -> np.ndarray:
    return (_BASIS * np.frombuffer(quant, np.int64)[:, None]).astype(np.float32)


def plane(blocks: np.ndarray, quant: np.ndarray, wide: int) -> np.ndarray:
    """Pixels less 128 (-128 to 127, as float) of a component whose rows have ``wide`` blocks."""
    x = blocks.astype(np.float32) @ _scaled(quant.tobytes())
    np.clip(x, -128, 127, out=x)
    return x.reshape(-1, wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, wide * 8)


def rgb(coefs: list[np.ndarray], frame: dict) -> np.ndarray:
    """(height, width, 3) of uint8; chroma planes are repeated to the size of luma.  A frame without ``tables`` has
    one quantiser, of number 0."""
    s, tables = frame["sampling"], frame.get("tables", (0, 0, 0))
    y, cb, cr = (plane(c, frame["quant"][t], frame["wide"] * k) for c, t, k in zip(coefs, tables, (s, 1, 1), strict=True))
    out = np.empty((*y.shape, 3), np.uint8)
    y += 128.5
    for k, part in enumerate((1.402 * cr, -0.344136 * cb - 0.714136 * cr, 1.772 * cb)):
        full = np.repeat(np.repeat(part.astype(np.float32), s, 1), s, 0)
        full += y
        np.clip(full, 0, 255, out=full)
        out[..., k] = full
    return out[: frame["height"], : frame["width"]]
