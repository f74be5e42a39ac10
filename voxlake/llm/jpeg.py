"""A progressive JPEG codec on coefficient arrays, in numpy.

The decoder reads any baseline-precision progressive stream: each scan of spectral selection and successive approximation adds
to the components' coefficient arrays. Runs of equal work are done as vectors: raw correction bits under an end-of-band run,
and first scans whose Huffman table has a single one-bit symbol. Samples come from an exact integer-valued inverse transform;
chroma is upsampled by repetition and the result is a full-resolution RGB tensor.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
SHIFT = 11


def _basis() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: the 64 samples; scaled by 2 ** SHIFT and rounded to integers."""
    x = np.arange(8)
    c = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * v + 1) * u * np.pi / 16) for v in x] for u in x])
    both = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(both[ZIGZAG] * (1 << SHIFT))


BASIS = _basis()
BASIS32 = BASIS.astype(np.float32)


# --- writing ---------------------------------------------------------------------------------------------------------

def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(kind: int, ident: int, codes: list[tuple[int, int]]) -> bytes:
    """codes: (symbol, length), in the order of the canonical code."""
    counts = [sum(n == k for _, n in codes) for k in range(1, 17)]
    return segment(0xC4, bytes([kind << 4 | ident, *counts, *(s for s, _ in codes)]))


ONES = np.ones(8, np.uint8)


def entropy(bits: np.ndarray) -> bytes:
    """Packed bits, the last byte filled with ones, and stuffed."""
    rest = -len(bits) % 8
    if rest:
        bits = np.concatenate([bits, ONES[:rest]])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def spread(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits of variable-length values, highest first."""
    at = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(int(lengths.sum())) - at
    return (np.repeat(values, lengths) >> (np.repeat(lengths, lengths) - 1 - place) & 1).astype(np.uint8)


def scan_header(component: int, dc: int, ac: int, band: tuple[int, int], high: int, low: int) -> bytes:
    return segment(0xDA, bytes([1, component, dc << 4 | ac, band[0], band[1], high << 4 | low]))


DC_TABLE = huffman_segment(0, 0, [(s, 4) for s in range(12)])
FIRST_TABLE = huffman_segment(1, 0, [(7, 1)])
REFINE_TABLE = huffman_segment(1, 1, [(r << 4, 4) for r in range(15)])
BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))


def dc_first(values: np.ndarray) -> bytes:
    half = values >> 1
    diff = half - np.concatenate([[0], half[:-1]])
    size = np.frexp(np.abs(diff).astype(float))[1].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return entropy(spread(size << size | extra, size + 4))


def refine(low: np.ndarray) -> bytes:
    """Correction bits of blocks whose coefficients are all known to be non-zero, under end-of-band runs."""
    out = []
    for a in range(0, len(low), 32767):
        run = min(32767, len(low) - a)
        r = run.bit_length() - 1
        head = r << r | run - (1 << r)
        out += [np.array([head >> k & 1 for k in range(3 + r, -1, -1)], np.uint8), low[a : a + run].ravel()]
    return entropy(np.concatenate(out))


def encode(units: np.ndarray, comment: bytes = b"") -> bytes:
    """A 4:2:0 stream that holds bytes as quantised coefficients, 64 a block, in zigzag order, Y then Cb then Cr.

    Byte b is the coefficient b or, below 128, b - 255: exactly the values of magnitude category 8, so every coefficient
    stays non-zero after the first scan, which drops the lowest bit and leaves it to the refinement scans."""
    count = -(-len(units) // 384)
    across = min(4095, int(np.ceil(np.sqrt(count))))
    down = -(-count // across)
    if down > 4095:
        raise ValueError("more bytes than one image holds")
    full = np.full(across * down * 384, 255, np.uint8)
    full[: len(units)] = units
    blocks = full.reshape(-1, 64)
    m = across * down
    out = [
        b"\xff\xd8", segment(0xFE, comment), segment(0xDB, bytes([0]) + b"\x01" * 64),
        segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        DC_TABLE, FIRST_TABLE, REFINE_TABLE,
    ]
    parts = (blocks[: 4 * m], blocks[4 * m : 5 * m], blocks[5 * m :])
    for c, part in enumerate(parts, 1):
        dc = part[:, 0].astype(np.int64)
        dc = np.where(dc < 128, dc - 255, dc)
        out += [scan_header(c, 0, 0, (0, 0), 0, 1), dc_first(dc)]
    for c, (part, bands) in enumerate(zip(parts, BANDS, strict=True), 1):
        for band in bands:
            out += [scan_header(c, 0, 0, band, 0, 1), (part[:, band[0] : band[1] + 1] >> 1).tobytes()]
    for c, (part, bands) in enumerate(zip(parts, BANDS, strict=True), 1):
        dc = part[:, 0]
        out += [scan_header(c, 0, 0, (0, 0), 1, 0), entropy((dc & 1 ^ (dc < 128)).astype(np.uint8))]
        low = part & 1 ^ (part < 128)
        for band in bands:
            out += [scan_header(c, 0, 1, band, 1, 0), refine(low[:, band[0] : band[1] + 1])]
    return b"".join([*out, b"\xff\xd9"])


# --- reading ---------------------------------------------------------------------------------------------------------

@functools.lru_cache(maxsize=64)
def decoding_table(counts: bytes, symbols: bytes) -> tuple[list[int], list[int], tuple[int, int] | None]:
    """Symbol and length for every 16 bits ahead; and (symbol, length) where the table has one symbol only."""
    symbol, length, code, k = [0] * 65536, [0] * 65536, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            a = code << 16 - n
            b = a + (1 << 16 - n)
            symbol[a:b] = [symbols[k]] * (b - a)
            length[a:b] = [n] * (b - a)
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length, (symbols[0], counts.index(1) + 1) if len(symbols) == 1 else None


SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff\xff\xff\xff", 0

    def symbol(self, table) -> int:
        p = self.at
        i = p >> 3
        d = self.data
        ahead = ((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> 8 - (p & 7)) & 0xFFFF
        if not table[1][ahead]:
            raise ValueError("no such Huffman code")
        self.at = p + table[1][ahead]
        return table[0][ahead]

    def take(self, n: int) -> int:
        if not n:
            return 0
        p, self.at = self.at, self.at + n
        i, j = p >> 3, (p + n + 7) >> 3
        return int.from_bytes(self.data[i:j], "big") >> (8 * (j - i) - (p & 7) - n) & (1 << n) - 1

    def many(self, n: int) -> np.ndarray:
        p, self.at = self.at, self.at + n
        return np.unpackbits(np.frombuffer(self.data, np.uint8, (p + n + 7 >> 3) - (p >> 3), p >> 3))[p & 7 : (p & 7) + n]


def extend(value: int, size: int) -> int:
    return value if not size or value >> size - 1 else value - (1 << size) + 1


def dc_scan(bits: Bits, places: list[tuple[np.ndarray, int, int]], table_of: dict, high: int, low: int) -> None:
    """places: (coefficients of the component, block, component) in coding order."""
    last: dict[int, int] = {}
    for blocks, k, c in places:
        if high:
            blocks[k, 0] |= bits.take(1) << low
        else:
            size = bits.symbol(table_of[c])
            last[c] = last.get(c, 0) + extend(bits.take(size), size)
            blocks[k, 0] = last[c] << low


def dc_first_single(bits: Bits, blocks: np.ndarray, order: np.ndarray, table, low: int) -> None:
    """The first DC scan of one component."""
    symbols, lengths, _ = table
    d, p, last, out = bits.data, bits.at, 0, []
    for _ in range(len(order)):
        i = p >> 3
        ahead = ((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> 8 - (p & 7)) & 0xFFFF
        size = symbols[ahead]
        p += lengths[ahead]
        if size:
            i = p >> 3
            value = ((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> 24 - (p & 7) - size) & (1 << size) - 1
            last += value if value >> size - 1 else value - (1 << size) + 1
            p += size
        out.append(last)
    bits.at = p
    blocks[order, 0] = np.array(out, np.int32) << low


def ac_first(bits: Bits, blocks: np.ndarray, order: np.ndarray, band: tuple[int, int], table, low: int) -> None:
    a, b = band
    width = b - a + 1
    if table[2] and table[2][0] >> 4 == 0 and table[2][0] & 15 and table[2][1] == 1:
        # Every coefficient is one bit of code and as many bits as the only symbol says.
        size = table[2][0]
        n = len(order) * width
        if size == 7 and not bits.at & 7:
            value = np.frombuffer(bits.data, np.uint8, n, bits.at >> 3).astype(np.int32)
            bits.at += 8 * n
        else:
            value = bits.many(n * (size + 1)).reshape(-1, size + 1)[:, 1:] @ (1 << np.arange(size - 1, -1, -1))
        value = np.where(value >> size - 1 == 0, value - (1 << size) + 1, value) << low
        blocks[order, a : b + 1] = value.reshape(-1, width)
        return
    run = 0
    for k in order:
        if run:
            run -= 1
            continue
        i = a
        while i <= b:
            s = bits.symbol(table)
            r, size = s >> 4, s & 15
            if size:
                i += r
                blocks[k, i] = extend(bits.take(size), size) * (1 << low)
                i += 1
            elif r == 15:
                i += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def corrected(bits: Bits, values: np.ndarray, low: int) -> np.ndarray:
    known = values != 0
    up = bits.many(int(known.sum())).astype(values.dtype) << low
    values[known] += np.where(values[known] > 0, up, -up)
    return values


def ac_refine(bits: Bits, blocks: np.ndarray, order: np.ndarray, band: tuple[int, int], table, low: int) -> None:
    a, b = band
    n = 0
    while n < len(order):
        k, i = order[n], a
        while i <= b:
            s = bits.symbol(table)
            r, size = s >> 4, s & 15
            if not size and r < 15:
                run = (1 << r) + bits.take(r)
                blocks[k, i : b + 1] = corrected(bits, blocks[k, i : b + 1].copy(), low)
                rest = order[n + 1 : n + run]
                if len(rest):
                    blocks[rest, a : b + 1] = corrected(bits, blocks[rest, a : b + 1], low)
                n += run - 1
                break
            new = (1 if bits.take(1) else -1) << low if size else 0
            while i <= b:
                if blocks[k, i]:
                    if bits.take(1):
                        blocks[k, i] += (1 << low) if blocks[k, i] > 0 else -(1 << low)
                elif r:
                    r -= 1
                else:
                    blocks[k, i] = new
                    i += 1
                    break
                i += 1
        n += 1


def read_coefficients(stream: bytes) -> dict:
    """height, width, comment, and per component its sampling, quantisation (zigzag) and coefficients (rows, columns, 64)."""
    at, quant, huff, image, restart = 2, {}, {}, {"comment": b""}, 0
    if stream[:2] != b"\xff\xd8":
        raise ValueError("no JPEG stream")
    while at < len(stream):
        marker = stream[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(stream[at + 2 : at + 4], "big")
        body = stream[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = decoding_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            _, image["height"], image["width"], n = struct.unpack(">BHHB", body[:6])
            found = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            most_h, most_v = max(f[1] for f in found), max(f[2] for f in found)
            mcu_x, mcu_y = -(-image["width"] // (8 * most_h)), -(-image["height"] // (8 * most_v))
            image |= {"mcus": (mcu_y, mcu_x), "most": (most_v, most_h), "components": {}}
            for c, h, v, q in found:
                used = (-(-(-(-image["height"] * v // most_v)) // 8), -(-(-(-image["width"] * h // most_h)) // 8))
                image["components"][c] = {"h": h, "v": v, "q": q, "used": used, "blocks": np.zeros((mcu_y * v * mcu_x * h, 64), np.int32)}
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a progressive stream")
        elif marker == 0xDA:
            n = body[0]
            which = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            band, high, low = (body[1 + 2 * n], body[2 + 2 * n]), body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            found = SCAN_END.search(stream, at)
            stop = found.start() if found else len(stream)
            pieces = re.split(rb"\xff[\xd0-\xd7]", stream[at:stop]) if restart else [stream[at:stop]]
            at = stop
            comps = [image["components"][c] for c, _, _ in which]
            if n == 1:
                across = mcu_x * comps[0]["h"]
                order = (np.arange(comps[0]["used"][0])[:, None] * across + np.arange(comps[0]["used"][1])).ravel()
                units = len(order)
            else:
                units = mcu_x * mcu_y
            step = restart or units
            for k, piece in enumerate(pieces):
                bits = Bits(piece.replace(b"\xff\x00", b"\xff"))
                if band[0] == 0 and n == 1:
                    mine = order[k * step : (k + 1) * step]
                    if high:
                        comps[0]["blocks"][mine, 0] |= bits.many(len(mine)).astype(np.int32) << low
                    else:
                        dc_first_single(bits, comps[0]["blocks"], mine, huff[which[0][1]], low)
                elif band[0] == 0:
                    places = []
                    for u in range(k * step, min(units, (k + 1) * step)):
                        y, x = divmod(u, mcu_x)
                        for (c, _, _), comp in zip(which, comps, strict=True):
                            for v in range(comp["v"]):
                                for h in range(comp["h"]):
                                    places.append((comp["blocks"], (y * comp["v"] + v) * mcu_x * comp["h"] + x * comp["h"] + h, c))
                    dc_scan(bits, places, {c: huff.get(d) for c, d, _ in which}, high, low)
                else:
                    (ac_refine if high else ac_first)(bits, comps[0]["blocks"], order[k * step : (k + 1) * step], band, huff[0x10 | which[0][2]], low)
    for comp in image["components"].values():
        comp["quant"] = quant[comp["q"]]
    return image


def plane(comp: dict, mcus: tuple[int, int]) -> np.ndarray:
    rows, columns = mcus[0] * comp["v"], mcus[1] * comp["h"]
    out = np.empty((len(comp["blocks"]), 64), np.uint8)
    scale = None if (comp["quant"] == 1).all() else comp["quant"]
    for a in range(0, len(out), 1 << 13):
        part = comp["blocks"][a : a + (1 << 13)]
        part = part if scale is None else part * scale
        exact = BASIS32 if part.max(initial=0) <= 255 and part.min(initial=0) >= -255 else BASIS
        samples = (part.astype(exact.dtype) @ exact).astype(np.int64 if exact is BASIS else np.int32)
        out[a : a + (1 << 13)] = np.clip((samples + (1 << SHIFT - 1) >> SHIFT) + 128, 0, 255)
    return out.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)


def rgb(image: dict) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of a three-component or grey image."""
    planes = []
    for comp in image["components"].values():
        planes.append((plane(comp, image["mcus"]), image["most"][0] // comp["v"], image["most"][1] // comp["h"]))
    grow = lambda p, v, h: p if v == h == 1 else p.repeat(v, axis=0).repeat(h, axis=1)
    y = grow(*planes[0]).astype(np.int16)
    if len(planes) == 1:
        out = np.stack([y, y, y], axis=2).astype(np.uint8)
    else:
        cb, cr = (p.astype(np.int32) - 128 for p, _, _ in planes[1:3])
        (_, v1, h1), (_, v2, h2) = planes[1:3]
        half = 1 << 15
        red = grow(((91881 * cr + half) >> 16).astype(np.int16), v2, h2)
        blue = grow(((116130 * cb + half) >> 16).astype(np.int16), v1, h1)
        if (v1, h1) == (v2, h2):
            green = grow(((-22554 * cb - 46802 * cr + half) >> 16).astype(np.int16), v1, h1)
        else:
            green = (-22554 * grow(cb, v1, h1) - 46802 * grow(cr, v2, h2) + half >> 16).astype(np.int16)
        out = np.empty((*y.shape, 3), np.uint8)
        for k, add in enumerate((red, green, blue)):
            out[:, :, k] = np.clip(y + add, 0, 255)
    return out[: image["height"], : image["width"]]


def units(image: dict) -> np.ndarray:
    """The bytes that `encode` stored, with its filling."""
    values = np.concatenate([c["blocks"].ravel() for c in image["components"].values()])
    return np.where(values < 0, values + 255, values).astype(np.uint8)
