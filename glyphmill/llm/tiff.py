"""TIFF: a reader that emits one row per page, and a writer of lossless 8-bit grey pages.

The reader walks the chain of image directories in either byte order, takes
strips or tiles, undoes no compression, PackBits, LZW or deflate and the
horizontal predictor, and crops tiles to the image.

Defined results: a null text is an empty one, whose payload is 64 zero bytes;
files that are damaged, that claim more pixels than their bytes can hold, or
that use something else give one row with ``error`` set (at the page where it
shows) and no pixels; a null file gives no row; repeated
rows give repeated rows; other columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, rows_of

# Fixed values of the format: tags, compressions, field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_FORMAT = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
CLEAR, END, FIRST_FREE, MAX_CODE = 256, 257, 258, 4094

#: Side of the payload's pages, and the most rows that a page, strip or tile has.
PAGE_WIDTH, PAGE_ROWS, STRIP, TILE = 64, 1024, 128, 64


class TiffError(ValueError):
    pass


# ---- coders of one strip or tile

def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else as literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
    lengths = np.diff(starts)
    out, literal = bytearray(), 0

    def flush(end: int) -> None:
        for at in range(literal, end, 128):
            part = data[at : min(at + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3):
        at, n = int(starts[k]), int(lengths[k])
        flush(at)
        literal = at + n
        while n:
            m = min(n, 128)
            out += bytes([257 - m, data[at]]) if m > 1 else bytes([0, data[at]])
            n -= m
    flush(len(data))
    return bytes(out)


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (most is None or len(out) < most):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one code early, as the format has it."""
    codes, widths, table, free = [CLEAR], [9], {}, FIRST_FREE
    width, limit, prefix = 9, 512, -1
    for c in data:
        key = prefix << 8 | c
        if prefix < 0:
            prefix = c
        elif (known := table.get(key)) is not None:
            prefix = known
        else:
            codes.append(prefix)
            widths.append(width)
            table[key] = free
            free += 1
            prefix = c
            if free == limit:
                if free >= MAX_CODE:
                    codes.append(CLEAR)
                    widths.append(width)
                    table.clear()
                    free, width, limit = FIRST_FREE, 9, 512
                else:
                    width += 1
                    limit = 1 << width if width < 12 else MAX_CODE
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        free += 1
        if free == MAX_CODE:
            codes.append(CLEAR)
            widths.append(width)
            width = 9
        elif free == limit:
            width += 1
    codes.append(END)
    widths.append(width)
    w, c = np.array(widths), np.array(codes)
    at = np.cumsum(w) - w
    bits = np.zeros(int(at[-1] + w[-1]), np.uint8)
    for k in range(12):
        own = w > k
        bits[at[own] + k] = c[own] >> (w[own] - 1 - k) & 1
    return np.packbits(bits).tobytes()


_BYTE = [bytes([i]) for i in range(256)]


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """The strip or tile; with ``most``, decoding ends once there are so many bytes."""
    table, out, size = [*_BYTE, b"", b""], [], 0
    acc, have, width, i, n, old = 0, 0, 9, 0, len(data), None
    while True:
        while have < width:
            if i >= n:
                return b"".join(out)
            acc = (acc & 0xFFFF) << 8 | data[i]
            have += 8
            i += 1
        have -= width
        code = acc >> have & (1 << width) - 1
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            del table[FIRST_FREE:]
            width, old = 9, None
            continue
        if old is None:
            if code > 255:
                raise TiffError("LZW: no literal after a clear code")
            now = table[code]
        elif code < len(table):
            now = table[code]
            table.append(old + now[:1])
        elif code == len(table):
            now = old + old[:1]
            table.append(now)
        else:
            raise TiffError("LZW: unknown code")
        out.append(now)
        size += len(now)
        if most is not None and size >= most:
            return b"".join(out)
        old = now
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: pack_bits}


def inflate(data: bytes, most: int | None = None) -> bytes:
    if most is None:
        return zlib.decompress(data)
    stream = zlib.decompressobj()
    out = stream.decompress(data, most)
    if not stream.eof:
        stream.decompress(stream.unconsumed_tail, 1)  # reads on to the checksum, if that comes next
    return out


DECODE = {NONE: lambda x, most=None: x[:most], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
#: The most bytes that a byte of each coder can stand for (LZW: a code of 9 bits or more for at most 3838 bytes; deflate: 258 bytes in 2 bits).
MOST_FROM_A_BYTE = {NONE: 1, LZW: 3838, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}
#: A tile's side can exceed its image by no more than this.
MOST_PADDING = 1 << 16


# ---- files

def write_tiff(pages: list[np.ndarray], compression: int, predictor: int = 1, tiled: bool = False, order: str = "<") -> bytes:
    """A file of 8-bit grey pages, each an array of rows and columns; the payload blocks of a page precede its directory."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        rows, cols = page.shape
        if tiled:
            down, right = -(-rows // TILE), -(-cols // TILE)
            whole = np.zeros((down * TILE, right * TILE), np.uint8)
            whole[:rows, :cols] = page
            blocks = [whole[y * TILE : (y + 1) * TILE, x * TILE : (x + 1) * TILE] for y in range(down) for x in range(right)]
        else:
            blocks = [page[y : y + STRIP] for y in range(0, rows, STRIP)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            coded = ENCODE[compression](block.tobytes())
            offsets.append(len(out))
            sizes.append(len(coded))
            out += coded
        tags = [(WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [8]), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [1]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor])]
        tags += [(TILE_WIDTH, "I", [TILE]), (TILE_HEIGHT, "I", [TILE]), (TILE_OFFSETS, "I", offsets), (TILE_BYTES, "I", sizes)] if tiled else [(STRIP_OFFSETS, "I", offsets), (STRIP_ROWS, "I", [STRIP]), (STRIP_BYTES, "I", sizes)]
        entries = bytearray()
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(body) > 4:
                at, body = len(out), body + b""
                out += body
                body = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, 3 if kind == "H" else 4, len(values)) + body.ljust(4, b"\0")
        if len(out) % 2:
            out.append(0)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0)
        link = len(out) - 4
    return bytes(out)


def _directories(data: bytes, order: str) -> Iterator[dict[int, tuple]]:
    seen, at = set(), struct.unpack_from(order + "I", data, 4)[0]
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind in TYPE_FORMAT and count <= len(data):
                form = f"{order}{count}{TYPE_FORMAT[kind]}"
                where = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                tags[tag] = struct.unpack_from(form, data, where)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, tags: dict[int, tuple], order: str) -> np.ndarray:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    cols, rows, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, coding, predictor = set(tags.get(BITS, (1,))), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if not cols or not rows:
        raise TiffError("no image size")
    if bits not in ({8}, {16}) or coding not in DECODE or predictor not in (1, 2) or samples > 1 and one(PLANAR, 1) != 1:
        raise TiffError(f"unsupported: bits {sorted(bits)}, compression {coding}, predictor {predictor}, planes {one(PLANAR, 1)}")
    kind = np.dtype(np.uint8) if bits == {8} else np.dtype(order + "u2")
    tiled = TILE_OFFSETS in tags
    width, height = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (cols, min(one(STRIP_ROWS, rows), rows))
    if not width or not height or not samples:
        raise TiffError("no size of strips or tiles, or no samples")
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    blocks = -(-rows // height) * -(-cols // width)
    if len(offsets) < blocks or len(sizes) < blocks:
        raise TiffError("too few strips or tiles")
    if width > cols + MOST_PADDING or height > rows + MOST_PADDING:
        raise TiffError("tiles are far larger than their image")
    # What the bytes present can decode to bounds every array and list made below.
    present = sum(max(0, min(size, len(data) - at)) for at, size in zip(offsets[:blocks], sizes[:blocks], strict=True))
    if rows * cols * samples * kind.itemsize > present * MOST_FROM_A_BYTE[coding]:
        raise TiffError("more pixels than the bytes present can hold")
    out = np.zeros((rows, cols, samples), kind.newbyteorder("="))
    places = ((y, x) for y in range(0, rows, height) for x in range(0, cols, width))
    for (y, x), at, size in zip(places, offsets, sizes, strict=False):
        tall = height if tiled else min(height, rows - y)
        want = tall * width * samples * kind.itemsize
        if want > size * MOST_FROM_A_BYTE[coding]:
            raise TiffError("a strip or tile is too short")
        raw = DECODE[coding](data[at : at + size], want)
        if len(raw) < want:
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(raw, kind, tall * width * samples).reshape(tall, width, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[y : y + tall, x : x + width] = block[: rows - y, : cols - x]
    return out


def read_pages(data: bytes) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """(page, array of rows, columns and samples, error); after an error nothing follows."""
    page = 0
    try:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if not order or struct.unpack_from(order + "H", data, 2) != (42,):
            raise TiffError("not a TIFF file")
        for tags in _directories(data, order):
            yield page, _page(data, tags, order), None
            page += 1
    except (TiffError, struct.error, zlib.error, KeyError, ValueError, IndexError, TypeError, OverflowError, MemoryError) as e:
        yield page, None, str(e) or type(e).__name__


# ---- DataFrames

def pages(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: ``keep``'s columns, page, width, height, samples, bits, pixels (rows top down), error.

    A file's pages follow each other in the partition that its row was in.
    """
    fields = df.select(*keep).schema
    arrow = pa.schema([*df.select(*keep).limit(0).toArrow().schema, ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "page int, width int, height int, samples int, bits int, pixels binary, error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for *own, data in rows_of(batches, *keep, media_col):
                for page, image, error in read_pages(data) if data is not None else ():
                    yield (*own, page, None, None, None, None, None, error) if image is None else (*own, page, image.shape[1], image.shape[0], image.shape[2], 8 * image.dtype.itemsize, image.tobytes(), None)

        yield from batches_of(rows(), arrow, lambda r: len(r[-2] or b""))

    return df.select(*keep, media_col).mapInArrow(run, kinds)


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(PAGE_WIDTH - len(raw) % PAGE_WIDTH if len(raw) % PAGE_WIDTH or not raw else 0)


def store(payload: bytes) -> bytes:
    """The payload as pages of 64 columns.  Its checksum picks coder, predictor, layout and byte order, so equal payloads give equal files."""
    pick = zlib.crc32(payload)
    image = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    coder = (LZW, PACKBITS, DEFLATE)[pick % 3]
    return write_tiff([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], coder, 1 + (pick >> 4) % 2, bool((pick >> 5) % 2), "<>"[(pick >> 6) % 2])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_bytes, media_bytes, media_sha256, media): every text as a TIFF file; ``row`` numbers the rows of a partition."""
    schema = pa.schema([("row", pa.int64()), (id_col, pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for k, (i, text) in enumerate(rows_of(batches, "i", "t")):
                media = store(payload_of(text or ""))
                yield k, i, len((text or "").encode()), len(media), hashlib.sha256(media).hexdigest(), media

        yield from batches_of(rows(), schema, lambda r: len(r[-1]))

    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"row long, `{id_col}` long, n_bytes long, media_bytes long, media_sha256 string, media binary")


def features(paged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per stored text from its pages: checksums of the payload read back, and what its image looks like.

    ``feature`` is the number of pages, the mean sample in hundredths, and 64
    bits that tell which columns are lighter than that, in hexadecimal.
    """
    names = ("row", id_col, "n_bytes", "media_bytes", "media_sha256", "pixels", "error")
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (_, i), group in itertools.groupby(rows_of(batches, *names), key=lambda r: r[:2]):
                digest, size, count, tail, columns = hashlib.sha256(), 0, 0, b"", np.zeros(PAGE_WIDTH, np.int64)
                for _, _, n_bytes, media_bytes, media_sha256, pixels, error in group:
                    if error:
                        raise TiffError(f"document {i}: {error}")
                    digest.update(pixels)
                    size, count, tail = size + len(pixels), count + 1, (tail + pixels[-PAGE_WIDTH:])[-PAGE_WIDTH:]
                    columns += np.frombuffer(pixels, np.uint8).reshape(-1, PAGE_WIDTH).sum(axis=0, dtype=np.int64)
                total = int(columns.sum())
                bits = int("".join("1" if PAGE_WIDTH * int(c) > total else "0" for c in columns), 2)
                yield i, n_bytes, size, digest.hexdigest(), zlib.crc32(tail), media_bytes, media_sha256, f"{count}:{100 * total // size}:{bits:016x}"

        yield from batches_of(rows(), schema)

    return paged.select(*names).mapInArrow(run, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
