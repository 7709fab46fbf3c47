"""GeoTIFF as a Spark data source: tiled files in, sheets of tiles out.

Reading.  A path is a file or a folder of sheets.  The file's own tile index
(offset and size of every tile) makes the partitions: tiles are dealt out up to
``READ_BYTES`` of cells to a partition, and each is one read of its byte range.
Filters on ``r`` and ``c`` are pushed down to the index, so that a window reads
its tiles and no others.  Strips are tiles as wide as the grid.

Writing.  Cells go to sheets (one shuffle), a task writes a sheet at a time, with
its overviews beside the base, into a folder of the job's own.  The commit moves
the sheets into place; an abort deletes that folder, and nothing else is left.

Files are opened through ``pyarrow.fs`` in Python workers, so that the path must
be one that it reaches: local or mounted folders, ``file:``, ``s3:``, ``gs:``,
``hdfs:``.  Uncompressed, deflate and LZW tiles can be read, with either
predictor; deflate is written.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of decoded cells to a partition.
READ_BYTES = 64 << 20

#: TIFF tags and field types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_SIZES, FORMAT, SUBFILE, PIXEL_SCALE, TIEPOINT, GEOKEYS, NODATA = 317, 322, 323, 324, 325, 339, 254, 33550, 33922, 34735, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


class GeoTiffError(ValueError):
    """A file that is not, or not a whole, GeoTIFF of a kind that can be read."""


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and its name there."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class Image:
    """One image of a file: its grid, its tile index, and where its first cell lies in the whole grid."""

    path: str
    order: str
    rows: int
    cols: int
    dtype: str
    bands: int
    tile: tuple[int, int]
    compression: int
    predictor: int
    nodata: float | None
    origin: tuple[int, int]
    geo: tuple[float, ...] | None
    epsg: int | None
    offsets: list[int] = field(repr=False, default_factory=list)
    sizes: list[int] = field(repr=False, default_factory=list)

    @property
    def across(self) -> int:
        return -(-self.cols // self.tile[1])

    def span(self, i: int) -> tuple[int, int, int, int]:
        """First and last row and column of tile ``i`` in the whole grid."""
        r, c = i // self.across * self.tile[0], i % self.across * self.tile[1]
        r0, c0 = self.origin
        return r0 + r, r0 + min(r + self.tile[0], self.rows) - 1, c0 + c, c0 + min(c + self.tile[1], self.cols) - 1


class _Fields:
    """Fields of one directory; longer ones are read when they are asked for."""

    def __init__(self, file: pa.NativeFile, path: str, order: str, big: bool, at: int, size: int) -> None:
        self.file, self.path, self.order, self.size = file, path, order, size
        n_kind, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
        head = struct.calcsize(order + n_kind)
        n = struct.unpack(order + n_kind, self.bytes(at, head))[0]
        body = self.bytes(at + head, n * entry + struct.calcsize(word))
        self.entries = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + word, body, k * entry)
            self.entries[tag] = (kind, count, body[k * entry + 4 + struct.calcsize(word) : (k + 1) * entry])
        self.next = struct.unpack_from(order + word, body, n * entry)[0]
        self.word = word

    def bytes(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise GeoTiffError(f"{self.path} ends before its fields do")
        self.file.seek(at)
        return self.file.read(n)

    def get(self, tag: int, default=None):
        if tag not in self.entries:
            return default
        kind, count, inline = self.entries[tag]
        if kind not in FIELD:
            return default
        size = struct.calcsize(self.order + FIELD[kind]) * count
        raw = inline[:size] if size <= len(inline) else self.bytes(struct.unpack(self.order + self.word, inline)[0], size)
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace")
        return [v[0] for v in struct.iter_unpack(self.order + FIELD[kind][0], raw)]

    def one(self, tag: int, default: int | None = None) -> int:
        found = self.get(tag)
        if not found:
            if default is None:
                raise GeoTiffError(f"{self.path} lacks the field {tag}")
            return default
        return int(found[0])


def images(path: str) -> list[Image]:
    """The images of a file: the base, then its overviews; an error for what is not a whole file."""
    fs, name = open_path(path)
    with fs.open_input_file(name) as file:
        size = file.size()
        head = file.read(16)
        if len(head) < 8 or head[:2] not in (b"II", b"MM"):
            raise GeoTiffError(f"{path} is not a TIFF file")
        order = "<" if head[:2] == b"II" else ">"
        version = struct.unpack_from(order + "H", head, 2)[0]
        if version not in (42, 43):
            raise GeoTiffError(f"{path} is not a TIFF file")
        big = version == 43
        if len(head) < (16 if big else 8):
            raise GeoTiffError(f"{path} ends before its fields do")
        at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
        out: list[Image] = []
        seen: set[int] = set()
        while at:
            if at in seen:
                raise GeoTiffError(f"{path} has directories in a circle")
            seen.add(at)
            f = _Fields(file, path, order, big, at, size)
            out.append(_image(f, path, order, out[0] if out else None))
            at = f.next
    if not out:
        raise GeoTiffError(f"{path} holds no image")
    return out


def _image(f: _Fields, path: str, order: str, base: Image | None) -> Image:
    rows, cols, bands = f.one(LENGTH), f.one(WIDTH), f.one(SAMPLES, 1)
    key = (f.one(FORMAT, 1), f.one(BITS, 1))
    if key not in DTYPES or f.one(PLANAR, 1) != 1 or len({*(f.get(BITS) or [1])}) > 1:
        raise GeoTiffError(f"{path} has cells of an unknown kind")
    tiled = f.get(TILE_WIDTH) is not None
    tile = (f.one(TILE_LENGTH), f.one(TILE_WIDTH)) if tiled else (min(f.one(STRIP_ROWS, rows), rows), cols)
    offsets, sizes = (f.get(TILES, []), f.get(TILE_SIZES, [])) if tiled else (f.get(STRIPS, []), f.get(STRIP_SIZES, []))
    if min(rows, cols, bands, *tile) < 1:
        raise GeoTiffError(f"{path} has no cells")
    n = -(-rows // tile[0]) * -(-cols // tile[1])
    if len(offsets) != n or len(sizes) != n:
        raise GeoTiffError(f"{path} has {len(offsets)} tiles of {n}")
    compression = f.one(COMPRESSION, NONE)
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE):
        raise GeoTiffError(f"{path} is compressed in an unknown way ({compression})")
    place = re.search(r"first cell (-?\d+) (-?\d+)", f.get(DESCRIPTION, "") or "")
    origin = (int(place[1]), int(place[2])) if place else (0, 0)
    if base is not None and not place:
        origin = base.origin[0] * rows // base.rows, base.origin[1] * cols // base.cols
    tag = f.get(NODATA)
    scale, tie, keys = f.get(PIXEL_SCALE), f.get(TIEPOINT), f.get(GEOKEYS, [])
    geo = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]) if scale and tie else None
    codes = [keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in (2048, 3072) and keys[k + 1] == 0]
    nodata = float(tag) if tag else base.nodata if base else None
    return Image(path, order, rows, cols, DTYPES[key], bands, tile, compression, f.one(PREDICTOR, 1), nodata, origin, geo, codes[-1] if codes else None, offsets, sizes)


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the first bit first; 256 begins anew, 257 ends."""
    out, table, last = bytearray(), [], b""
    held = bits = 0
    wide = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < wide:
            continue
        bits -= wide
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, wide = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        wide = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def decode_tile(image: Image, data: bytes) -> np.ndarray:
    """(row, column, band) of a whole tile, in the file's numbers."""
    kind = np.dtype(image.order + image.dtype)
    shape = (*image.tile, image.bands)
    try:
        if image.compression in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        elif image.compression == LZW:
            data = _lzw(data)
    except (zlib.error, IndexError) as e:
        raise GeoTiffError(f"{image.path} has a broken tile") from e
    need = int(np.prod(shape)) * kind.itemsize
    # The last strip may be cut short.
    if len(data) < need and image.tile[1] == image.cols and len(data) % (image.cols * image.bands * kind.itemsize) == 0:
        data = data + bytes(need - len(data))
    if len(data) < need:
        raise GeoTiffError(f"{image.path} has a tile of {len(data)} bytes instead of {need}")
    if image.predictor == 3:
        # Differences of bytes, the highest byte of all cells of a row first.
        rows = np.frombuffer(data, np.uint8, need).reshape(shape[0], -1)
        whole = np.cumsum(rows.reshape(shape[0], -1, image.bands), axis=1, dtype=np.uint8).reshape(shape[0], kind.itemsize, -1)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    cells = np.frombuffer(data, kind, int(np.prod(shape))).reshape(shape)
    return np.cumsum(cells, axis=1, dtype=kind.newbyteorder("=")) if image.predictor == 2 else cells


#: Filters on rows and columns that the reader keeps itself: what they let through, and the least and greatest of it.
_KEPT = {
    EqualTo: (lambda x, v: x == v, lambda v: (v, v)),
    In: (lambda x, v: np.isin(x, [w for w in v if w is not None]), lambda v: (min((w for w in v if w is not None), default=np.inf), max((w for w in v if w is not None), default=-np.inf))),
    GreaterThan: (lambda x, v: x > v, lambda v: (np.floor(v) + 1, np.inf)),
    GreaterThanOrEqual: (lambda x, v: x >= v, lambda v: (v, np.inf)),
    LessThan: (lambda x, v: x < v, lambda v: (-np.inf, np.ceil(v) - 1)),
    LessThanOrEqual: (lambda x, v: x <= v, lambda v: (-np.inf, v)),
}


class GeoTiffReader(DataSourceReader):
    """See the module."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.level = options["path"], int(options.get("level", 0))
        self.names = [f.name for f in schema.fields]
        self.kept: list[Filter] = []
        self.window = {"r": (-np.inf, np.inf), "c": (-np.inf, np.inf)}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps comparisons of r and c with a value, which bound the tiles as well; gives all others back."""
        for f in filters:
            if type(f) not in _KEPT or f.attribute not in (("r",), ("c",)) or f.value is None:
                yield f
                continue
            self.kept.append(f)
            lo, hi = _KEPT[type(f)][1](f.value)
            a, b = self.window[f.attribute[0]]
            self.window[f.attribute[0]] = (max(a, lo), min(b, hi))

    def wanted(self, image: Image) -> list[int]:
        """Tiles that the window meets."""
        (r0, r1), (c0, c1) = self.window["r"], self.window["c"]
        spans = ((i, image.span(i)) for i in range(len(image.offsets)))
        return [i for i, (a, b, c, d) in spans if b >= r0 and a <= r1 and d >= c0 and c <= c1]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files_of(self.path):
            levels = images(path)
            if self.level >= len(levels):
                raise GeoTiffError(f"{path} has {len(levels) - 1} overviews")
            image = levels[self.level]
            wanted = self.wanted(image)
            each = max(1, READ_BYTES // (image.tile[0] * image.tile[1] * image.bands * np.dtype(image.dtype).itemsize))
            for k in range(0, len(wanted), each):
                some = wanted[k : k + each]
                index = [(i, image.span(i), image.offsets[i], image.sizes[i]) for i in some]
                out.append(InputPartition((Image(**{**image.__dict__, "offsets": [], "sizes": []}), index)))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        image, index = partition.value
        fs, name = open_path(image.path)
        bands = [n for n in self.names if n not in ("r", "c")]
        kinds = {"r": pa.int64(), "c": pa.int32()}
        with fs.open_input_file(name) as file:
            size = file.size()
            for _, (a, b, c, d), at, n in index:
                if at + n > size:
                    raise GeoTiffError(f"{image.path} ends before its tiles do")
                high, wide = b - a + 1, d - c + 1
                if n:
                    file.seek(at)
                    cells = decode_tile(image, file.read(n))[:high, :wide].astype(np.float64)
                else:  # a tile that was left out is nodata
                    cells = np.full((high, wide, image.bands), np.nan)
                missing = np.isnan(cells)
                if image.nodata is not None:
                    missing |= np.abs(cells - image.nodata) <= 1e-5
                rows, cols = np.arange(a, b + 1), np.arange(c, d + 1)
                in_r, in_c = (np.logical_and.reduce([np.ones(len(x), bool), *[_KEPT[type(f)][0](x, f.value) for f in self.kept if f.attribute == (n,)]]) for n, x in (("r", rows), ("c", cols)))
                rows, cols, cells, missing = rows[in_r], cols[in_c], cells[in_r][:, in_c], missing[in_r][:, in_c]
                columns = {"r": np.repeat(rows, len(cols)), "c": np.tile(cols, len(rows))}
                columns |= {name: pa.array(cells[:, :, k].ravel(), pa.float64(), mask=missing[:, :, k].ravel()) for k, name in enumerate(bands)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.float64())) for n in self.names], self.names)


def files_of(path: str) -> list[str]:
    """The file, or the sheets of the folder, at ``path``."""
    fs, name = open_path(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise GeoTiffError(f"There is no file {path}")
    if info.type == pafs.FileType.File:
        return [path]
    found = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(name)) if i.is_file and i.base_name.lower().endswith((".tif", ".tiff")))
    if not found:
        raise GeoTiffError(f"{path} holds no GeoTIFF file")
    return [f"{path.rstrip('/')}/{n}" for n in found]


class SheetMessage(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class GeoTiffWriter(DataSourceArrowWriter):
    """Sheets as they come, a task's cells in order of sheet; see :func:`write_geotiff`."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.sheet, self.tile, self.levels = int(options["sheet"]), int(options["tile"]), int(options.get("overviews", 0))
        self.dtype, self.nodata = options.get("dtype", "f8"), float(options["nodata"])
        self.geo = [float(v) for v in options["geo"].split()] if options.get("geo") else None
        self.epsg = int(options.get("epsg", 0))
        self.bands = [f.name for f in schema.fields if f.name not in ("sheet_r", "sheet_c", "r", "c")]
        self.scratch = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        fs, name = open_path(self.path)
        if not overwrite and fs.get_file_info(name).type != pafs.FileType.NotFound:
            raise GeoTiffError(f"{self.path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> SheetMessage:
        fs, scratch = open_path(self.scratch)
        fs.create_dir(scratch)
        names: list[str] = []
        at, cells, size = None, None, [0, 0]
        for batch in iterator:
            sr, sc, r, c = (batch.column(n).to_numpy() for n in ("sheet_r", "sheet_c", "r", "c"))
            values = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in self.bands], axis=1) if len(r) else None
            edges = np.concatenate([[0], np.flatnonzero((np.diff(sr) != 0) | (np.diff(sc) != 0)) + 1, [len(r)]]) if len(r) else [0]
            for lo, hi in zip(edges, edges[1:], strict=False):
                here = (int(sr[lo]), int(sc[lo]))
                if here != at:
                    if at is not None:
                        names.append(self._flush(fs, scratch, at, cells, size))
                    at, cells, size = here, np.full((self.sheet, self.sheet, len(self.bands)), np.nan), [0, 0]
                i, j = r[lo:hi] - here[0] * self.sheet, c[lo:hi] - here[1] * self.sheet
                cells[i, j] = values[lo:hi]
                size = [max(size[0], int(i.max()) + 1), max(size[1], int(j.max()) + 1)]
        if at is not None:
            names.append(self._flush(fs, scratch, at, cells, size))
        return SheetMessage(names)

    def _flush(self, fs: pafs.FileSystem, scratch: str, at: tuple[int, int], cells: np.ndarray, size: list[int]) -> str:
        name = f"sheet-{at[0]}-{at[1]}.tif"
        body = encode(cells[: size[0], : size[1]], (at[0] * self.sheet, at[1] * self.sheet), self.tile, self.dtype, self.nodata, self.levels, self.geo, self.epsg)
        # A task that runs twice writes under two names; the one that is committed is moved.
        part = f"{uuid.uuid4().hex}~{name}"
        with fs.open_output_stream(f"{scratch}/{part}") as out:
            out.write(body)
        return part

    def commit(self, messages: list[SheetMessage | None]) -> None:
        fs, root = open_path(self.path)
        _, scratch = open_path(self.scratch)
        parts = [n for m in messages if m for n in m.names]
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(root)):
                if i.is_file and i.base_name.startswith("sheet-"):
                    fs.delete_file(i.path)
        for part in parts:
            fs.move(f"{scratch}/{part}", f"{root}/{part.split('~')[1]}")
        fs.delete_dir(scratch)

    def abort(self, messages: list[SheetMessage | None]) -> None:
        fs, scratch = open_path(self.scratch)
        if fs.get_file_info(scratch).type == pafs.FileType.Directory:
            fs.delete_dir(scratch)
        _, root = open_path(self.path)
        if fs.get_file_info(root).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(root)):
            fs.delete_dir(root)


def overview(cells: np.ndarray) -> np.ndarray:
    """Half as many cells each way: means of the valid ones of two by two."""
    rows, cols = -(-cells.shape[0] // 2), -(-cells.shape[1] // 2)
    whole = np.full((2 * rows, 2 * cols, cells.shape[2]), np.nan)
    whole[: cells.shape[0], : cells.shape[1]] = cells
    four = whole.reshape(rows, 2, cols, 2, -1)
    known = ~np.isnan(four)
    n = known.sum(axis=(1, 3))
    return np.where(n > 0, np.where(known, four, 0).sum(axis=(1, 3)) / np.maximum(n, 1), np.nan)


def encode(cells: np.ndarray, origin: tuple[int, int], tile: int, dtype: str, nodata: float, levels: int = 0, geo: Sequence[float] | None = None, epsg: int = 0) -> bytes:
    """A file of (row, column, band): base and overviews in deflated tiles, little-endian, with 64-bit offsets; NaN is nodata.

    ``origin`` is the first cell's place in the whole grid.
    """
    kind = np.dtype("<" + dtype)
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    link = 8
    for level in range(levels + 1):
        high, wide, bands = cells.shape
        offsets, sizes = [], []
        for r in range(0, high, tile):
            for c in range(0, wide, tile):
                part = cells[r : r + tile, c : c + tile]
                whole = np.full((tile, tile, bands), nodata)
                whole[: part.shape[0], : part.shape[1]] = np.where(np.isnan(part), nodata, part)
                packed = zlib.compress((np.round(whole) if kind.kind in "iu" else whole).astype(kind).tobytes(), 6)
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed
        first = tuple(v >> level for v in origin)
        fields: dict[int, tuple[int, list | str]] = {
            SUBFILE: (4, [int(level > 0)]), WIDTH: (4, [wide]), LENGTH: (4, [high]), BITS: (3, [kind.itemsize * 8] * bands), COMPRESSION: (3, [DEFLATE]), PHOTOMETRIC: (3, [1]),
            DESCRIPTION: (2, f"first cell {first[0]} {first[1]}"), SAMPLES: (3, [bands]), PLANAR: (3, [1]), TILE_WIDTH: (4, [tile]), TILE_LENGTH: (4, [tile]), TILES: (16, offsets), TILE_SIZES: (16, sizes),
            FORMAT: (3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands), NODATA: (2, f"{nodata:.17g}"),
        }
        if bands > 1:
            fields[338] = (3, [0] * (bands - 1))  # further samples of no set meaning
        if geo is not None:
            x0, pw, _, y0, _, ph = geo
            fields[PIXEL_SCALE] = (12, [pw * 2**level, -ph * 2**level, 0.0])
            fields[TIEPOINT] = (12, [0.0, 0.0, 0.0, x0 + origin[1] * pw, y0 + origin[0] * ph, 0.0])
        if epsg:
            degrees = epsg == 4326
            fields[GEOKEYS] = (3, [1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, epsg])
        blobs: list[tuple[int, int, int, bytes]] = []
        for tag, (code, value) in sorted(fields.items()):
            raw = value.encode() + b"\0" if isinstance(value, str) else struct.pack(f"<{len(value)}{FIELD[code]}", *value)
            blobs.append((tag, code, len(raw) if isinstance(value, str) else len(value), raw))
        at = len(out) + len(out) % 2
        out += bytes(at - len(out))
        struct.pack_into("<Q", out, link, at)
        body, tail, free = struct.pack("<Q", len(blobs)), b"", at + 8 + 20 * len(blobs) + 8
        for tag, code, n, raw in blobs:
            body += struct.pack("<HHQ", tag, code, n) + (raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack("<Q", free + len(tail)))
            tail += raw if len(raw) > 8 else b""
        link = at + len(body)
        out += body + bytes(8) + tail
        cells = overview(cells)
    return bytes(out)


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff")``: r, c and z (several bands: b1, b2, ...); option ``level`` reads an overview."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        bands = images(files_of(self.options["path"])[0])[0].bands
        return "r long, c int, " + ("z double" if bands == 1 else ", ".join(f"b{k + 1} double" for k in range(bands)))

    def reader(self, schema: StructType) -> GeoTiffReader:
        return GeoTiffReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession, source: type[DataSource] = GeoTiffSource) -> None:
    """Makes a format known to a session, and lets filters reach it.

    Spark looks formats up in the session that is active in the calling thread, so
    that threads other than the one which made the session must be told of it.
    """
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    known = getattr(spark, "_tellurian_formats", set())
    if source.name() not in known:
        spark.dataSource.register(source)
        spark._tellurian_formats = known | {source.name()}


def read_geotiff(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """Cells (r, c, z) of a GeoTIFF file or folder of sheets, nodata as NULL; ``level`` counts overviews."""
    register(spark)
    return spark.read.format("geotiff").option("level", level).load(path)


def write_geotiff(cells: DataFrame, path: str, sheet: int = 4096, tile: int = 256, overviews: int = 0, dtype: str = "f8", nodata: float = -9999.0, geo: Sequence[float] | None = None, epsg: int = 0, mode: str = "append") -> None:
    """A folder of GeoTIFF sheets of ``sheet`` x ``sheet`` cells; columns besides r and c are bands.

    ``geo`` is (x0, pixel width, 0, y0, 0, pixel height) of cell (0, 0).  A sheet is
    held by one task at a time; overviews are means of the valid cells of two by
    two.  ``mode`` is ``append`` (an error where the folder is) or ``overwrite``.
    """
    if sheet % (tile << overviews) or tile % 16:
        raise ValueError("sheet must be a multiple of tile * 2**overviews, and tile one of 16")
    register(cells.sparkSession)
    bands = [n for n in cells.columns if n not in ("r", "c")]
    place = lambda n: F.floor(F.col(n) / sheet).cast("int")
    d = cells.select(place("r").alias("sheet_r"), place("c").alias("sheet_c"), F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), *[F.col(n).cast("double").alias(n) for n in bands])
    d = d.repartition("sheet_r", "sheet_c").sortWithinPartitions("sheet_r", "sheet_c")
    options = {"sheet": sheet, "tile": tile, "overviews": overviews, "dtype": dtype, "nodata": repr(float(nodata)), "epsg": epsg, "geo": " ".join(map(repr, geo)) if geo else ""}
    d.write.format("geotiff").options(**options).mode(mode).save(path)
