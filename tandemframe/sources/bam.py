"""Alignment files as a Spark source: ``spark.read.format("alignments")``.

A BAM file is a series of BGZF blocks, each a gzip member with its size in an
extra field. With regions, or a filter on chrom, and an index beside the file a
partition is some ranges of it: the chunks of the bins that the regions touch,
so nothing else is read. Without, it is a byte range; it starts at the first
block at or after its beginning and, in it, at the first record that proves
itself over several records. Regions are applied before sequence and qualities
are decoded; columns that aren't asked for aren't decoded either.

A record's number is its virtual position, so it doesn't depend on the
partitions. Paths may be of any store that pyarrow opens (s3://, gs://, hdfs://).
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..errors import SourceError
from ..schemas import READS

_SEQ = "=ACMGRSVTWYHKDBN"
_TYPES = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I", b"f": "<f"}
SPLIT = 64 << 20


#: Files whose headers and indexes are read at a time when partitions are planned.
PLANNERS = 16


def store(path: str):
    """(file system, path in it): of a URI its own, else the local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def exists(path: str) -> bool:
    files, at = store(path)
    return bool(files.get_file_info(at).type.value)


def opened(path: str):
    files, at = store(path)
    return files.open_input_file(at)


class Blocks:
    """Decompressed bytes of a BGZF file from a block on; positions are virtual."""

    def __init__(self, path: str, start: int = 0):
        self.file = opened(path)
        self.size = self.file.size()
        self.block = start
        self.next = start
        self.data, self.at = b"", 0

    def tell(self) -> int:
        """The virtual position: the block's place in the file, then the place in the block."""
        return self.next << 16 if self.at == len(self.data) else self.block << 16 | self.at

    def seek(self, position: int) -> bool:
        self.next = position >> 16
        found = self.load()
        self.at = position & 0xFFFF
        return found

    def close(self) -> None:
        self.file.close()

    def load(self) -> bool:
        self.block = self.next
        self.file.seek(min(self.block, self.size))
        head = self.file.read(18)
        if len(head) < 18:
            self.data, self.at = b"", 0
            return False
        size = block_size(head)
        if size is None:
            raise SourceError(f"no BGZF block at byte {self.block}")
        raw = head + self.file.read(size - 18)
        self.data, self.at = zlib.decompress(raw[18:-8], -15), 0
        self.next = self.block + size
        return True

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.at == len(self.data) and not self.load():
                return b""
            got = self.data[self.at : self.at + n]
            self.at += len(got)
            n -= len(got)
            out.append(got)
        return b"".join(out)


def block_size(head: bytes) -> int | None:
    if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]]]:
    if blocks.read(4) != b"BAM\1":
        raise SourceError("not a BAM file")
    text = blocks.read(struct.unpack("<i", blocks.read(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return text, refs


def header(path: str) -> tuple[str, list[tuple[str, int]]]:
    blocks = Blocks(path)
    try:
        return read_header(blocks)
    finally:
        blocks.close()


def read_groups(text: str) -> list[dict[str, str]]:
    return [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in text.splitlines() if line.startswith("@RG")]


def _tags(raw: bytes) -> dict[bytes, object]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        key, kind = raw[at : at + 2], raw[at + 2 : at + 3]
        at += 3
        if kind in _TYPES:
            out[key] = struct.unpack_from(_TYPES[kind], raw, at)[0]
            at += struct.calcsize(_TYPES[kind])
        elif kind == b"A":
            out[key], at = raw[at : at + 1].decode(), at + 1
        elif kind in b"ZH":
            end = raw.index(b"\0", at)
            out[key], at = raw[at:end].decode("latin-1"), end + 1
        elif kind == b"B":
            sub, n = raw[at : at + 1], struct.unpack_from("<i", raw, at + 1)[0]
            at += 5 + n * struct.calcsize(_TYPES[sub])
        else:
            break
    return out


def _whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def decode(raw: bytes, refs, wanted: set[str]) -> dict:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + n_name
    cigar = [(x & 15, x >> 4) for x in struct.unpack_from(f"<{n_cigar}I", raw, at)]
    at += 4 * n_cigar
    span = sum(n for op, n in cigar if op in (0, 2, 3, 7, 8))
    out = {"qname": raw[32 : at - 4 * n_cigar - 1].decode("latin-1"), "flag": flag, "chrom": refs[ref][0] if ref >= 0 else None, "ref_start": pos, "mapq": mapq, "ref_end": pos + span if span and not flag & 4 else None}
    if "cigar" in wanted:
        out["cigar"] = cigar or None
    if "seq" in wanted and n_seq:
        packed = raw[at : at + (n_seq + 1) // 2]
        out["seq"] = "".join(_SEQ[b >> 4] + _SEQ[b & 15] for b in packed)[:n_seq]
    at += (n_seq + 1) // 2
    if "qual" in wanted and n_seq and raw[at] != 255:
        out["qual"] = list(raw[at : at + n_seq])
    at += n_seq
    if wanted & {"hp", "ps"}:
        tags = _tags(raw[at:])
        out["hp"], out["ps"] = _whole(tags.get(b"HP")), _whole(tags.get(b"PS"))
    return out


def _plausible(data: bytes, at: int, n_refs: int) -> bool:
    """Could records start here? Three in a row must make sense, as far as the data go."""
    for _ in range(3):
        if at + 36 > len(data):
            return at > 0
        size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, _ = struct.unpack_from("<iiiBBHHHiii", data, at)
        if not (32 < size < 1 << 28 and -1 <= ref < n_refs and pos >= -1 and n_name and -1 <= mate < n_refs and n_seq >= 0 and 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size):
            return False
        end = at + 36 + n_name - 1
        if end < len(data) and data[end] != 0:
            return False
        at += 4 + size
    return True


def bins_of(start: int, end: int) -> list[int]:
    """Bins of the binning scheme that a region [start, end) may have records in."""
    out = [0]
    for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        out += range(first + (start >> shift), first + (max(start, end - 1) >> shift) + 1)
    return out


def bin_of(start: int, end: int) -> int:
    """The least bin that holds all of [start, end)."""
    for first, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if start >> shift == max(start, end - 1) >> shift:
            return first + (start >> shift)
    return 0


def index_path(path: str) -> str | None:
    return next((p for p in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai") if exists(p)), None)


def read_index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], tuple[int, ...]]]:
    """For each reference: chunks of virtual positions by bin, and the position
    before which no record reaches into each 16 kb window."""
    with opened(path) as f:
        raw = f.read()
    if raw[:4] != b"BAI\1":
        raise SourceError(f"{path}: no index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        (n_bins,), at = struct.unpack_from("<i", raw, at), at + 4
        bins: dict[int, list[tuple[int, int]]] = {}
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", raw, at)
            ends = struct.unpack_from(f"<{2 * n}Q", raw, at + 8)
            bins[number] = list(zip(ends[::2], ends[1::2], strict=True))
            at += 8 + 16 * n
        (n_windows,), at = struct.unpack_from("<i", raw, at), at + 4
        out.append((bins, struct.unpack_from(f"<{n_windows}Q", raw, at)))
        at += 8 * n_windows
    return out


def chunks_of(index, spans: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Disjoint ranges of virtual positions, ascending, that hold every record of the spans of each reference."""
    found = []
    for ref, regions in spans.items():
        bins, windows = index[ref] if ref < len(index) else ({}, ())
        for start, end in regions:
            least = windows[start >> 14] if start >> 14 < len(windows) else 0
            found += [c for b in bins_of(start, min(end, 1 << 29)) for c in bins.get(b, ()) if b < 37450 and c[1] > least]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class Split(InputPartition):
    """Bytes [start, stop) of a file, or ``ranges`` of virtual positions in it."""

    def __init__(self, path: str, sample: str, start: int = 0, stop: int = 0, ranges: tuple[tuple[int, int], ...] = ()):
        self.path, self.sample, self.start, self.stop, self.ranges = path, sample, start, stop, ranges


def _list(path: str) -> list[str]:
    from pyarrow import fs

    files, at = store(path)
    if files.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".bam"))


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.paths = [p for given in options.get("path", "").split(",") if given for p in _list(given)]
        self.wanted = {f.name for f in schema.fields}
        self.names = [f.name for f in schema.fields]
        self.split = int(options.get("splitbytes", SPLIT))
        #: sample ids by path; else the first read group's
        self.samples = json.loads(options.get("samples", "{}"))
        #: chrom:start-end, half-open from 0, comma-separated
        self.regions: dict[str, list[tuple[int, int]]] = {}
        for r in filter(None, options.get("regions", "").split(",")):
            chrom, _, span = r.rpartition(":")
            a, b = map(int, span.split("-"))
            self.regions.setdefault(chrom, []).append((a, b))
        for v in self.regions.values():
            v.sort()
        self.chroms: set[str] | None = set(self.regions) or None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chroms = {f.value} & (self.chroms or {f.value})
            elif isinstance(f, In) and f.attribute == ("chrom",):
                self.chroms = set(f.value) & (self.chroms or set(f.value))
            else:
                yield f

    def partitions(self):
        with ThreadPoolExecutor(PLANNERS) as pool:
            return [p for planned in pool.map(self._planned, self.paths) for p in planned]

    def _planned(self, path: str) -> list[Split]:
        if not exists(path):
            raise SourceError(f"no such file: {path}")
        with opened(path) as f:
            size = f.size()
            if f.read(4) == b"CRAM":
                raise SourceError(f"{path}: CRAM needs a reference decoder, which is not part of this engine")
        text, refs = header(path)
        sample = self.samples.get(path) or next((g["SM"] for g in read_groups(text) if g.get("SM")), os.path.basename(path).split(".")[0])
        index = index_path(path) if self.chroms is not None else None
        if index is None:
            return [Split(path, sample, start, min(size, start + self.split)) for start in range(0, max(size, 1), self.split)]
        spans = {k: self.regions.get(name, [(0, length)]) for k, (name, length) in enumerate(refs) if name in self.chroms}
        out, own, held = [], [], 0
        for a, b in chunks_of(read_index(index), spans):
            own.append((a, b))
            held += (b >> 16) - (a >> 16) + 1
            if held >= self.split:
                out.append(Split(path, sample, ranges=tuple(own)))
                own, held = [], 0
        return [*out, Split(path, sample, ranges=tuple(own))] if own else out

    def _first_record(self, blocks: Blocks, part: Split, n_refs: int) -> bool:
        """Puts ``blocks`` at the first record that begins at or after part.start."""
        if part.start == 0:
            read_header(blocks)
            return True
        blocks.file.seek(part.start)
        window = blocks.file.read(1 << 17)
        at = -1
        while (at := window.find(b"\x1f\x8b\x08\x04", at + 1)) >= 0 and at + 18 <= len(window):
            size = block_size(window[at : at + 18])
            if size is None or window[at + size : at + size + 4] not in (b"\x1f\x8b\x08\x04", b""):
                continue
            if part.start + at >= part.stop:
                return False
            blocks.next = part.start + at
            while blocks.next < part.stop and blocks.load():
                data = blocks.data
                for k in range(len(data)):
                    if _plausible(data, k, n_refs):
                        blocks.at = k
                        return True
            return False
        return False

    def _overlaps(self, raw: bytes, refs) -> bool:
        if self.chroms is None:
            return True
        ref, pos = struct.unpack_from("<ii", raw)
        if ref < 0 or refs[ref][0] not in self.chroms:
            return False
        spans = self.regions.get(refs[ref][0])
        if not spans:
            return True
        n_name, n_cigar = raw[8], struct.unpack_from("<H", raw, 12)[0]
        ops = struct.unpack_from(f"<{n_cigar}I", raw, 32 + n_name)
        end = pos + max(1, sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8)))
        k = bisect.bisect_left(spans, (end, -1))
        return any(b > pos for _, b in spans[:k])

    def read(self, part: Split | None) -> Iterator[tuple]:
        if part is None:  # no partition: no region touches a chunk
            return
        refs = header(part.path)[1]
        blocks = Blocks(part.path)
        try:
            if part.ranges:
                for a, b in part.ranges:
                    if blocks.seek(a):
                        yield from self._rows(blocks, part, refs, b)
            elif self._first_record(blocks, part, len(refs)):
                yield from self._rows(blocks, part, refs, part.stop << 16)
        finally:
            blocks.close()

    def _rows(self, blocks: Blocks, part: Split, refs, stop: int) -> Iterator[tuple]:
        """Records that begin before the virtual position ``stop``."""
        while (place := blocks.tell()) < stop:
            head = blocks.read(4)
            if len(head) < 4:
                return
            raw = blocks.read(struct.unpack("<i", head)[0])
            if self._overlaps(raw, refs):
                row = decode(raw, refs, self.wanted)
                row["sample_id"], row["read_ord"] = part.sample, place
                yield tuple(row.get(c) for c in self.names)


class AlignmentSource(DataSource):
    """Options: path (files or folders, comma-separated), regions, samples (JSON: id by path), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return READS

    def reader(self, schema: StructType) -> AlignmentReader:
        return AlignmentReader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AlignmentSource)


def write_bam(path: str, refs: list[tuple[str, int]], records: list[dict], text: str = "") -> None:
    """A small BAM file of records (qname, flag, chrom, ref_start, mapq, cigar, seq, qual, hp, ps)."""
    index = {name: k for k, (name, _) in enumerate(refs)}
    body = [b"BAM\1", struct.pack("<i", len(text)), text.encode(), struct.pack("<i", len(refs))]
    for name, length in refs:
        body += [struct.pack("<i", len(name) + 1), name.encode() + b"\0", struct.pack("<i", length)]
    out = [b"".join(body)]
    for r in records:
        name, seq, cigar = r["qname"].encode() + b"\0", r.get("seq") or "", r.get("cigar") or []
        packed = bytearray((len(seq) + 1) // 2)
        for k, base in enumerate(seq):
            packed[k // 2] |= _SEQ.index(base) << (4 if k % 2 == 0 else 0)
        qual = bytes(r["qual"]) if r.get("qual") else b"\xff" * len(seq)
        tags = b"".join(key + b"i" + struct.pack("<i", r[f]) for key, f in ((b"HP", "hp"), (b"PS", "ps")) if r.get(f) is not None)
        ref = index.get(r.get("chrom"), -1)
        data = struct.pack("<iiBBHHHiiii", ref, r.get("ref_start", -1), len(name), r.get("mapq", 60), 4680, len(cigar), r.get("flag", 0), len(seq), -1, -1, 0)
        data += name + b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + bytes(packed) + qual + tags
        out.append(struct.pack("<i", len(data)) + data)
    raw = b"".join(out)
    with open(path, "wb") as f:
        for k in range(0, len(raw), 60_000):
            f.write(_bgzf(raw[k : k + 60_000]))
        f.write(_bgzf(b""))


def _bgzf(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_index(path: str) -> str:
    """An index of a sorted BAM file beside it; returns its path."""
    blocks = Blocks(path)
    try:
        refs = read_header(blocks)[1]
        found: list[tuple[dict[int, list[list[int]]], dict[int, int]]] = [({}, {}) for _ in refs]
        while True:
            begin = blocks.tell()
            head = blocks.read(4)
            if len(head) < 4:
                break
            raw = blocks.read(struct.unpack("<i", head)[0])
            ref, pos = struct.unpack_from("<ii", raw)
            if ref < 0 or pos < 0:
                continue
            n_name, n_cigar = raw[8], struct.unpack_from("<H", raw, 12)[0]
            end = pos + max(1, sum(x >> 4 for x in struct.unpack_from(f"<{n_cigar}I", raw, 32 + n_name) if x & 15 in (0, 2, 3, 7, 8)))
            bins, windows = found[ref]
            own = bins.setdefault(bin_of(pos, end), [])
            if own and own[-1][1] == begin:
                own[-1][1] = blocks.tell()
            else:
                own.append([begin, blocks.tell()])
            for k in range(pos >> 14, (end - 1 >> 14) + 1):
                windows.setdefault(k, begin)
    finally:
        blocks.close()
    out = [b"BAI\1", struct.pack("<i", len(refs))]
    for bins, windows in found:
        out.append(struct.pack("<i", len(bins)))
        for number, own in sorted(bins.items()):
            out += [struct.pack("<Ii", number, len(own)), *(struct.pack("<QQ", *c) for c in own)]
        n, before = max(windows, default=-1) + 1, 0
        out.append(struct.pack("<i", n))
        for k in range(n):
            before = windows.get(k, before)
            out.append(struct.pack("<Q", before))
    with open(f"{path}.bai", "wb") as f:
        f.write(b"".join(out))
    return f"{path}.bai"
