import os
import random
import struct
import tempfile

from tidemark.operators import filesystem, paths
from tidemark.sources import binaryfiles as B

FT = 116_444_736_000_000_000


def usn(name, *, ft=FT + 5, reason=0x100, attrs=0x20, major=2, minor=0, parent=77, length=None, name_len=None, name_off=60):
    raw = name.encode("utf-16-le")
    length = length or (60 + len(raw) + 7) // 8 * 8
    head = struct.pack("<IHHQQQQIIIIHH", length, major, minor, 1, parent | 3 << 48, 9, ft, reason, 0, 0, attrs,
                       len(raw) if name_len is None else name_len, name_off)
    return (head + raw).ljust(length, b"\0")


def test_pages_are_taken_apart_in_slices(spark, monkeypatch):
    """A batch of pages may be large; what is held besides it is not.  Records keep their page's image and host."""
    import pyarrow as pa
    parts = ["prev_tail", "content", "next_head"]
    batch = pa.RecordBatch.from_pydict({c: pa.array([b"x" * 300, None] * 20, pa.binary()) for c in parts})
    slices = list(B._slices(batch, parts, 2000))
    assert pa.Table.from_batches(slices).equals(pa.Table.from_batches([batch])) and max(s.num_rows for s in slices) <= 6
    assert not list(B._slices(batch.slice(0, 0), parts, 2000))

    rows = [(f"h{i % 3}" if i % 4 else None, f"i{i}", 0, b"" if i % 5 == 0 else usn(f"n{i}") + usn(f"m{i}"), b"", b"") for i in range(60)]
    df = spark.createDataFrame(rows, "host_id string, image_id string, chunk_off long, content binary, prev_tail binary, next_head binary")
    monkeypatch.setattr(B, "HELD_BYTES", 500)
    for read in (B.scan_usn, B.carve_usn):
        got = sorted((r.image_id, r.host_id or "", r.file_name) for r in read(df).collect())
        assert got == sorted((i, h or "", n + i[1:]) for h, i, _, content, _, _ in rows if content for n in "nm")


def test_packed_numbers_are_little_endian(spark):
    from pyspark.sql import functions as F
    from tidemark.plans.records_from_tables import pack_le
    numbers = [0, 1, 255, 256, 0x0123456789ABCDEF, -1, -2, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", *[pack_le(F.col("n"), w).alias(f"w{w}") for w in (2, 4, 8)])
    assert [[bytes(x) for x in r[1:]] for r in df.collect()] == [[n.to_bytes(8, "little", signed=True)[:w] for w in (2, 4, 8)] for n in numbers]


def live_walk(data):
    """The journal read byte by byte."""
    out, off = [], 0
    while off + 60 <= len(data):
        length, major = struct.unpack_from("<IH", data, off)
        if length < 60 or off + length > len(data):
            off += 8
            continue
        if major == 2:
            n, p = struct.unpack_from("<HH", data, off + 56)
            name = data[off + p:off + p + n // 2 * 2].decode("utf-16-le", "replace") if p + n <= length else None
            out.append((name, struct.unpack_from("<Q", data, off + 32)[0]))
        off += length
    return out


def carve_walk(data):
    out, off = [], 0
    while off + 60 <= len(data):
        length, major, minor = struct.unpack_from("<IHH", data, off)
        if length < 60 or length > 65536 or length % 8 or off + length > len(data) or major != 2 or minor:
            off += 8
            continue
        n, p = struct.unpack_from("<HH", data, off + 56)
        if n and p + n <= length:
            out.append((data[off + p:off + p + n].decode("utf-16-le", "replace"), struct.unpack_from("<Q", data, off + 32)[0]))
        off += length
    return out


def pages(spark, data, size):
    rows = [("i", o, data[o:o + size], data[max(o - 65536, 0):o], data[o + size:o + size + 65536]) for o in range(0, len(data), size)]
    return spark.createDataFrame(rows, "image_id string, chunk_off bigint, content binary, prev_tail binary, next_head binary")


def result(df):
    return sorted((r.file_name or "", r.filetime) for r in df.collect())


def sample(rng):
    inner = usn("embedded.txt")
    parts = [bytes(64), usn("a.txt"), usn("old", major=3), usn("dir", attrs=0x10), usn("x" * 40, parent=5),
             usn("bad", name_off=500), usn("", ft=0), usn("wrap", length=60 + 12 + len(inner) + 8)[:-len(inner)] + inner,
             struct.pack("<Q", 61), b"\xff" * 16, usn("n1", minor=1), usn("tiny.bin", name_len=7)]
    rng.shuffle(parts)
    return b"".join(parts) + bytes(8)


def test_scan_and_carve_match_a_byte_walk(spark):
    rng = random.Random(3)
    for _ in range(4):
        data = b"".join(sample(rng) for _ in range(6))
        whole = pages(spark, data, len(data))
        assert result(B.scan_usn(whole)) == sorted((n or "", t) for n, t in live_walk(data))
        assert result(B.carve_usn(whole)) == sorted(carve_walk(data))


def test_unaligned_lengths(spark):
    odd = struct.pack("<I", 67) + usn("odd")[4:67]
    data = usn("a") + odd + usn("after").ljust(120, b"\0") + usn("b") + bytes(200)
    assert result(B.scan_usn(pages(spark, data, len(data)))) == sorted((n or "", t) for n, t in live_walk(data))


def test_records_across_pages(spark):
    data = b"".join(usn(f"file{i}.txt", ft=FT + i) for i in range(400))
    got = result(B.scan_usn(pages(spark, data, 1024)))
    assert [t for _, t in sorted(got, key=lambda r: r[1])] == [FT + i for i in range(400)]
    stored = pages(spark, data, 1024).drop("next_head", "prev_tail")
    assert result(B.scan_usn(stored, 1024)) == got
    files = spark.createDataFrame([("i", data)], "image_id string, content binary")
    assert result(B.carve_usn(B.chunk_files(files, 2048))) == got
    assert B.scan_usn(pages(spark, bytes(4096), 1024)).count() == 0


def mft_entry(name="test.txt", times=(100, 200, 300, 400), fn_time=100, parent=0, flags=1, magic=b"FILE", namespace=1, extra=None, attrs=True):
    e = bytearray(1024)
    e[0:4] = magic
    struct.pack_into("<HH", e, 4, 48, 3)
    struct.pack_into("<H", e, 20, 56)
    struct.pack_into("<H", e, 22, flags)
    struct.pack_into("<HHH", e, 48, 0xBEEF, 0x1111, 0x2222)
    off = 56
    def put(kind, content):
        nonlocal off
        size = (24 + len(content) + 7) // 8 * 8
        struct.pack_into("<II", e, off, kind, size)
        struct.pack_into("<IH", e, off + 16, len(content), 24)
        e[off + 24:off + 24 + len(content)] = content
        off += size
    def name_attr(n, ns):
        t = FT + fn_time * 10**7
        return struct.pack("<QQQQQQQIIBB", parent, t, t, t, t, 0, 0, 0x20, 0, len(n), ns) + n.encode("utf-16-le")
    if attrs:
        put(0x10, struct.pack("<QQQQ", *[FT + t * 10**7 for t in times]))
        for n, ns in [(name, namespace)] + (extra or []):
            put(0x30, name_attr(n, ns))
    struct.pack_into("<I", e, off, 0xFFFFFFFF)
    struct.pack_into("<H", e, 510, 0xBEEF)
    struct.pack_into("<H", e, 1022, 0xBEEF)
    return bytes(e)


def test_decode_mft(spark):
    entries = [mft_entry(), mft_entry(flags=0), mft_entry(magic=b"BAAD"), mft_entry("Dir", flags=3), mft_entry("SHORT~1", namespace=2),
               mft_entry(attrs=False), mft_entry("first", extra=[("second", 0), ("DOS~1", 2)], parent=3 | 9 << 48), mft_entry("long name " * 25)]
    df = spark.createDataFrame([("i", 0, b"".join(entries[:5])), ("i", 5 * 1024, b"".join(entries[5:]))],
                               "image_id string, chunk_off bigint, content binary")
    got = {r.entry: r for r in B.decode_mft(df).collect()}
    assert sorted(got) == [0, 3, 4, 5, 6, 7]
    assert got[0].name == "test.txt" and got[0].si == [FT + t * 10**7 for t in (100, 200, 300, 400)] and got[0].parent == 0
    assert got[4].name == "entry#4" and got[4].fn is None and got[4].si is not None
    assert got[5].si is None and got[5].fn is None and got[5].name == "entry#5"
    assert got[6].name == "second" and got[6].parent == 3
    # The name runs over the first sector's end, where the saved bytes belong.
    raw = bytearray(("long name " * 25).encode("utf-16-le"))
    at = 510 - (56 + 56 + 24 + 66)
    raw[at:at + 2] = struct.pack("<H", 0x1111)
    assert got[7].name == raw.decode("utf-16-le")


def test_fixture_entry_gives_five_events(spark):
    df = spark.createDataFrame([("i", 0, mft_entry())], "image_id string, chunk_off bigint, content binary")
    mft = B.decode_mft(df)
    rows = filesystem.mft_events(mft, paths.resolve_paths(mft)).orderBy("is_fn_timestamp", "timestamp_ns").collect()
    assert [(r.macb, r.is_fn_timestamp, r.timestamp_ns // 10**9) for r in rows] == [
        ("...B", False, 100), ("M...", False, 200), ("..C.", False, 300), (".A..", False, 400), ("MACB", True, 100)]
    assert {(r.source, r.file_path, r.message) for r in rows} == {("$MFT", "\\test.txt", "test.txt")}


def test_read_pages(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = os.path.join(folder, "mft.bin")
    with open(path, "wb") as f:
        f.write(b"".join(mft_entry(f"f{i}") for i in range(50)))
    names = {r.entry: r.name for r in B.decode_mft(B.read_pages(spark, path, "img", 2048)).collect()}
    assert names == {i: f"f{i}" for i in range(50)}


def test_read_pages_of_any_size(spark):
    """A short last page, records across edges, and the same rows for every page size."""
    rng = random.Random(11)
    data = b""
    while len(data) < 150_000:
        inner = usn("ghost.txt")
        data += rng.choice([usn(f"f{len(data)}", ft=FT + len(data)), sample(rng), bytes(8 * rng.randint(1, 300)), rng.randbytes(8 * rng.randint(1, 40)),
                            usn("w" * 30, length=60 + 64 + len(inner) + 4)[:-len(inner)] + inner])
    data = data[:len(data) // 8 * 8 - 24]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = os.path.join(folder, "journal.bin")
    with open(path, "wb") as f:
        f.write(data)
    for decode in (B.scan_usn, B.carve_usn):
        rows = [result(decode(B.read_pages(spark, path, "img", size))) for size in (1024, 4096, 65_536, 1 << 20)]
        assert rows[0] and all(r == rows[0] for r in rows)
        assert result(decode(pages(spark, data, 3000 * 8))) == rows[0]
    first = B.read_pages(spark, path, "img", 4096, host_id="pc").orderBy("chunk_off").collect()
    assert b"".join(bytes(r.content) for r in first) == data and len(first[-1].content) < 4096
    assert {r.host_id for r in B.scan_usn(B.read_pages(spark, path, "img", 4096, host_id="pc")).collect()} == {"pc"}


def test_recycle_notes(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    name = "C:\\a.txt".encode("utf-16-le")
    notes = {
        "$IA": struct.pack("<QQQ", 1, 10, FT + 1) + name.ljust(520, b"\0"),
        "$IB": struct.pack("<QQQI", 2, 2048, FT + 2, len(name) // 2 + 1) + name + b"\0\0",
        "$IC": struct.pack("<QQQI", 3, 1, FT + 2, 1) + name,
        "$ID": struct.pack("<QQQI", 2, 1, 0, 1) + name,
        "$IE": struct.pack("<QQQI", 2, 1, FT + 2, 1) + b"\0\0",
        "$IF": b"short", "$RA": b"data",
    }
    for file, body in notes.items():
        with open(os.path.join(folder, file), "wb") as f:
            f.write(body)
    got = {r.path.rsplit("/", 1)[1]: (r.original_path, r.file_size) for r in B.read_recycle_i(spark, folder).collect()}
    assert got == {"$IA": ("C:\\a.txt", 10), "$IB": ("C:\\a.txt", 2048)}
