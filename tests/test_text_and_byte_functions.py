from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators.browsing import browser_of


def test_little_endian(one):
    b = F.lit(bytes(range(1, 9)) + b"\xff" * 8)
    assert one(fn.le_u16(b, 0), fn.le_u32(b, 1), fn.le_i64(b, 0), fn.le_i64(b, 8), fn.le_u16(b, 15)) == [
        0x0201, 0x05040302, 0x0807060504030201, -1, 0]
    assert int(one(fn.le_u64(b, 8))) == 2**64 - 1


def test_strings(one):
    wide = F.lit("ab\0cd".encode("utf-16-le"))
    assert one(fn.utf16le(wide, 0, 2), fn.utf16le_z(wide, 0), fn.utf16le_z(wide, 6), fn.utf16le_counted(wide, 2, 3)) == ["ab", "ab", "cd", "b"]
    assert one(fn.ascii_z(F.lit(b"xy\0z"), 0), fn.ascii_z(F.lit(b"xy"), 9)) == ["xy", ""]
    assert one(fn.text_by_bom(F.lit(b"\xff\xfeA\0")), fn.text_by_bom(F.lit(b"A\xffB"))) == ["A", "A�B"]
    assert one(fn.cp1252_text(F.lit(b"\x80uro caf\xe9 \x93q\x94"))) == "€uro café “q”"


def test_sids(one):
    raw = bytes([1, 2, 0, 0, 0, 0, 0, 5]) + (32).to_bytes(4, "little") + (544).to_bytes(4, "little")
    assert one(fn.sid_from_bytes(F.lit(raw)), fn.sid_from_bytes(F.lit(raw[:10])), fn.sid_from_bytes(F.lit(bytes([1, 0, 0, 0, 0, 0, 0, 1])))) == [
        "S-1-5-32-544", None, "S-1-1"]
    assert one(*[fn.resolve_sid(F.lit(s)) for s in ("S-1-5-18", "S-1-5-21-9-500", "S-1-5-21-9-501", "S-1-5-21-9-1001")]) == [
        "SYSTEM", "Administrator (S-1-5-21-9-500)", "Guest (S-1-5-21-9-501)", "S-1-5-21-9-1001"]


def test_registry_values(one):
    def text(kind, raw):
        return fn.reg_value_text(F.lit(kind), F.lit(raw))
    assert one(text(1, "hi\0".encode("utf-16-le")), text(4, b"\x01\0\0\x80"), text(5, b"\0\0\1\0"), text(11, b"\xff" * 8),
               text(7, "a\0b\0\0".encode("utf-16-le")), text(3, bytes(20)), text(4, b"\x01"), text(0, b"\xab")) == [
        "hi", "2147483649", "256", str(2**64 - 1), "a | b", "00" * 16 + "...", "01", "ab"]
    assert one(text(1, ("x" * 90).encode("utf-16-le"))) == "x" * 80 + "..."
    assert one(*[fn.looks_like_hex(F.lit(s)) for s in ("deadbeef...", "deadbee", "C:\\a", "0123456789")]) == [True, False, False, True]


def test_reasons_and_sizes(one):
    assert one(fn.usn_reasons(F.lit(0x80000101)), fn.usn_reasons(F.lit(0x80000101), True), fn.usn_reasons(F.lit(0x10)), fn.usn_reasons(F.lit(0))) == [
        "FILE_CREATE|DATA_OVERWRITE|CLOSE", "DATA_OVERWRITE|FILE_CREATE|CLOSE", "0x00000010", "0x00000000"]
    sizes = [0, 1023, 1024, 2047, 1 << 20, 1342177280, 1 << 30, (1 << 20) * 5 // 4]
    assert one(*[fn.fmt_size(F.lit(s)) for s in sizes]) == [
        "0 bytes", "1023 bytes", "1 KB", "1 KB", "1.0 MB", "1.2 GB", "1.0 GB", "1.2 MB"]
    assert one(fn.thousands(F.lit(1234567)), fn.trunc(F.lit("abcdef"), 3), fn.trunc(F.lit("abc"), 3)) == ["1,234,567", "abc...", "abc"]


def test_names(one):
    assert one(fn.rot13(F.lit("Uryyb")), fn.base_name(F.lit("a\\b\\c")), fn.file_uri_to_path(F.lit("file:///C:/a/b"))) == ["Hello", "c", "C:\\a\\b"]
    assert one(*[browser_of(F.lit(p)) for p in ("/u/Firefox/x", "/u/x/places.sqlite", "C:\\Edge\\History", "/u/h")]) == [
        "Firefox", "Firefox", "Edge", "Chrome"]


def test_labels(one):
    assert one(fn.logon_type_name(F.lit(10)), fn.logon_type_name(F.lit(6)), fn.drive_type_name(F.lit(3)), fn.iface_name(F.lit(71)),
               fn.iface_name(F.lit(5)), fn.pca_status_name(F.lit(9)), fn.activity_name(F.lit(7)), fn.level_tag(F.lit(2)), fn.level_tag(F.lit(4))) == [
        "RemoteInteractive", "Unknown", "Fixed", "WiFi", "iface=5", "status=9", "Type7", " [ERROR]", ""]
    desc = [fn.macb_desc(F.lit(m), F.lit("X")) for m in ("M", ".A..", "M.C.", "?")] + [fn.macb_desc(F.lit("M.C."), F.lit("X"), True), fn.macb_desc(F.lit("B"), F.lit(""))]
    assert one(*desc) == ["X Last Written", "X Last Accessed", "X Last Written, Last Changed (MFT)", "X Timestamp", "X Timestamp", "Created"]


def test_activity_json(one):
    assert one(*[fn.timeline_app_name(F.lit(j)) for j in ('[{"application":""},{"application":"C:\\\\b\\\\a.exe"}]', '[{"x":1}]', "bad", '[{"application":"app"}]')]) == [
        "a.exe", "", "", "app"]
    payloads = ['{"displayText":" hi "}', '{"payload":"{\\"contentUri\\":\\"u\\"}"}', '{"userTimeline":{"description":"d"}}', "x", '{"k":1}']
    assert one(*[fn.timeline_payload(F.lit(p)) for p in payloads]) == ["hi", "u", "d", "", ""]


def test_noise(one):
    noise = ["ab", "{x", "a://b", "12-3", "#c", "Level", "Microsoft-X", "PowerShellX", "0f8fad5b-d9cb-469f-a165-70867728950e", "xicrosoft-y"]
    clean = ["alice", "C:\\x", "Microsoftish", "a-b"]
    assert one(*[fn.is_evtx_noise(F.lit(s)) for s in noise]) == [True] * len(noise)
    assert one(*[fn.is_evtx_noise(F.lit(s)) for s in clean]) == [False] * len(clean)
