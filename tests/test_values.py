import pytest

from loomlog.functions import values

VECTORS = [
    (0x01, "610062000000", "ab"), (0x01, "61003C006200", "a&lt;b"), (0x01, "00D86100", "�a"), (0x01, "FFFE6100", "a"),
    (0x02, "80", "€"), (0x02, "8100", "\x81"), (0x03, "FF", "-1"), (0x04, "FF", "255"), (0x09, "FF" * 8, "-1"), (0x0A, "FF" * 8, "18446744073709551615"),
    (0x0B, "CDCCCC3D", "0.10000000149011612"), (0x0B, "0000803F", "1"), (0x0C, "50EFE2D6E41A4B44", "1e+21"), (0x0C, "408CB5781DAF1544", "100000000000000000000"),
    (0x0C, "48AFBC9AF2D77A3E", "1e-7"), (0x0C, "0000000000000080", "0"), (0x0C, "000000000000F07F", "Infinity"), (0x0C, "000000000000F87F", "NaN"),
    (0x0D, "01000000", "true"), (0x0D, "00000000", "false"), (0x0E, "DEADBEEF", "DEADBEEF"),
    (0x0F, "00112233445566778899AABBCCDDEEFF", "{33221100-5544-7766-8899-AABBCCDDEEFF}"), (0x0F, "AABBCCDD112233445566778899AABBCC", "{ddccbbaa-2211-4433-5566-778899AABBCC}"), (0x0F, "AABB", ""),
    (0x10, "01000000", "0x00000001"), (0x10, "0100000000000000", "0x0000000000000001"), (0x11, "879696ED8A49DA01", "2024-01-17T21:20:00.1234567Z"), (0x11, "0000000000000000", ""),
    (0x12, "E8070100030011001500140000007B00", "2024-01-17T21:20:00.123Z"), (0x13, "010100000000000512000000", "S-1-5-18"), (0x13, "010500000000000512000000", "S-1-5-18"),
    (0x14, "EFBEADDE", "0xdeadbeef"), (0x15, "EFBEADDE00000000", "0x00000000deadbeef"), (0x81, "61000000000062000000", "a, b"), (0x86, "0100020003", "1, 2"), (0x88, "0100", "0100"),
    (0x8D, "0100000000000000", "0100000000000000"), (0x16, "AB", "<!-- unknown type 0x16 -->AB"), (0x00, "01", ""),
]


@pytest.mark.parametrize(("kind", "raw", "text"), VECTORS)
def test_value_text(kind, raw, text):
    data = bytes.fromhex(raw)
    assert values.render(data + bytes(16), 0, len(data), kind) == text


@pytest.mark.parametrize("kind", [0x01, 0x06, 0x0F, 0x13, 0x21, 0x86, 0x99])
def test_no_bytes_no_text(kind):
    assert values.render(bytes(64), 8, 0, kind) == ""


def test_years_beyond_four_digits():
    assert values.filetime_text(2**64 - 1).startswith("60056-05-28T05:36:10.9551615Z")


@pytest.mark.parametrize(("x", "text"), [(0.1, "0.1"), (123456.789, "123456.789"), (1e-6, "0.000001"), (-2.5e-7, "-2.5e-7"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (-0.0, "0"), (1e20, "100000000000000000000")])
def test_number_text(x, text):
    assert values.number_text(x) == text


def test_native_filetime_matches(spark):
    from pyspark.sql import functions as F

    from loomlog.functions.time import filetime_iso

    ticks = [0, 1, 116444736000000000, 133500000001234567, 2650467743999999999, 2650467744000000000, 2**63, 2**64 - 1, 9999999]
    rows = spark.createDataFrame([(str(t),) for t in ticks], "t string").select("t", filetime_iso(F.col("t").cast("decimal(20,0)")).alias("iso")).collect()
    assert {r.t: r.iso for r in rows} == {str(t): values.filetime_text(t) for t in ticks}


def test_hex_keeps_all_digits(spark):
    from loomlog.functions import register, text

    register.register(spark)
    numbers = [0, 60000, 2**32 - 1, 2**32, 7919 * 10**6, 2**63 - 1, -1, -5 * 7919, -(2**63), None]
    wanted = [None if n is None else f"0x{n % 2**64:08x}" for n in numbers]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n bigint").orderBy("i")
    assert [tuple(r) for r in rows.select(text.hex32(rows.n), "n").selectExpr("*", "hex32(n)").drop("n").collect()] == [(w, w) for w in wanted]
