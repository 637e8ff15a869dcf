"""Headers of geometry and image blobs as column expressions over hexadecimal digits.

``at(h, i, n)`` takes n bytes from offset i of a blob's digits; numbers are read by
``conv``, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(h: Column, offset: Column | int, n: int) -> Column:
    start = offset * 2 + 1 if isinstance(offset, int) else (offset * 2 + 1).cast("int")
    return F.substring(h, start, 2 * n)


def unsigned(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def swapped(digits: Column, n: int) -> Column:
    """Digits of n bytes in reverse order of bytes."""
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])


def number(h: Column, offset: Column | int, n: int, little: Column) -> Column:
    digits = at(h, offset, n)
    return F.when(little, unsigned(swapped(digits, n))).otherwise(unsigned(digits))


def signed32(x: Column) -> Column:
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


ENVELOPE_BYTES = (0, 32, 48, 48, 64)


def gp_header(blob: Column, *, compat: bool = True) -> Column:
    """Struct of a geometry blob's header; null if the magic bytes are missing.

    With ``compat`` the Z and M flags are read from the envelope bits, as the profile's
    common reader does (an XY envelope then counts as Z); else from the geometry type.
    """
    h = F.hex(blob)
    flags = unsigned(at(h, 3, 1))
    little = flags.bitwiseAND(F.lit(1)) == 1
    code = F.shiftright(flags, 1).bitwiseAND(F.lit(7))
    size = F.element_at(F.array(*[F.lit(n) for n in ENVELOPE_BYTES]), F.least(code, F.lit(4)).cast("int") + 1)
    body = F.lit(8) + size
    wkb_little = unsigned(at(h, body, 1)) == 1
    kind = number(h, body + 1, 4, wkb_little)
    has_z = flags.bitwiseAND(F.lit(2)) != 0 if compat else F.floor(kind / 1000).isin(1, 3)
    has_m = flags.bitwiseAND(F.lit(4)) != 0 if compat else F.floor(kind / 1000).isin(2, 3)
    return F.when(
        at(h, 0, 2) == "4750",
        F.struct(
            unsigned(at(h, 2, 1)).alias("version"),
            flags.alias("flags"),
            signed32(number(h, 4, 4, little)).alias("srs_id"),
            code.alias("envelope"),
            (flags.bitwiseAND(F.lit(16)) != 0).alias("is_empty"),
            has_z.alias("has_z"),
            has_m.alias("has_m"),
            body.cast("int").alias("wkb_offset"),
            kind.alias("wkb_type"),
        ),
    )


def image_format(blob: Column) -> Column:
    h = F.hex(F.substring(blob, 1, 16))
    return (
        F.when(F.startswith(h, F.lit("89504E470D0A1A0A")), "PNG")
        .when(F.startswith(h, F.lit("FFD8FF")), "JPEG")
        .when(F.startswith(h, F.lit("52494646")) & (at(h, 8, 4) == "57454250"), "WEBP")
        .when(F.startswith(h, F.lit("49492A00")) | F.startswith(h, F.lit("4D4D002A")), "TIFF")
        .otherwise("UNKNOWN")
    )


def png_size(blob: Column) -> Column:
    """Width and height from the first chunk of a PNG; null for anything else."""
    h = F.hex(F.substring(blob, 1, 24))
    return F.when((image_format(blob) == "PNG") & (at(h, 12, 4) == "49484452"), F.struct(unsigned(at(h, 16, 4)).alias("width"), unsigned(at(h, 20, 4)).alias("height")))


def jpeg_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the frame header of a JPEG, wherever it stands; for use in a pandas UDF."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    i = 2
    while i + 9 <= len(data):
        if data[i] != 0xFF:
            i += 1
            continue
        mark = data[i + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[i + 7 : i + 9], "big"), int.from_bytes(data[i + 5 : i + 7], "big")
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD9:
            i += 1 if mark == 0xFF else 2
            continue
        i += 2 + int.from_bytes(data[i + 2 : i + 4], "big")
    return None


def tiff_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first directory of a TIFF of either byte order."""
    order = "little" if data[:2] == b"II" else "big"
    number = lambda at, n: int.from_bytes(data[at : at + n], order)
    at, found = number(4, 4), {}
    for i in range(number(at, 2) if 0 < at <= len(data) - 2 else 0):
        entry = at + 2 + 12 * i
        if entry + 12 > len(data):
            return None
        tag, kind = number(entry, 2), number(entry + 2, 2)
        if tag in (256, 257):
            found[tag] = number(entry + 8, 2 if kind == 3 else 4)
    return (found[256], found[257]) if len(found) == 2 else None


def image_head(data: bytes | None) -> tuple[str, tuple[int, int] | None]:
    """Format of an image by its first bytes, and its size if they hold it."""
    data = data or b""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        size = (int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")) if data[12:16] == b"IHDR" and len(data) >= 24 else None
        return "PNG", size
    if data.startswith(b"\xff\xd8\xff"):
        return "JPEG", jpeg_size(data)
    if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
        return "WEBP", None
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "TIFF", tiff_size(data)
    return "UNKNOWN", None
