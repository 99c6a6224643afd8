"""Detection and conversion of text encodings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.errors import InvalidFormat

#: name, codec, is Unicode, has variable width, most bytes of a character, where it is common
ENCODINGS = {
    "UTF-8": ("utf-8", True, True, 4, ["International", "Web", "Modern files"]),
    "UTF-16LE": ("utf-16-le", True, False, 2, ["Windows"]),
    "UTF-16BE": ("utf-16-be", True, False, 2, ["Network"]),
    "Windows-1252": ("windows-1252", False, False, 1, ["Windows", "Latin languages"]),
    "ISO-8859-1": ("latin-1", False, False, 1, ["Unix", "Latin languages", "Old systems"]),
    "GB2312": ("gb18030", False, True, 2, ["Asian languages"]),
    "Big5": ("big5hkscs", False, True, 2, ["Asian languages"]),
    "Shift-JIS": ("cp932", False, True, 2, ["Asian languages"]),
    "EUC-KR": ("cp949", False, True, 2, ["Asian languages"]),
    "Unknown": (None, False, False, 1, []),
}
_PRIORITY = ("GB2312", "Big5", "Shift-JIS", "EUC-KR", "Windows-1252")
_BOMS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def _in(low: int, high: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[low : high + 1] = True
    return out


_PAIRS = {
    "GB2312": (_in(0xA1, 0xF7), _in(0xA1, 0xFE)),
    "Big5": (_in(0xA1, 0xFE) | _in(0x87, 0x87), _in(0x40, 0x7E) | _in(0xA1, 0xFE)),
    "Shift-JIS": (_in(0x81, 0x9F) | _in(0xE0, 0xEF), _in(0x40, 0x7E) | _in(0x80, 0xFC)),
    "EUC-KR": (_in(0xA1, 0xFE), _in(0xA1, 0xFE)),
}


def score(data: bytes, name: str) -> float:
    """How well bytes fit a legacy encoding: points for characters, over the length (over half of it for double-byte ones)."""
    if not data:
        return 0.0
    b = np.frombuffer(data, np.uint8)
    if name == "Windows-1252":
        printable = (b >= 0x20) & (b < 0x7F)
        wide = (b >= 0xA0) & (b < 0xFF)
        if not printable.any():
            return 0.0
        return float((0.1 * (b < 0x20) + printable + 0.8 * wide - 0.5 * ~((b < 0x7F) | wide)).sum() / len(b))
    lead, trail = _PAIRS[name]
    total, i, n = float(((b >= 0x20) & (b < 0x7F)).sum()), 0, len(b)
    high = np.flatnonzero(b >= 0x80)
    used = -1
    for i in high.tolist():
        if i <= used:
            continue
        if name == "Shift-JIS" and not lead[b[i]]:
            total += 0.8
        elif i + 1 < n:
            second = int(b[i + 1])
            good = lead[b[i]] and trail[second] and not (name == "Big5" and b[i] == 0x87 and second < 0xA1)
            total += 2.0 if good else -1.0
            if 0x20 <= second < 0x7F:
                total -= 1.0  # it was counted as a character of its own
            used = i + 1
        else:
            total -= 0.5
    return total / (n / 2)


def detect(data: bytes) -> str:
    """Byte-order mark, then UTF-8, then the best score; of equal scores the first of GB2312, Big5, Shift-JIS, EUC-KR, Windows-1252."""
    if not data:
        return "Unknown"
    for mark, name in _BOMS:
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    best = max(_PRIORITY, key=lambda name: (score(data, name), -_PRIORITY.index(name)))
    return best if score(data, best) >= 0.1 else "Windows-1252"


def convert(data: bytes, name: str) -> str:
    """Text of bytes in an encoding; what it cannot stand for raises. A byte-order mark stays in the text."""
    if name == "Unknown":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            name = "Windows-1252"
    if name == "Windows-1252":
        return "".join(bytes([x]).decode("cp1252") if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(x) for x in data)
    codec = ENCODINGS[name][0]
    try:
        return data.decode(codec)
    except UnicodeDecodeError as e:
        raise InvalidFormat(f"no {name}: {e}") from e


def detect_encoding(data: Column | str) -> Column:
    """The name of the encoding of a binary column. UTF-8, by far the most common, never leaves the JVM's test."""
    col = F.col(data) if isinstance(data, str) else data

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else detect(x) for x in column.to_pylist()], pa.string())

    # a valid text without a mark needs no look at its bytes in Python
    marked = F.substring(F.hex(F.substring(col, 1, 2)), 1, 4).isin("FFFE", "FEFF")
    plain = F.is_valid_utf8(col.cast("string")) & ~marked & (F.octet_length(col) > 0)
    return F.when(plain, F.lit("UTF-8")).otherwise(run(F.when(~plain, col)))


def to_utf8(data: Column | str, encoding: Column | str | None = None) -> Column:
    """Text of a binary column: as it is where it is UTF-8, else converted from ``encoding`` or the detected one."""
    col = F.col(data) if isinstance(data, str) else data

    @F.arrow_udf("string")
    def run(column: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([None if x is None else convert(x, n or detect(x)) for x, n in zip(column.to_pylist(), names.to_pylist())], pa.string())

    name = F.lit(None).cast("string") if encoding is None else F.col(encoding) if isinstance(encoding, str) and encoding not in ENCODINGS else F.lit(encoding) if isinstance(encoding, str) else encoding
    odd = run(F.when(~F.is_valid_utf8(col.cast("string")) | F.coalesce(~name.isin("UTF-8", "Unknown"), F.lit(False)), col), name)
    return F.coalesce(odd, F.when(F.is_valid_utf8(col.cast("string")), col.cast("string")))


def properties(spark: SparkSession) -> DataFrame:
    """Rows (name, is_unicode, is_variable_width, max_char_bytes, common_in) of all encodings."""
    return spark.createDataFrame([(k, *v[1:]) for k, v in ENCODINGS.items()], "name string, is_unicode boolean, is_variable_width boolean, max_char_bytes int, common_in array<string>")


def is_valid_utf8(data: Column | str) -> Column:
    return F.is_valid_utf8((F.col(data) if isinstance(data, str) else data).cast("string"))
