"""Text from bytes of an unknown encoding.

Open-data dumps and code lists come in UTF-8 with or without a byte-order mark, in UTF-16 or in a
Western one-byte code.  Here the encoding is found from the bytes of each value, in the JVM; what is no text in
its encoding is null and marked, so that it can be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Byte-order marks, and the characters that Windows-1252 has at 80 to 9F (hex), where
# Latin-1 has control characters; at 81, 8D, 8F, 90 and 9D it has none.
MARK_8, MARK_LE, MARK_BE = bytes([0xEF, 0xBB, 0xBF]), bytes([0xFF, 0xFE]), bytes([0xFE, 0xFF])
WESTERN = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ",
           0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
           0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
UNUSED = "\x81\x8d\x8f\x90\x9d"


def _starts(c: Column, mark: bytes) -> Column:
    return F.substring(c, 1, len(mark)) == F.lit(mark)


def _after(c: Column, mark: bytes) -> Column:
    return F.substring(c, len(mark) + 1, 2 ** 31 - 1 - len(mark))


def _units(c: Column) -> Column:
    """The pairs of bytes, each as four hexadecimal digits."""
    digits = F.hex(c)
    n = F.length(digits)
    return F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 3, F.lit(4)), lambda i: F.substr(digits, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))


def _whole_16(c: Column, little: bool) -> Column:
    """Whether bytes are UTF-16: pairs of bytes, and high and low surrogates only side by side."""
    units = _units(c)
    lead = F.transform(units, lambda u: F.substr(u, F.lit(3 if little else 1), F.lit(2)))
    # H, L or another: one character for each unit, so that pairs can be taken out at once
    kinds = F.array_join(F.transform(lead, lambda x: F.when(x.between("D8", "DB"), "H").when(x.between("DC", "DF"), "L").otherwise("")), "")
    placed = F.array_join(F.transform(lead, lambda x: F.when(x.between("D8", "DB"), "H").when(x.between("DC", "DF"), "L").otherwise(".")), "")
    return (F.octet_length(c) % 2 == 0) & (F.length(F.replace(placed, F.lit("HL"), F.lit(""))) == F.length(placed) - F.length(kinds))


def decoded(c: Column) -> Column:
    """A struct of text, encoding (``utf-8``, ``utf-8 mark``, ``utf-16le``, ``utf-16be``, ``windows-1252``) and malformed.

    A mark decides, and isn't part of the text.  Without one, bytes with zeros are UTF-16 if there are as many as
    pairs in most of one half; valid UTF-8 is that; all else is Windows-1252.  A null has neither text nor encoding; no
    bytes are an empty text."""
    zeros = F.filter(_units(c), lambda u: F.substr(u, F.lit(3), F.lit(2)) == "00")
    zeros_first = F.filter(_units(c), lambda u: F.substr(u, F.lit(1), F.lit(2)) == "00")
    pairs = F.octet_length(c) / 2
    has_zero = F.contains(c, F.lit(b"\x00"))
    valid_8 = F.is_valid_utf8(c.cast("string"))

    def utf8(body: Column, name: str) -> Column:
        fine = F.is_valid_utf8(body.cast("string"))
        return F.struct(F.when(fine, body.cast("string")).alias("text"), F.lit(name).alias("encoding"), (~fine).alias("malformed"))

    def utf16(body: Column, little: bool) -> Column:
        fine = _whole_16(body, little)
        text = F.when(fine, F.decode(F.when(fine, body), "UTF-16LE" if little else "UTF-16BE"))
        return F.struct(text.alias("text"), F.lit("utf-16le" if little else "utf-16be").alias("encoding"), (~fine).alias("malformed"))

    latin = F.decode(c, "ISO-8859-1")
    fine = ~latin.rlike(f"[{UNUSED}]")
    western = F.struct(F.when(fine, F.translate(latin, "".join(map(chr, WESTERN)), "".join(WESTERN.values()))).alias("text"),
                       F.lit("windows-1252").alias("encoding"), (~fine).alias("malformed"))
    return (F.when(c.isNull(), F.lit(None)).when(_starts(c, MARK_8), utf8(_after(c, MARK_8), "utf-8 mark"))
            .when(_starts(c, MARK_LE), utf16(_after(c, MARK_LE), True)).when(_starts(c, MARK_BE), utf16(_after(c, MARK_BE), False))
            .when(has_zero & (F.size(zeros) > pairs / 2), utf16(c, True)).when(has_zero & (F.size(zeros_first) > pairs / 2), utf16(c, False))
            .when(valid_8, utf8(c, "utf-8")).otherwise(western))


def decode_column(df: DataFrame, column: str, text: str = "text") -> DataFrame:
    """``df`` with ``text``, ``encoding`` and ``malformed`` in place of a binary column."""
    others = [c for c in df.columns if c != column]
    got = df.withColumn("_decoded", decoded(F.col(column)))
    return got.select(*others, F.col("_decoded.text").alias(text), F.col("_decoded.encoding").alias("encoding"), F.col("_decoded.malformed").alias("malformed"))


def encoding_report(df: DataFrame) -> DataFrame:
    """(encoding, malformed, values) of a decoded frame."""
    return df.groupBy("encoding", "malformed").agg(F.count(F.lit(1)).alias("values"))


def read_decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder as rows: file, text, encoding, malformed.  A file is one value, so this is for the code
    lists and yearly dumps of the feed, not for microdata."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return decode_column(files, "content")
