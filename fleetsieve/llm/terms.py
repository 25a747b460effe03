"""Terms of texts as byte strings: A-Z lower-cased, runs of the bytes that belong to a term.

Every byte of a character beyond ASCII is 0x80 or more, so classes that hold all of those characters
can be matched byte by byte; a term is then a whole number of characters.
"""
import pyarrow as pa


def byte_table(digits: bool) -> bytes:
    """For bytes.translate: what belongs to a term lower-cased, everything else a space."""
    def kept(b):
        return b >= 0x80 or 0x61 <= (b | 0x20) <= 0x7A and b >= 0x41 or digits and 0x30 <= b <= 0x39
    return bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if kept(b) else 0x20 for b in range(256))


#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` and `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`
LETTERS, LETTERS_AND_DIGITS = byte_table(False), byte_table(True)


def terms_of(text: bytes | None, table: bytes) -> list[bytes]:
    return text.translate(table).split() if text else []


def texts_of(column: pa.Array):
    """The texts of an Arrow column as bytes, one at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    column = column.cast(kind) if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else column
    return (x.as_py() for x in column)
