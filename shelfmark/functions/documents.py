"""Scalar functions over library rows, bytes, pages and permissions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four bytes that open a PDF file.
PDF_MAGIC = "25504446"

# Permission bits of the standard security handler (bit n has value 2**(n-1)).
PERMISSION_BITS = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "assemble": 1024}


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def address_of(digest: Column) -> Column:
    """Storage path of a file under its hash."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".pdf"))


def has_pdf_magic(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == PDF_MAGIC


def identity_hash(value: Column) -> Column:
    """Short stable identifier that hides its input."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)


def tile_line(size_bytes: Column, page_count: Column, managed: Column) -> Column:
    """Size in KB, pages if known and a badge for imported copies, joined by a middle dot."""
    kb = F.round(size_bytes / F.lit(1024.0)).cast("bigint").cast("string")
    return F.concat_ws(
        " · ",
        F.concat(kb, F.lit(" KB")),
        F.when(page_count.isNotNull(), F.concat(page_count.cast("string"), F.lit(" pages"))),
        F.when(managed, F.lit("Imported copy")),
    )


def rebase_page(page_number: Column) -> Column:
    """1-based destination to 0-based index; null stays null."""
    return page_number - 1


def decode_permissions(flags: Column) -> Column:
    """Booleans of a permission integer; a null integer means no restriction object."""
    fields = [(flags.bitwiseAND(F.lit(bit)) != 0).alias(name) for name, bit in PERMISSION_BITS.items()]
    return F.when(flags.isNotNull(), F.struct(*fields))


def copy_allowed(permissions: Column) -> Column:
    """Only an explicit denial blocks copying."""
    return F.coalesce(permissions["copy"], F.lit(True))


def has_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""
