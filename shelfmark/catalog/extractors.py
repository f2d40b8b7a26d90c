"""A small extractor for the sample files."""

from shelfmark.sources.extract import ExtractionFailure


def lines_of(path: str, content: bytes):
    """Each line of a file that starts like a PDF is a page."""
    if not content.startswith(b"%PDF"):
        raise ExtractionFailure("document_corrupt", "missing %PDF header")
    for i, line in enumerate(content.decode("utf-8").split("\n")):
        yield i, line, None
