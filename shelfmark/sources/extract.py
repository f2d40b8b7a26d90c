"""Running a caller's per-file text extractor over a corpus."""

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from shelfmark import schemas

ROWS_PER_BATCH = 2_000
CODES = frozenset(code for code, _, _ in schemas.FAILURE_MESSAGES)


class ExtractionFailure(Exception):
    """Raised by an extractor to report one of the known failure codes."""

    def __init__(self, code: str, detail: str | None = None):
        super().__init__(code)
        self.code = code if code in CODES else "unknown"
        self.detail = detail


# An extractor maps (path, content) to (page_index, text or None, rects or None) tuples,
# a rect being a (left, top, right, bottom) tuple.
Extractor = Callable[[str, bytes], Iterable[tuple]]


def extract_pages(files: DataFrame, extractor: Extractor, partitions: int | None = None) -> DataFrame:
    """Page rows of every file, or exactly one row with a failure code.

    A file that fails never fails the job, and none of its pages are kept. The file scan
    already packs files into partitions by bytes, so they are only moved when
    ``partitions`` asks for it.
    """
    columns = schemas.EXTRACTED.fieldNames()
    rect_fields = schemas.RECT.fieldNames()

    def rows_of(path, content):
        try:
            pages = [
                (path, int(index), text,
                 None if rects is None else [dict(zip(rect_fields, map(float, r))) for r in rects], None, None)
                for index, text, rects in extractor(path, content)
            ]
            if pages:
                return pages
            raise ExtractionFailure("document_corrupt", "no pages")
        except ExtractionFailure as failure:
            return [(path, None, None, None, failure.code, failure.detail)]
        except Exception as error:  # any other error of a bad file becomes a code
            return [(path, None, None, None, "unknown", type(error).__name__)]

    def frame(rows):
        out = pd.DataFrame(rows, columns=columns)
        out["page_index"] = out["page_index"].astype("Int32")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows.extend(rows_of(path, content))
                if len(rows) >= ROWS_PER_BATCH:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    picked = files.select("path", "content")
    if partitions:
        picked = picked.repartition(partitions, "path")
    return picked.mapInPandas(run, schemas.EXTRACTED)
