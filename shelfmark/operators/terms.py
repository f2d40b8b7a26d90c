"""Many terms against many texts in one pass: an index of the terms by their rarest characters."""

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.skew import BROADCAST_BYTES, BROADCAST_ROWS
from shelfmark.session import cut_lineage

PIECE = 3
IN_ROW_TERMS = 100
SLOT_BITS = 20
SLICE = 1 << 20


def pieces(text: Column, size: int = PIECE) -> Column:
    """All overlapping pieces of ``size`` characters, in one pass of the pattern engine that goes on by whole characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def rarest_pieces(words: DataFrame, word: str) -> DataFrame:
    """(word, piece): the piece of each distinct word that the fewest words share; a word shorter than a piece is its own."""
    own = words.select(word).where(F.length(word) > 0).distinct()
    cut = F.when(F.length(word) < PIECE, F.array(word)).otherwise(F.array_distinct(pieces(F.col(word))))
    cut = own.select(word, F.explode(cut).alias("piece"))
    shared = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return cut.join(shared, "piece").groupBy(word).agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))


def packs(values: DataFrame, columns: list[str], pack_rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """Split a list of terms into parts that may be broadcast; rows and bytes are measured.

    A list inside the bound is one part and costs one pass over the texts.
    """
    rows, size = values.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*values.columns)))), F.lit(0))
    ).first()
    n = max(-(-rows // pack_rows), -(-size // BROADCAST_BYTES), 1)
    if n == 1:
        return [values]
    return [values.where(F.pmod(F.xxhash64(*columns), F.lit(n)) == i) for i in range(n)]


def _codes(points: np.ndarray, size: int) -> np.ndarray:
    """The pieces that begin at each place, but the last ones, as numbers of ``size`` code points."""
    code = points[:len(points) - size + 1].astype(np.int64)
    for k in range(1, size):
        code = code << 21 | points[k:len(points) - size + 1 + k]
    return code


def _slots(points: np.ndarray, size: int) -> np.ndarray:
    """A small number for each piece, the same for equal pieces; it only tells which places are worth a look."""
    slot = points[:len(points) - size + 1] * np.uint32(0x9E3779B1)
    for k in range(1, size):
        slot = (slot ^ points[k:len(points) - size + 1 + k]) * np.uint32(0x85EBCA6B)
    return slot >> np.uint32(32 - SLOT_BITS)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _keys_held(texts: list[str], listed: dict[int, tuple]) -> Iterator[np.ndarray]:
    """Numbers ``row * keys + key`` for the keys that occur in each text, by size of the keys and run of places."""
    points = _points(texts)
    ends = np.cumsum([len(x) for x in texts])
    for size, (codes, numbers, marked, total) in listed.items():
        for start in range(0, len(points), SLICE):
            run = points[start:start + SLICE + size - 1]
            if len(run) < size:
                continue
            at = np.flatnonzero(marked[_slots(run, size)])
            code = reduce(lambda c, k: c << 21 | run[at + k], range(1, size), run[at].astype(np.int64))
            found = np.searchsorted(codes, code)
            row = np.searchsorted(ends, at + start, side="right")
            held = (codes[np.minimum(found, len(codes) - 1)] == code) & (at + start + size <= ends[row])
            yield np.unique(row[held] * total + numbers[found[held]])


def text_keys(text: Column, keys: Sequence[str]) -> Column:
    """The distinct ones of ``keys``, of up to three characters, that occur in a text.

    Texts are looked through as arrays of code points: a table of marks rules out most places at once, whatever the number
    of keys, and the rest are looked up in the sorted keys. Texts never become rows of pieces.
    """
    names = pa.array(list(keys), pa.string())
    listed = {}
    for size in sorted({len(k) for k in keys}):
        mine = [i for i, k in enumerate(keys) if len(k) == size]
        codes = np.concatenate([_codes(_points([keys[i]]), size) for i in mine])
        order = np.argsort(codes)
        marked = np.zeros(1 << SLOT_BITS, bool)
        marked[np.concatenate([_slots(_points([keys[i]]), size) for i in mine])] = True
        listed[size] = (codes[order], np.array(mine)[order], marked, len(keys))

    @F.arrow_udf(returnType="array<string>")
    def held(texts: pa.Array) -> pa.Array:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        found, start = [np.array([], np.int64)], 0
        while start < len(texts):
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
            part = [x or "" for x in texts.slice(start, stop - start).to_pylist()]
            found += [start * len(keys) + x for x in _keys_held(part, listed)]
            start = stop
        row, key = np.divmod(np.unique(np.concatenate(found)), max(1, len(keys)))
        offsets = np.searchsorted(row, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(key)))

    return held(text)


def listed_keys(terms: DataFrame, key: str) -> list[str]:
    """The distinct keys of a list that may be broadcast."""
    return sorted(r[0] for r in terms.select(key).distinct().collect())


def few(terms: DataFrame) -> bool:
    """Whether so few terms are listed that trying each in every text is cheaper than cutting the texts up."""
    return terms.limit(IN_ROW_TERMS + 1).count() <= IN_ROW_TERMS


def keyed_packs(terms: DataFrame, word: str) -> list[DataFrame]:
    """The rows of ``terms`` with the ``piece`` they are looked up by, in parts that may be broadcast."""
    listed = terms.where(F.length(word) > 0)
    return packs(cut_lineage(listed.join(rarest_pieces(listed, word), word)), ["piece", word])


def cut_texts(texts: DataFrame, text: str, pack: DataFrame) -> DataFrame:
    """Each row of ``texts`` once for each distinct ``piece`` of ``pack`` in its text, at least once.

    The outer form also keeps the optimiser from testing the array's size first, which would look through every text twice.
    """
    found = texts.withColumn("__pieces", text_keys(F.col(text), listed_keys(pack, "piece")))
    return found.select(*texts.columns, F.explode_outer("__pieces").alias("piece"))


def matches(texts: DataFrame, text: str, terms: DataFrame, word: str) -> DataFrame:
    """Every row of ``texts`` with every row of ``terms`` whose ``word`` occurs in the column ``text``.

    A text is looked through once for the pieces that terms are keyed by. These meet the broadcast terms they are the rarest
    piece of, and only such pairs are compared in full, in the row that holds the text: nothing but the terms is
    exchanged, and the texts are read once for any list that may be broadcast. Rows with a null text or an
    empty word match nothing.
    """
    out = None
    for pack in keyed_packs(terms, word):
        cut = cut_texts(texts.where(F.col(text).isNotNull()), text, pack)
        found = cut.join(F.broadcast(pack), "piece").where(F.contains(F.col(text), F.col(word))).drop("piece")
        out = found if out is None else out.unionByName(found)
    return out


def match_numbers(rows: DataFrame, text: str, terms: DataFrame, word: str) -> DataFrame:
    """``rows`` without the text, with ``n``, the number of rows of ``terms`` whose word occurs in it.

    The counts of a row are combined where its text lies, so only numbers are shuffled. Terms that need several
    passes read the texts from one checkpoint, in which the rows keep their numbers.
    """
    parts = keyed_packs(terms, word)
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    if len(parts) > 1:
        numbered = cut_lineage(numbered)
    kept = ["__row", *[c for c in rows.columns if c != text]]
    total = None
    for pack in parts:
        met = cut_texts(numbered, text, pack).join(F.broadcast(pack), "piece", "left")
        n = met.groupBy(*kept).agg(F.count_if(F.contains(F.col(text), F.col(word))).alias("n"))
        total = n if total is None else total.unionByName(n)
    return total.groupBy(*kept).agg(F.sum("n").alias("n")).drop("__row") if len(parts) > 1 else total.drop("__row")
