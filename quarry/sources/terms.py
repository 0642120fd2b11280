"""Term tables: texts analysed once, when an index is refreshed, and answered from afterwards.

For every text field the postings (term, row, positions, length), sorted by term,
and the dictionary (term, documents, occurrences).  A query reads the postings of
its own terms only, one row per document that has one of them; document
frequencies and lengths are looked up.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import drop, saved

ROW = "__row"
_POSTINGS = "__row bigint, field string, term string, length int, first boolean, positions array<int>"


@dataclass
class Terms:
    """The tables of an index, and by field its documents with terms and all their terms' number."""

    postings: DataFrame
    dictionary: DataFrame
    totals: dict[str, tuple[int, int]]

    def frequencies(self, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Documents that have each (field, term): a row for each that is asked for."""
        if not wanted:
            return {}
        by_field = [(F.col("field") == f) & F.col("term").isin([t for g, t in wanted if g == f]) for f in {f for f, _ in wanted}]
        rows = self.dictionary.where(functools.reduce(operator.or_, by_field)).select("field", "term", "documents").collect()
        return {(r[0], r[1]): r[2] for r in rows}

    def starting(self, field: str, prefix: str, most: int) -> list[str]:
        """The first `most` terms with a prefix."""
        found = self.dictionary.where((F.col("field") == field) & F.col("term").startswith(prefix))
        return [r[0] for r in found.select("term").orderBy("term").limit(most).collect()]

    def columns(self, wanted: dict[tuple[str, str | tuple[str, ...]], str], lengths: dict[str, str]) -> DataFrame:
        """A row for each document that has one of the terms: positions by (field, term) and lengths by field, in the named columns.

        The empty term stands for the first one of each document, whichever it is.
        Several terms have one column, a list of (term, positions).
        """
        found = self.postings.where(_any(list(wanted)))

        def made_of(f: str, t: str | tuple[str, ...]) -> Column:
            if isinstance(t, tuple):
                return F.collect_list(F.when((F.col("field") == f) & F.col("term").isin(list(t)), F.struct("term", "positions")))
            return F.max(F.when((F.col("field") == f) & (F.col("term") == t if t else F.col("first")), F.col("positions")))

        made = [made_of(f, t).alias(name) for (f, t), name in wanted.items()]
        made += [F.max(F.when(F.col("field") == f, F.col("length"))).alias(name) for f, name in lengths.items()]
        return found.groupBy(ROW).agg(*made)


def _any(wanted: list[tuple[str, str | tuple[str, ...]]]) -> Column:
    """Rows of these fields and terms, so that both reach the scan."""
    by: dict[str, list[str]] = {}
    for f, t in wanted:
        by.setdefault(f, []).extend(t if isinstance(t, tuple) else [t])
    out = F.lit(False)
    for f, terms in by.items():
        out = out | ((F.col("field") == f) & F.col("term").isin(terms))
        if "" in terms:
            out = out | ((F.col("field") == f) & F.col("first"))
    return out


#: Terms that are put in order at once, in whole rows: what bounds a worker's memory, however many rows a batch has.
AT_ONCE = 2**18


def _postings(field: str):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            counts = _lengths(b.column("tokens"))
            piece = (np.cumsum(counts) - counts) // AT_ONCE
            starts = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(counts))
            for first, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield _ordered(field, b.slice(first, end - first))

    return run


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ordered(field: str, b: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of a few rows."""
    lists = b.column("tokens")
    counts = _lengths(lists)
    terms = lists.flatten().dictionary_encode()
    codes = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    real = codes >= 0
    row, place, codes = row[real], place[real], codes[real]
    key = row * np.int64(len(terms.dictionary) + 1) + codes
    order = np.argsort(key, kind="stable")  # places rise within a row as it is
    key, row, place, codes = key[order], row[order], place[order], codes[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    own, length = row[at], np.bincount(row, minlength=len(counts))
    head = np.diff(own, prepend=-1) != 0
    cut = pa.array(np.append(at, len(row)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [b.column(ROW).take(pa.array(own)), pa.repeat(field, len(at)), terms.dictionary.take(pa.array(codes[at])), pa.array(length[own], pa.int32()), pa.array(head), pa.ListArray.from_arrays(cut, pa.array(place, pa.int32()))],
        names=["__row", "field", "term", "length", "first", "positions"],
    )


def build(df: DataFrame, tokens: dict[str, Column], path: str) -> Terms | None:
    """The term tables of a table whose rows are numbered in `__row`; `tokens` has each field's terms by position.

    Rows without terms have no postings; a removed stop word leaves a gap.
    """
    if not tokens:
        return None
    every = None
    for field, expr in tokens.items():
        part = df.select(ROW, expr.alias("tokens")).mapInArrow(_postings(field), _POSTINGS)
        every = part if every is None else every.unionAll(part)
    raw = saved(every, f"{path}/raw")  # so that finding the ranges doesn't analyse the texts again
    postings = saved(raw.repartitionByRange("field", "term", ROW).sortWithinPartitions("field", "term", ROW), f"{path}/postings")
    counted = postings.groupBy("field", "term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"), F.count_if("first").alias("heads"))
    drop(df.sparkSession, f"{path}/raw")
    dictionary = saved(counted.repartitionByRange("field", "term").sortWithinPartitions("field", "term"), f"{path}/dictionary")
    return opened(postings, dictionary)


def reopened(spark: SparkSession, path: str) -> Terms:
    """The tables that `build` has written below `path`."""
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    dictionary = spark.read.schema("field string, term string, documents bigint, occurrences bigint, heads bigint").parquet(f"{path}/dictionary")
    return opened(postings, dictionary)


def opened(postings: DataFrame, dictionary: DataFrame) -> Terms:
    sums = dictionary.groupBy("field").agg(F.sum("heads"), F.sum("occurrences")).collect()  # a row per text field
    return Terms(postings, dictionary, {r[0]: (r[1], r[2]) for r in sums})
