"""Records of CSV files with line breaks inside quotes, found in splits: no task reads more than its own.

Whether a split begins inside quotes depends on all splits before it. So a first
pass tells of each split how it would end if it began outside, and if it began
inside; going through the splits in order settles how each one begins. A second
pass cuts the records; one that crosses splits is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage

OUTSIDE, INSIDE = 0, 1
RECORD, OPEN, REST = 0, 1, 2
BATCH = 10_000


class Lines:
    """How a line leaves the quotes: a field is quoted if it begins with a quote, and quotes in it are doubled."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        quoted, after = '"(?:[^"]|"")*+"', f"[^{s}]*+"
        field = f'(?:{quoted}{after}|[^"{s}]{after}|)'
        self.opens = re.compile(f'(?:{field}{s})*+"(?:[^"]|"")*+', re.DOTALL)
        self.stays = re.compile('(?:[^"]|"")*+', re.DOTALL)
        self.closes = re.compile(f'(?:[^"]|"")*+"{after}', re.DOTALL)

    def after(self, line: str, state: int) -> int:
        if '"' not in line:
            return state
        if state == OUTSIDE:
            return INSIDE if self.opens.fullmatch(line) else OUTSIDE
        if self.stays.fullmatch(line):
            return INSIDE
        end = self.closes.match(line).end()
        return self.after(line[end + 1 :], OUTSIDE) if end < len(line) else OUTSIDE


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and the start of its split; lines of a split come in order."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _of_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool]]:
    """(file, start, lines, whether they are the split's first)."""
    last = None
    for batch in batches:
        starts, files = batch.column("start").to_pylist(), batch.column("file").to_pylist()
        lo = 0
        while lo < len(starts):
            key, hi = (files[lo], starts[lo]), lo
            while hi < len(starts) and starts[hi] == key[1] and files[hi] == key[0]:
                hi += 1
            yield *key, batch.column("value").slice(lo, hi - lo), key != last
            last, lo = key, hi


def _ends(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, out = Lines(sep), []
        for file, start, values, new in _of_splits(batches):
            if new:
                out.append([file, start, OUTSIDE, INSIDE, False])
            own = out[-1]
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                own[2], own[3] = rules.after(line, own[2]), rules.after(line, own[3])
                own[4] = own[4] or OUTSIDE in (own[3],)  # a split that begins inside ends the record here
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int8(), pa.int8(), pa.bool_()))], ["file", "start", "outside", "inside", "closes"])

    return run


def beginnings(splits: list[tuple[str, int, int, int, bool]]) -> tuple[dict[tuple[str, int], int], bool]:
    """Of the splits that begin inside quotes, the start of the split in which their record begins; and whether any split has a record that crosses lines."""
    inside, current, state, owner = {}, None, OUTSIDE, 0
    for file, start, outside_end, inside_end, closes in sorted(splits):
        if file != current:
            current, state = file, OUTSIDE
        if state == INSIDE:
            inside[file, start] = owner
        end = inside_end if state == INSIDE else outside_end
        if end == INSIDE and (state == OUTSIDE or closes):
            owner = start
        state = end
    return inside, bool(inside)


def _cut(sep: str, inside: dict[tuple[str, int], int]):
    """(file, owner, start, kind, text): whole records; the part of one that is open at the split's end; and the rest of one that began before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, out = Lines(sep), []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["file", "owner", "start", "kind", "text"])

        key, state, held, rest, header = None, OUTSIDE, [], False, False

        def ended() -> None:
            if held:
                out.append((key[0], inside[key] if rest else key[1], key[1], REST if rest else OPEN, "\n".join(held)))

        for file, start, values, new in _of_splits(batches):
            if new:
                ended()
                key, held = (file, start), []
                rest = key in inside
                state, header = INSIDE if rest else OUTSIDE, start == 0
            quoted = pc.match_substring(values, '"').to_pylist()
            for line, has in zip(values.to_pylist(), quoted):
                state = rules.after(line, state) if has else state
                if state == OUTSIDE and not held and not rest:
                    if not header and line.strip():
                        out.append((file, start, start, RECORD, line.removesuffix("\r")))
                    header = False
                    continue
                held.append(line)
                if state == OUTSIDE:
                    if rest:
                        out.append((file, inside[key], start, REST, "\n".join(held)))
                    elif not header:
                        out.append((file, start, start, RECORD, "\n".join(held).removesuffix("\r")))
                    held, rest, header = [], False, False
                if len(out) >= BATCH:
                    yield flush()
        ended()
        if out:
            yield flush()

    return run


def records(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame | None, bool]:
    """``text``: each record of the files but their first, without its last line break; None if all are single lines, or lines end in lone carriage returns. And whether quotes may go on over lines.

    The driver gets a row for each split. A record as long as several splits is
    put together in one task, as it is one row.
    """
    lines = lines_of(spark, path)
    odd = F.sum((F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"')))) % 2)
    n_odd, lone = lines.agg(F.coalesce(odd, F.lit(0)), F.coalesce(F.bool_or(F.contains("value", F.lit("\r")) & F.rtrim("value").rlike("\r[^\r]")), F.lit(False))).first()
    if not n_odd or lone:
        return None, bool(n_odd)
    splits = [tuple(r) for r in lines.mapInArrow(_ends(sep), "file string, start long, outside byte, inside byte, closes boolean").collect()]
    inside, _ = beginnings(splits)
    cut = lines.mapInArrow(_cut(sep, inside), "file string, owner long, start long, kind byte, text string")
    whole = cut.where(F.col("kind") == RECORD).select("text")
    if not inside:
        return whole.unionByName(cut.where(F.col("kind") == OPEN).select("text")), True  # a file may end inside quotes
    parts = stage(cut.where(F.col("kind") != RECORD), "record-parts")
    joined = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("parts"))
    crossing = joined.select(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), "\r$", "").alias("text"))
    return whole.unionByName(crossing), True
