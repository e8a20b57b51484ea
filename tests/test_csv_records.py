"""Records with line breaks inside quotes, in splits of any size, against one task a file."""

import csv
import io
import random

import pytest

from estimara.sources import csvio
from estimara.sources.records import INSIDE, OUTSIDE, Lines, beginnings


def plain_state(text, state, sep=","):
    """The rule, character by character: a quote opens a field only at its beginning."""
    inside, begun, i = state == INSIDE, state == INSIDE, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif c == '"' and not begun:
            inside = begun = True
        elif c == sep:
            begun = False
        else:
            begun = True
        i += 1
    return INSIDE if inside else OUTSIDE


def test_states_of_lines():
    draw, rules = random.Random(1), Lines(",")
    for _ in range(5000):
        line = "".join(draw.choices('",ab ', k=draw.randrange(12)))
        for state in (OUTSIDE, INSIDE):
            assert rules.after(line, state) == plain_state(line, state), (line, state)


def test_beginnings():
    splits = [("a", 0, INSIDE, OUTSIDE, True), ("a", 10, OUTSIDE, INSIDE, False), ("a", 20, OUTSIDE, INSIDE, True), ("a", 30, INSIDE, OUTSIDE, True), ("b", 0, OUTSIDE, INSIDE, False)]
    assert beginnings(splits[::-1])[0] == {("a", 10): 0, ("a", 20): 0, ("a", 30): 20}


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_cells_in_splits(spark, tmp_path, size, end):
    draw = random.Random(size)
    cells = ["1", "2.5", "", "NA", "plain text", 'a "quoted" word', "two\nlines", "three\n\nlines, with\ncommas", '5" pipe', "x" * 90 + "\n" + "y" * 90, "\n", '""']
    (tmp_path / "d.csv").mkdir()
    for f in range(3):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["id", "Some Text", "n"])
        for i in range(60):
            writer.writerow([f * 100 + i, draw.choice(cells), draw.randrange(9)])
        if f == 1:
            out.write(f'900,5" pipe,3{end}{end}901,"a"b,4,5{end}902,last,1')
        (tmp_path / "d.csv" / f"part{f}.csv").write_text(out.getvalue(), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        table, report = csvio.read_csv(spark, f"{tmp_path}/d.csv")
        got = sorted(tuple(r) for r in table.collect())
        parts = table.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    other, whole = csvio.read_csv(spark, f"{tmp_path}/d.csv", multi_line=True)
    assert got == sorted(tuple(r) for r in other.collect()) and len(got) == 183
    assert (report.rows, report.columns, report.issues) == (whole.rows, whole.columns, whole.issues) and table.schema == other.schema
    assert parts > 3 or size > 1000


def test_a_record_over_many_splits_and_an_open_end(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"' + "line of text\n" * 50 + '"\n2,"never closed\nuntil the end\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    try:
        rows = {r["a"]: r["b"] for r in csvio.read_csv(spark, f"{tmp_path}/x.csv")[0].collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows[1.0] == "line of text\n" * 50 and rows[2.0].startswith("never closed\nuntil the end")


def test_roles_count_values_exactly(spark, tmp_path):
    """Eleven values that a sketch takes for ten; values that come after the first rows; a text and an eleventh value in the last row only."""
    start = 11 * 45
    rows = [f"{start + i % 11},{i >= 2000},{3 if i < 2000 else i % 7},{4 if i < 2000 else i % 10},{'x' if i == 2999 else 5},{99 if i == 2999 else i % 10},{'' if i % 2 else 'NA'}" for i in range(3000)]
    (tmp_path / "r.csv").write_text("eleven,text,late,ten,last,over,none\n" + "\n".join(rows) + "\n")
    table, report = csvio.read_csv(spark, f"{tmp_path}/r.csv")
    roles = {f.name: (f.dataType.simpleString(), f.metadata["semantic"]) for f in table.schema.fields}
    number, text = ("double", "categorical"), ("string", "categorical")
    assert roles == {"eleven": ("double", "continuous"), "text": text, "late": number, "ten": number, "last": text, "over": ("double", "continuous"), "none": ("double", "continuous")}
    assert report.rows == 3000 and table.agg({"over": "max", "last": "max", "none": "count"}).first().asDict() == {"max(over)": 99.0, "max(last)": "x", "count(none)": 0}


def test_one_pass_tells_of_quotes_and_one_of_columns(spark, tmp_path, monkeypatch):
    """Lines are looked through once where no quotes go on over lines; the columns' sums are compiled, without sketches."""
    (tmp_path / "q.csv").write_text("a,b\n" + '1,"x, y"\n' * 50)
    read, seen = type(spark.read).text, []
    monkeypatch.setattr(type(spark.read), "text", lambda *a, **k: seen.append(a) or read(*a, **k))
    assert csvio.read_csv(spark, f"{tmp_path}/q.csv")[0].count() == 50
    assert len(seen) == 2  # the header line, and all lines
