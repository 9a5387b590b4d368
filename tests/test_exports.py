import os
import random
import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from snapfold import bindings, schema
from snapfold.config import Config
from snapfold.functions.scalars import HALF_DAY_FORMATS, ISO_FORMATS, parse_dates
from snapfold.queries import source_queries
from snapfold.sources import exports
from snapfold.sources.records import physical_lines, read_records

ENGLISH = ["Opportunity Owner", "Created Date", "Close Date", "Stage", "Opportunity Number", "Indirect Account",
           "End Customer", "Estimated Total Price", "Sales Model Name", "Part Number", "Estimated Quantity",
           "Sales Price", "Account Name", "Product Line", "Deal Type", "Win Rate"]
FRENCH = [*schema.HEADER_LABELS["French"], *ENGLISH[4:]]


def record(owner="A", opty="O1", total="1000", created="1/15/2025", stage="Open"):
    return [owner, created, "2025-09-01", stage, opty, "R", "C", total, "M", "P", "2", "500", "acc", "NB", "Project", "50%"]


def line(cells):
    return ",".join(f'"{c}"' for c in cells)


def write(folder, name, *, notices=12, header=ENGLISH, records=None, mtime=None):
    lines = [f"Warning {i}: first 15" for i in range(notices)] + ([line(header)] if header else [])
    lines += [line(r) for r in (records if records is not None else [record()])]
    path = folder / name
    path.write_text("\n".join([*lines, line(["Total", *[""] * 15])]) + "\n", encoding="utf-8")
    if mtime:
        os.utime(path, (mtime, mtime))
    return str(path)


@pytest.mark.parametrize("notices, header", [(12, ENGLISH), (15, ENGLISH), (0, FRENCH), (29, FRENCH)])
def test_header_is_found(spark, tmp_path, notices, header):
    write(tmp_path, "a.csv", notices=notices, header=header)
    got = exports.load_export(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["owner"] for r in got] == ["A", "Total"]
    first = got[0].asDict()
    assert first["created"] == datetime(2025, 1, 15) and first["closed"] == datetime(2025, 9, 1)
    assert (first["qty"], first["sales_price"], first["total_price"]) == (2.0, 500.0, 1000.0)
    assert (first["model"], first["part_number"], first["account"], first["product_line"]) == ("M", "P", "acc", "NB")
    assert (first["deal_type"], first["win_rate"], got[1]["opty"]) == ("Project", "50%", None)


def test_named_columns_may_move(spark, tmp_path):
    order = [*range(13), 15, 13, 14]
    write(tmp_path, "a.csv", header=[ENGLISH[i] for i in order], records=[[record()[i] for i in order]])
    first = exports.load_export(spark, str(tmp_path)).filter("owner = 'A'").first()
    assert (first["product_line"], first["deal_type"], first["win_rate"]) == ("NB", "Project", "50%")


def test_columns_without_header_are_dropped(spark, tmp_path):
    header = [*ENGLISH[:3], "", *ENGLISH[3:]]
    write(tmp_path, "a.csv", header=header, records=[[*record()[:3], "junk", *record()[3:]]])
    first = exports.load_export(spark, str(tmp_path)).filter("owner = 'A'").first()
    assert (first["stage"], first["win_rate"]) == ("Open", "50%")


def test_without_header_a_fixed_number_of_lines_is_skipped(spark, tmp_path):
    write(tmp_path, "a.csv", notices=12, header=None, records=[record(owner="skipped"), record()])
    assert [r["owner"] for r in exports.load_export(spark, str(tmp_path)).orderBy("seq").collect()] == ["A", "Total"]
    got = exports.load_export(spark, str(tmp_path), Config(header_fallback=11)).orderBy("seq").collect()
    assert [r["owner"] for r in got] == ["skipped", "A", "Total"]


def test_a_header_beyond_the_scan_depth_does_not_count(spark):
    def lines(n):
        return spark.createDataFrame([("f", i, ["x"]) for i in range(1, n)] + [("f", n, ENGLISH)],
                                     "file string, line_no long, cells array<string>")

    assert rows(exports.detect_header(lines(13))) == [("f", 12, "English")]
    assert rows(exports.detect_header(lines(30))) == [("f", 29, "English")]
    assert rows(exports.detect_header(lines(31))) == [("f", 12, None)]
    assert rows(exports.detect_header(lines(31), Config(header_fallback=7))) == [("f", 7, None)]


def test_order_survives_splitting(spark, tmp_path):
    records = [record(opty=f"O{i:05d}") for i in range(3000)]
    write(tmp_path, "a.csv", records=records)
    write(tmp_path, "b.csv", records=records[:5], header=FRENCH)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        df = exports.load_export(spark, str(tmp_path)).filter("owner = 'A'")
        got = [r["opty"] for r in df.filter("seq.file like '%a.csv'").orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [r[4] for r in records]


def test_a_header_far_down_is_found_however_the_file_is_split(spark, tmp_path):
    write(tmp_path, "a.csv", notices=20)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = [r["owner"] for r in exports.load_export(spark, str(tmp_path)).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == ["A", "Total"]


def test_any_number_of_columns(spark, tmp_path):
    more = [f"Extra {i}" for i in range(60)]
    header = [*ENGLISH[:13], *more, *ENGLISH[13:]]
    cells = [*record()[:13], *["x"] * 60, *record()[13:]]
    write(tmp_path, "a.csv", header=header, records=[cells, [*cells, "beyond", "beyond"]])
    got = exports.load_export(spark, str(tmp_path)).filter("owner = 'A'").collect()
    assert [(r["product_line"], r["deal_type"], r["win_rate"]) for r in got] == [("NB", "Project", "50%")]
    below = exports.rows_below_header(read_records(spark, str(tmp_path)))
    assert sorted(r["n_beyond"] for r in below.collect()) == [0, 0, 2]


def test_line_breaks_and_quotes_inside_cells(spark, tmp_path):
    odd = record(owner='multi\nline ""owner"", x')
    write(tmp_path, "a.csv", records=[odd, record(opty="O2"), record(owner="", opty="after")])
    got = exports.load_export(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["owner"], r["opty"]) for r in got] == [
        ('multi\nline "owner", x', "O1"), ("A", "O2"), (None, "after"), ("Total", None)]
    (tmp_path / "b.csv").write_text('\ufeffa,"open\r\n\r\nb,qx,\r\n', encoding="utf-8")
    lines = exports.read_lines(spark, str(tmp_path / "b.csv")).orderBy("line_no").collect()
    assert [(r["line_no"], r["cells"]) for r in lines] == [(1, ["a", "open"]), (2, [""]), (3, ["b", "qx", ""])]


def test_files_are_checked(spark, tmp_path):
    write(tmp_path, "a.csv", notices=3)
    write(tmp_path, "b.dat", header=None)
    got = {r["file"].rsplit("/", 1)[1]: r for r in exports.check_files(spark, str(tmp_path)).collect()}
    assert [(got[f]["is_text"], got[f]["has_header"], got[f]["n_lines"]) for f in ("a.csv", "b.dat")] == [
        (True, True, 6), (False, False, 14)]


def test_files_by_time(spark, tmp_path):
    write(tmp_path, "new.csv", mtime=1_700_000_000)
    write(tmp_path, "old.csv", mtime=1_600_000_000)
    write(tmp_path, "other.txt", mtime=1_800_000_000)
    names = [r["file"].rsplit("/", 1)[1] for r in exports.list_snapshots(spark, str(tmp_path), "*.csv").collect()]
    assert names == ["old.csv", "new.csv"]
    assert exports.latest_snapshot(spark, str(tmp_path), "*.csv").endswith("new.csv")
    with pytest.raises(Exception):
        exports.latest_snapshot(spark, str(tmp_path), "*.parquet")


def plain_records(text):
    """Records of a whole text by one expression: a quoted cell runs to its closing quote, if there is one."""
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    cell = rf"(?:{quoted}[^,\n]*+|[^,\n]*+)"
    plain = re.sub(r"\r\n?", "\n", text.removeprefix("\ufeff"))
    found = [m[0] for m in re.finditer(rf"(?:\A|(?<=\n)){cell}(?:,{cell})*+", plain)]
    return found[:-1] if plain.endswith("\n") else found


@pytest.mark.parametrize("size", [1, 7, 200, 1 << 27])
def test_records_of_any_split_size(spark, tmp_path, size):
    rng = random.Random(11)
    bits = ['"', '"', '""', ",", ",", "\n", "\n", "\r\n", "\r", "a", "bc", "é", ',"', '",', "\u2028"]
    expected = {}
    for k in range(10 if size == 1 else 60):
        text = "".join(rng.choices(bits, k=rng.randint(1, 12 if size == 1 else 60))) + rng.choice(["", "\n", "\r\n", '"\nx\n'])
        name = f"{k}.csv"
        (tmp_path / name).write_bytes(text.encode())
        expected |= {(name, n): r for n, r in enumerate(plain_records(text), 1)}
    (tmp_path / "empty.csv").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r["file"].rsplit("/", 1)[1], r["line_no"]): r["record"] for r in got} == expected
    assert len(got) == len(expected)


def test_wide_and_long_records_take_no_stack(spark, tmp_path):
    wide = ",".join(['"x ""y"" z"', "plain", '"a\nb"'] * 20_000)
    (tmp_path / "a.csv").write_text(wide + "\n" + '"' + "line\n" * 30_000 + '"\nlast', encoding="utf-8")
    got = {r["line_no"]: r["record"] for r in read_records(spark, str(tmp_path)).collect()}
    assert got == {1: wide, 2: '"' + "line\n" * 30_000 + '"', 3: "last"}


def test_bad_records_are_set_aside_with_reasons(spark, tmp_path):
    records = [record(), record(opty="O2")[:9], [*record(opty="O3"), "more"], record(opty="O4", created="soon"), [*record(opty="O5"), " "],
               record(opty="O6", total="none")]
    path = write(tmp_path, "a file.csv", records=records)
    got = exports.read_export(spark, path)
    assert sorted(r["opty"] or "" for r in got.rows.collect()) == ["", "O1", "O4", "O5", "O6"]
    rejects = [(r["line_no"], r["status"], r["reasons"], r["record"][:7]) for r in got.rejects.orderBy("line_no").collect()]
    assert rejects == [
        (15, "rejected", ["too few cells"], '"A","1/'), (16, "rejected", ["too many cells"], '"A","1/'),
        (17, "accepted", ["unreadable created"], '"A","so'), (19, "accepted", ["unreadable total_price"], '"A","1/')]
    counts = got.checks.first().asDict()
    assert (counts["n_lines"], counts["n_above"], counts["n_blank"]) == (20, 13, 0)
    assert (counts["n_accepted"], counts["n_rejected"], counts["n_footer"], counts["n_reported"]) == (4, 2, 1, 4)
    strict = exports.read_export(spark, path, Config(reject_unreadable=True))
    assert sorted(r["opty"] or "" for r in strict.rows.collect()) == ["", "O1", "O5"]


def test_the_gate_names_unreadable_files(spark, tmp_path):
    write(tmp_path, "good.csv", records=[record()] * 3 + [record()[:5]])
    exports.require_readable(exports.check_files(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="good.csv .1 records rejected"):
        exports.require_readable(exports.check_files(spark, str(tmp_path)), Config(max_rejected_share=0.1))
    write(tmp_path, "sheet.xlsx")
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="sheet.xlsx .not a text file"):
        exports.require_readable(exports.check_files(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="no export with any content"):
        exports.require_readable(exports.check_files(spark, str(tmp_path / "empty.csv")))


def test_wide_text_is_made_after_rows_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(1, "S1", 0, 0.0)], bindings._LAYOUTS["supplier"]).write.parquet(str(tmp_path / "supplier.parquet"))
    item = (1, 1, 1, 1, 2.0, 3.0, 0.0, 0.0, "R", "F", datetime(2001, 1, 1))
    spark.createDataFrame([item], bindings._LAYOUTS["lineitem"]).write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = bindings.text_lines(spark, str(tmp_path))
    above, below = lines._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(file", 1)
    assert "Extra 54" in above and "Extra" not in below
    wide = ",".join(f'"Extra {k}"' for k in range(55))
    *_, last, footer = [r.value for r in lines.collect()]
    assert last == f'"S1","1","2.0","R",{wide},"a ""note"",\n109"' and footer == '" Total ",""'


@pytest.mark.parametrize("record, cells", [
    ('"a","b ""c""",d', ["a", 'b "c"', "d"]), ('"",""""', ["", '"']), ('"', [""]), ('"a"x,"', ['a"x', ""]),
    ('"a"\u2028,"a\u2028"', ["a\u2028", "a\u2028"]),
])
def test_quotes_around_cells(spark, record, cells):
    assert spark.createDataFrame([(record,)], "r string").select(exports.split_cells(F.col("r"))).first()[0] == cells


def _order_tables(spark, folder, items):
    """Tables of one line item per entry of ``items``, each the number of its supplier."""
    suppliers = [(n, f"S{n}", 0, 0.0) for n in sorted(set(items))]
    spark.createDataFrame(suppliers, bindings._LAYOUTS["supplier"]).write.parquet(f"{folder}/supplier.parquet")
    # order, part, supplier, line, quantity, price, discount, tax, flag, status, shipped
    lines = [(k, 1, n, 1, 2.0, 3.0, 0.0, 0.0, "R", "F", datetime(2001, 1, 1)) for k, n in enumerate(items)]
    spark.createDataFrame(lines, bindings._LAYOUTS["lineitem"]).write.parquet(f"{folder}/lineitem.parquet")


def test_text_exports_are_packed(spark, tmp_path):
    _order_tables(spark, tmp_path, [1] * 500 + [2] * 3)
    plain = bindings.text_exports(spark, str(tmp_path), str(tmp_path / "plain"), "none")
    packed = bindings.text_exports(spark, str(tmp_path), str(tmp_path / "packed"))
    size = lambda folder: sum(p.stat().st_size for p in Path(folder).rglob("part-*"))
    assert size(packed) < size(plain) / 5
    text = lambda folder: rows(read_records(spark, folder).select(F.regexp_extract("file", "file=([^/]+)", 1), "line_no", "record"))
    assert text(packed) == text(plain) and len(text(packed)) == 510


def test_splits_share_tasks(spark, tmp_path, monkeypatch):
    _order_tables(spark, tmp_path, [1] * 200 + list(range(2, 42)))
    whole = rows(source_queries.load_text_exports(spark, str(tmp_path)))
    assert rows(source_queries.load_split_exports(spark, str(tmp_path))) == whole and len(whole) == 240

    def read(spark, folder):
        lines = physical_lines(spark, folder)
        return lines.rdd.getNumPartitions(), lines.select("file", "split").distinct().count()

    monkeypatch.setattr(source_queries, "_text_rows", read)
    tasks, splits = source_queries.load_split_exports(spark, str(tmp_path))
    assert splits > 41 and tasks <= spark.sparkContext.defaultParallelism + 2


def test_a_date_is_read_once_and_only_by_layouts_that_may_fit(spark, tmp_path):
    write(tmp_path, "a.csv")
    told = exports.classified(exports.rows_below_header(read_records(spark, str(tmp_path))))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    layouts = {*ISO_FORMATS, *Config().date_formats, *HALF_DAY_FORMATS}
    assert plan.count("gettimestamp") <= 2 * len(layouts)
    assert plan.count("Contains") + plan.count("contains") > 0
    parsed = [("2001-02-03", 3), ("2001-02-03T04:05", 3), ("2/3/2001 4:05:06", 3), ("3 Feb 2001", 3), ("Feb 3, 2001", 3),
              ("2/3/2001 4:05 PM", 3), ("2-3-2001", None), ("2/3", None), ("soon, or 3 Feb", None)]
    got = spark.createDataFrame(parsed, "t string, d int").select(F.day(parse_dates("t", Config().date_formats)), "d")
    assert all(a == b for a, b in got.collect())
