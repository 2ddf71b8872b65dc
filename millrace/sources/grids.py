"""Raw grids from files (S1-S5): ``source, sheet, row_idx, cells``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.lookup import lookup
from millrace.operators.prefix import Running, number, running
from millrace.session import stage, stage_facts
from millrace.sources.positions import read_lines, with_positions

# Cell texts read as missing, and the sheet name of each format.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
WORKBOOKS = (".xlsx", ".xls")
CSV_SHEET, JSON_SHEET, OTHER_SHEET = "CSV Data", "JSON Data", "Data"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def sheet_of(path: Column) -> Column:
    """Grid name by file extension; unknown extensions read as CSV."""
    ext = extension(path)
    return F.when(ext == ".csv", F.lit(CSV_SHEET)).when(ext == ".json", F.lit(JSON_SHEET)).otherwise(F.lit(OTHER_SHEET))


# The shapes of delimited text. A quote opens a field only at its start; inside, a doubled
# quote stands for one. What follows the closing quote belongs to the field as it is.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD_START = "(?<![^,])"
_CLOSING = r'^[^"]*+(?:""[^"]*+)*+"'
_FIELD = f"({_QUOTED}[^,]*+|[^,]*+),"


def _without_quoted(line: Column) -> Column:
    """The line with every closed quoted field replaced by a letter."""
    return F.regexp_replace(line, _FIELD_START + _QUOTED, "q")


def _stays_open(line: Column) -> Column:
    return _without_quoted(line).rlike(_FIELD_START + '"')


def _ends_inside(line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside quotes, if it begins outside, and if it begins inside."""
    rest = F.regexp_replace(line, _CLOSING, "q")
    return _stays_open(line), (rest == line) | _stays_open(rest)


def field_count(record: Column) -> Column:
    """Comma-separated fields of a whole record, commas inside quoted fields aside."""
    return F.size(F.split(_without_quoted(record), ","))


def fields(record: Column) -> Column:
    """The record's fields as an array, quotes resolved."""
    def value(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, '^"([^"]*+(?:""[^"]*+)*+)"', 1), F.lit('""'), F.lit('"'))
        return F.when(c.startswith('"') & c.rlike("^" + _QUOTED), F.concat(inner, F.regexp_replace(c, "^" + _QUOTED, ""))).otherwise(c)

    return F.transform(F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_FIELD), F.lit(1)), value)


def csv_records(lines: DataFrame) -> DataFrame:
    """``source, row_no, record``: lines joined where a quoted field goes on over a line break.

    Each line maps the state before it (outside or inside quotes) to the state behind it. The state
    before a line follows from the last line that leaves no choice and the number of
    switching lines since, so two running aggregates settle whole files. Lines that belong
    to no quoted break are taken as they are; only the others are grouped.
    """
    if_out, if_in = _ends_inside(F.col("line"))
    quoted = F.col("line").contains('"')
    marked = lines.withColumn("out", quoted & if_out).withColumn("in", ~quoted | if_in)
    opening = marked.where("out").groupBy("source").agg(F.min("row_no").alias("opens"), F.count(F.lit(1)).alias("n"))
    opening = stage_facts(opening, "opening")
    if not opening.rows:
        return lines.select("source", "row_no", F.col("line").alias("record"))
    switch = (F.col("out") & ~F.col("in")).cast("long")
    states = running(marked, ["source"], "row_no", [Running("switches", "sum", switch)])
    settled = F.when(F.col("out") == F.col("in"), F.col("row_no") * 4 + F.col("out").cast("long") * 2 + F.col("switches") % 2)
    states = running(states.withColumn("settled", settled), ["source"], "row_no", [Running("last", "max", F.col("settled"), strict=True)])
    before = F.col("switches") - switch
    since = (before - F.coalesce(F.col("last"), F.lit(0)) % 2) % 2
    inside = (F.shiftright(F.coalesce(F.col("last"), F.lit(0)), 1) % 2 + since) % 2 == 1
    behind = F.when(inside, F.col("in")).otherwise(F.col("out"))
    states = stage(states.select("source", "row_no", "line", inside.alias("inside"), behind.alias("behind")), "quotes")
    # A file whose last line ends inside quotes is refused before any lines are gathered.
    open_at = F.when(~F.col("inside"), F.col("row_no"))
    ends = states.groupBy("source").agg(F.max_by("behind", "row_no").alias("unclosed"), F.max(F.when(F.col("behind"), open_at)).alias("opens"))
    lost = ends.where("unclosed").orderBy("source").first()
    if lost:
        raise ValueError(f"a quoted field that begins in line {lost['opens'] + 1} of {lost['source']} is never closed")
    plain = states.where("NOT inside AND NOT behind").select("source", "row_no", F.col("line").alias("record"))
    broken = states.where("inside OR behind")
    broken = running(broken, ["source"], "row_no", [Running("first", "max", open_at)])
    joined = broken.groupBy("source", "first").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("parts"))
    return plain.unionByName(joined.select("source", F.col("first").alias("row_no"), F.array_join("parts.line", "\n").alias("record")))


def csv_grid(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str = "*") -> DataFrame:
    """Headerless CSV. A file's first record sets its width.

    Blank lines and records wider than that are dropped, shorter ones padded. A quoted field may
    hold commas, quotes and line breaks; one that is never closed is an error.
    """
    lines = stage(read_lines(spark, path, encoding, glob), "lines")
    records = csv_records(lines).where(strip(F.col("record")) != "").withColumn("fields", field_count(F.col("record")))
    records = stage(records, "records")
    widths = stage_facts(
        records.groupBy("source").agg(F.min_by("fields", "row_no").alias("width"), F.count(F.lit(1)).alias("n")), "widths"
    )
    kept = lookup(records, widths, [(F.col("source"), "source")], ["width"], "n", F.col("row_no"))
    kept = kept.where(F.col("fields") <= F.col("width"))
    found = F.transform(fields(F.col("record")), _present)
    padded = F.concat(found, F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.col("fields")))
    numbered = number(kept.select("source", "row_no", padded.alias("cells")), ["source"], "row_no", "rn")
    return numbered.select("source", sheet_of(F.col("source")).alias("sheet"), (F.col("rn") - 1).alias("row_idx"), "cells")


def _present(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_TEXTS), c)


def json_records(spark: SparkSession, path: str, lines: bool = False, glob: str = "*") -> DataFrame:
    """Records as text columns with ``source`` and ``row_idx``; field names are the headers."""
    # Values stay the text that the file spells; no types are inferred.
    reader = spark.read.option("multiLine", not lines).option("pathGlobFilter", glob).option("primitivesAsString", True)
    raw = reader.json(path)
    placed = with_positions(raw, **{c: F.col(f"`{c}`") for c in raw.columns})
    nested = {f.name for f in raw.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    shown = [(F.to_json(c) if c in nested else F.col(f"`{c}`").cast("string")).alias(c) for c in raw.columns]
    return placed.select("source", F.col("row_no").alias("row_idx"), *shown)


def json_grid(spark: SparkSession, path: str, lines: bool = False, glob: str = "*") -> DataFrame:
    """S2 as a grid whose row 0 holds the field names."""
    records = json_records(spark, path, lines, glob)
    names = [c for c in records.columns if c not in ("source", "row_idx")]
    sheet = F.lit(JSON_SHEET).alias("sheet")
    rows = records.select("source", sheet, (F.col("row_idx") + 1).alias("row_idx"), F.array(*[F.col(f"`{n}`") for n in names]).alias("cells"))
    heads = records.select("source").distinct().select(
        "source", sheet, F.lit(0).cast("long").alias("row_idx"), F.array(*[F.lit(n) for n in names]).alias("cells")
    )
    return heads.unionByName(rows)


def cell_grid(cells: DataFrame) -> DataFrame:
    """S3: a cell table ``source, sheet, row_idx, col_pos, value`` as grids.

    Rows without cells come back as empty rows, so that they separate blocks: the first and the last row of each gap, however
    long it is. Everything behind a grid reads positions, so what lies between them is implied (``with_blank_rows``).
    """
    sheet = ["source", "sheet"]
    widths = cells.groupBy(*sheet).agg((F.max("col_pos") + 1).alias("width"), F.count(F.lit(1)).alias("n"))
    # One row's cells: as many as the sheet has columns.
    packed = cells.groupBy(*sheet, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_pos", "value"))).alias("by_pos"))
    packed = lookup(packed, widths, [(F.col(c), c) for c in sheet], ["width"], "n", F.col("row_idx"))
    filled = packed.select(
        *sheet, "row_idx",
        F.transform(F.sequence(F.lit(0), F.col("width").cast("int") - 1), lambda p: F.try_element_at("by_pos", p)).alias("cells"),
    )
    filled = stage(filled, "cells")
    previous = running(filled, sheet, "row_idx", [Running("before", "max", F.col("row_idx"), strict=True)])
    gap_from = F.coalesce(F.col("before"), F.lit(-1)) + 1
    gaps = previous.where(gap_from < F.col("row_idx")).select(
        *sheet, F.explode(F.array_distinct(F.array(gap_from, F.col("row_idx") - 1))).alias("row_idx"),
        F.transform("cells", lambda c: F.lit(None).cast("string")).alias("cells"),
    )
    return filled.unionByName(gaps)


def with_blank_rows(grid: DataFrame) -> DataFrame:
    """A grid with every row that its gaps imply; as many rows as the last position says."""
    sheet = ["source", "sheet"]
    placed = running(grid, sheet, "row_idx", [Running("before", "max", F.col("row_idx"), strict=True)])
    inner = F.sequence(F.col("before") + 1, F.col("row_idx") - 1)
    blank = placed.where(F.col("row_idx") > F.col("before") + 1).select(
        *sheet, F.explode(inner).alias("row_idx"), F.transform("cells", lambda c: F.lit(None).cast("string")).alias("cells"))
    return grid.unionByName(blank)


def _ending(extensions: list[str]) -> str:
    """A file pattern for these endings, spelled as they are."""
    return "*{" + ",".join(re.sub(r"([\\*?{}\[\],^])", r"\\\1", e) for e in extensions) + "}"


def read_grids(spark: SparkSession, folder: str, json_lines: bool = False) -> DataFrame:
    """Every file of a folder by its extension; workbooks arrive as cell tables (S3).

    The extensions come from the listing; files of one format are read together.
    """
    spelled = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    listing = spark.read.format("binaryFile").load(folder).select(spelled.alias("ext")).distinct()
    found = sorted(r["ext"] for r in listing.toLocalIterator())
    if books := [e for e in found if e.lower() in WORKBOOKS]:
        raise ValueError(f"workbooks ({', '.join(books)}) arrive as cell tables, not as files: {folder}")
    parts = [json_grid(spark, folder, json_lines, _ending([e])) for e in found if e.lower() == ".json"]
    plain = [e for e in found if e.lower() != ".json" and e]
    if plain:
        parts.append(csv_grid(spark, folder, glob=_ending(plain)))
    if "" in found:
        parts.append(csv_grid(spark, folder).where(extension(F.col("source")) == ""))
    return reduce(DataFrame.unionByName, parts)


def inspect(grid: DataFrame) -> DataFrame:
    """S5 per sheet: data rows (the first row is the header), columns, emptiness."""
    found = grid.groupBy("source", "sheet").agg(
        F.max("row_idx").alias("rows"), F.max(F.size("cells")).alias("columns")
    )
    return found.withColumn("is_empty", F.col("rows") == 0)


def inspect_files(spark: SparkSession, path: str, sheets: DataFrame) -> DataFrame:
    """S5 per file: name, size, and its sheets; sizes come from the listing, contents stay unread."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("source"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size_bytes")
    )
    listed = sheets.groupBy(F.regexp_replace("source", r"^file:/+", "file:/").alias("source")).agg(
        F.array_sort(F.collect_list(F.struct("sheet", "rows", "columns", "is_empty"))).alias("sheets")
    )
    files = files.withColumn("source", F.regexp_replace("source", r"^file:/+", "file:/"))
    out = files.join(listed, "source", "left")
    return out.select(
        "source", "file_name", "file_size_bytes", F.coalesce(F.size("sheets"), F.lit(0)).alias("total_sheets"), "sheets"
    )


