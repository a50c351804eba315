"""CSV files with headers in, CSV and JSON out.

Cells are read as text under their header names and then cast to the table's types,
so column order, extra columns and the many spellings of "missing" do no harm, and a
code such as a tax section never turns into a number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebooks import fixed_values as V
from closebooks.schemas import TABLE_SCHEMAS
from closebooks.sources.shared import dropped_shuffles


MALFORMED = "_malformed"
BAD_ROW = "(row)"
_RAW = "_raw_record"


def snake_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def journal_header(name: str) -> str:
    """Title case with spaces, alternate names mapped to the expected one."""
    title = name.strip().title().replace("_", " ")
    return V.JOURNAL_HEADER_ALIASES.get(title, title)


def _renamed(columns: list[str], rule: Callable[[str], str]) -> list[str]:
    names = [rule(c) for c in columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"headers fall together: {', '.join(twice)}")
    return names


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*_renamed(df.columns, snake_header))


def normalize_journal_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*_renamed(df.columns, journal_header))


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """The frame itself, or an error that names what is missing; starts no job."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def _missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*V.CSV_MISSING_TOKENS), c)


def typed(df: DataFrame, schema: T.StructType, rejects: str | None = None) -> DataFrame:
    """Text columns cast to `schema`; a column the frame lacks is null.

    With `rejects`, a column of that name lists the fields whose text did not parse, and
    BAD_ROW where the row itself could not be cut into cells.
    """
    def cell(name: str) -> Column:
        return _missing_to_null(F.trim(F.col(f"`{name}`")))

    columns, bad = [], []
    for f in schema.fields:
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = cell(f.name).try_cast(f.dataType)
        columns.append(value.alias(f.name))
        bad.append(F.when(cell(f.name).isNotNull() & value.isNull(), F.lit(f.name)))
    kept = [F.col(f"`{c}`") for c in df.columns if c.startswith("_") and c != MALFORMED]
    if MALFORMED in df.columns:
        bad.append(F.when(F.col(MALFORMED), F.lit(BAD_ROW)))
    if rejects:
        kept.append(F.array_compact(F.array(*bad)).alias(rejects))
    return df.select(*columns, *kept)


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        .option("mode", "PERMISSIVE").option("pathGlobFilter", "*.csv")
    )


def literal_path(path: str) -> str:
    """A path whose brackets, stars and the like are not a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def header_groups(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """Files (as Spark names their rows' source) by their header line.

    The headers of all files are read as data, in one job: the first line that is not
    empty in the block at each file's start. One row a file comes back. A file without
    any line has no header. A header with a line break inside quotes is a group of its own.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(paths).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))
    first = (
        lines.filter((F.col("start") == 0) & (F.length(F.trim("line")) > 0))
        .groupBy("file").agg(F.min_by("line", "place").alias("line"))
    )
    groups: dict[str, list[str]] = {}
    for r in first.collect():
        open_quote = r["line"].count('"') % 2 == 1
        groups.setdefault(r["line"] + (r["file"] if open_quote else ""), []).append(r["file"])
    return {line: sorted(files) for line, files in sorted(groups.items())}


def paths_of(files: Iterable[str]) -> list[str]:
    """Paths for reading of files that Spark has named as a source."""
    return [literal_path(unquote(f)) for f in files]


def _by_header(spark: SparkSession, path: str) -> list[str | list[str]]:
    """What to read with one schema: the path itself, or a list of files per header.

    A single file needs no look at its header, and a folder of one header is read whole.
    """
    names = _reader(spark, False).text(path).inputFiles()
    if not names:
        raise FileNotFoundError(f"no CSV files in {path}")
    if len(names) == 1:
        return [path]
    groups = header_groups(spark, path)
    return [path] if len(groups) == 1 else [paths_of(files) for files in groups.values()]


def _text_csv(
    spark: SparkSession, paths: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Files of one header: all cells as text, and MALFORMED: too many cells, or an open quote.

    Doubled quotes are quotes. A quoted line break needs `multi_line`, which reads each
    file in one task; without it, such a row is malformed and never stored in two halves.
    """
    # Spark looks at one of the files; all have this header.
    one = paths if isinstance(paths, str) else paths[0]
    names = _reader(spark, multi_line).csv(one).columns
    if not names:
        raise ValueError(f"no header in {one}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAW]])
    text = (
        _reader(spark, multi_line).schema(schema)
        .option("columnNameOfCorruptRecord", _RAW).option("columnPruning", False).csv(paths)
    )
    # Spark refuses a query of the raw record alone; no characters of a cell are added to it.
    raw = F.concat(F.col(_RAW), F.left(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), F.lit(0)))
    commas = F.regexp_count(F.regexp_replace(raw, '"(?:[^"]|"")*"', ""), F.lit(","))
    odd_quotes = F.regexp_count(raw, F.lit('"')) % 2 == 1
    return text.withColumn(
        MALFORMED, F.coalesce(odd_quotes | (commas >= len(names)), F.lit(False))).drop(_RAW)


def _whole_rows(text: DataFrame) -> DataFrame:
    """The rows without MALFORMED; reading a malformed one is an error."""
    fail = F.raise_error(F.lit("malformed CSV row: too many cells, or an open quote"))
    sound = F.when(F.col(MALFORMED), fail.cast("boolean")).otherwise(F.lit(True))
    return text.filter(sound).drop(MALFORMED)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all layouts by column name; a column that a layout lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_table_csv(
    spark: SparkSession, path: str, table: str, rejects: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV file or folder (only *.csv) as the named table.

    Headers are normalized, and cells go by the header of their own file: the files of a
    folder may differ in the order of their columns and in columns the table does not have.
    Every file must have every column of the table but for `id`.
    Without `rejects`, a malformed row is an error.
    """
    schema = TABLE_SCHEMAS[table]
    frames = []
    for files in _by_header(spark, path):
        text = _text_csv(spark, files, multi_line)
        text = normalize_headers(text if rejects else _whole_rows(text))
        require_columns(text, [c for c in schema.names if c != "id"])
        columns = [*schema.names, rejects] if rejects else schema.names
        frames.append(typed(text, schema, rejects).select(*columns))
    return _union(frames)


def read_named_csv(
    spark: SparkSession, path: str, kind: str, multi_line: bool = False
) -> DataFrame:
    """CSV files under their own headers, each checked for the columns its kind requires."""
    frames = []
    for files in _by_header(spark, path):
        text = _whole_rows(_text_csv(spark, files, multi_line))
        require_columns(text, V.REQUIRED_COLUMNS[kind])
        frames.append(
            text.select(*[_missing_to_null(F.col(f"`{c}`")).alias(c) for c in text.columns]))
    return _union(frames)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files of a folder; file names only, no data."""
    try:
        names = _reader(spark, False).text(folder).inputFiles()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return paths_of(sorted(names))


def text_rows(
    spark: SparkSession, paths: list[str], rule: Callable[[str], str], multi_line: bool = False
) -> DataFrame:
    """Files of one layout as text under normalized headers, with _source_file, MALFORMED."""
    text = _text_csv(spark, paths, multi_line)
    cells = [c for c in text.columns if c != MALFORMED]
    return text.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(cells, _renamed(cells, rule))],
        F.col("_metadata.file_path").alias("_source_file"), MALFORMED,
    )


def union_journal_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files with differing headers as one frame; a column a file lacks is null.

    Files are grouped by header, so the plan has one scan per layout, not per file.
    """
    if not paths:
        raise FileNotFoundError("no CSV files")
    groups = header_groups(spark, paths).values()
    if not groups:
        raise ValueError("no header in any of the CSV files")
    union = _union(_whole_rows(text_rows(spark, paths_of(group), journal_header))
                   for group in groups)
    data = [c for c in union.columns if c != "_source_file"]
    return union.select(
        *[_missing_to_null(F.col(f"`{c}`")).alias(c) for c in data], "_source_file"
    )


def read_journals(spark: SparkSession, folder: str, fallback: str | None = None) -> DataFrame:
    """All CSV files of a folder, or the one fallback file when there are none."""
    paths = _files(spark, folder)
    if not paths and fallback:
        paths = _files(spark, fallback)
    if not paths:
        raise FileNotFoundError(f"No CSV files found in {folder} or {fallback}")
    return union_journal_files(spark, paths)


# --- Fixed values: incoming header -> column of the checks, and its type -----
CHECK_COLUMNS = {
    "journals": {
        "Journal ID": ("journal_id", "string"), "Date": ("entry_date", "date"),
        "Account": ("account", "string"), "Type": ("type", "string"),
        "Amount": ("amount", "decimal(15,2)"), "Entity": ("entity", "string"),
    },
    "interco": {
        "Entity": ("entity", "string"), "Counterparty": ("counterparty", "string"),
        "Account": ("account", "string"), "Amount": ("amount", "decimal(15,2)"),
        "Journal ID": ("journal_id", "string"),
    },
    "gst": {
        "Invoice No": ("invoice_no", "string"), "GSTR Summary": ("gstr_summary", "string"),
        "ITC Flag": ("itc_flag", "string"), "GSTIN": ("gstin", "string"),
        "Invoice Date": ("invoice_date", "date"), "Tax Amount": ("tax_amount", "decimal(15,2)"),
    },
    "tds": {
        "PAN": ("pan", "string"), "Section": ("section_code", "string"),
        "TDS Amount": ("tds_amount", "decimal(15,2)"),
        "Challan No": ("challan_number", "string"), "Date": ("transaction_date", "date"),
    },
    "provisions": {
        "Expense Ledger": ("expense_ledger", "string"), "Period": ("period", "date"),
        "Vendor": ("vendor", "string"), "Frequency": ("frequency", "string"),
        "Last Provision Date": ("last_provision_date", "date"),
        "Amount": ("amount", "decimal(15,2)"),
    },
    "trial_balance": {
        "Account": ("account", "string"), "Debit": ("debit", "decimal(15,2)"),
        "Credit": ("credit", "decimal(15,2)"), "Entity": ("entity", "string"),
    },
    "interco_matrix": {
        "Entity": ("entity", "string"), "Counterparty": ("counterparty", "string"),
        "Amount": ("amount", "decimal(15,2)"), "Account": ("account", "string"),
    },
}


def to_check_columns(df: DataFrame, kind: str) -> DataFrame:
    """Title-case file columns to the typed columns the operators work on.

    A cell that does not parse is an error when its row is read; `unreadable_cells` lists
    all of them beforehand. A check never drops such a row as if the cell were empty.
    """
    require_columns(df, V.REQUIRED_COLUMNS[kind])

    def cell(header: str, type_: str) -> Column:
        value = F.col(f"`{header}`")
        parsed = value.try_cast(type_)
        fail = F.raise_error(F.concat(F.lit(f"unreadable {header}: "), value.cast("string")))
        return F.when(value.isNotNull() & parsed.isNull(), fail.cast(type_)).otherwise(parsed)

    return df.select(*[cell(header, type_).alias(name)
                       for header, (name, type_) in CHECK_COLUMNS[kind].items()])


def unreadable_cells(df: DataFrame, kind: str) -> DataFrame:
    """(field, value, row_count) of the cells that `to_check_columns` cannot parse."""
    require_columns(df, V.REQUIRED_COLUMNS[kind])
    bad = [
        F.when(F.col(f"`{header}`").isNotNull() & F.col(f"`{header}`").try_cast(type_).isNull(),
               F.struct(F.lit(header).alias("field"),
                        F.col(f"`{header}`").cast("string").alias("value")))
        for header, (_, type_) in CHECK_COLUMNS[kind].items()
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*bad))).alias("cell"))
        .groupBy("cell.field", "cell.value").agg(F.count(F.lit(1)).alias("row_count"))
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header that `_text_csv` reads back unchanged (line breaks: multi_line)."""
    with dropped_shuffles(df.sparkSession):
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
