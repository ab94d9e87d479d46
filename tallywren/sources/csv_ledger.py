"""The upload format: a strict comma-separated ledger with a stream of rejected lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import LedgerError
from ..schema import KINDS
from ..session import materialize

# Columns and limits of the format.
REQUIRED = ("external_id", "amount_minor", "currency", "value_date")
OPTIONAL = ("reference", "counterparty", "fee_minor", "tax_minor")
MAX_BYTES, MAX_ROWS = 2_000_000, 20_000
SAFE = 2**53 - 1

REASONS = ("no external_id", "amount_minor is not an exact integer", "value_date is not a date", "currency is not a three-letter code")


def check_header(header: str) -> list[str]:
    found = [c.strip().lower() for c in header.split(",")]
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise LedgerError("INGEST_MALFORMED", f"Missing required columns: {', '.join(missing)}.", required=list(REQUIRED), found=found)
    return found


def parse_lines(lines: DataFrame, header: str, kind: str, lenient: bool = False) -> DataFrame:
    """``lines(line, text)`` with all columns of a record, and ``reject_reason`` (null if accepted).

    The first failing test names the reason. ``lenient`` takes a leading integer as the amount.
    """
    if kind not in KINDS:
        raise LedgerError("SOURCE_NOT_FOUND", f"unknown source kind {kind}")
    columns = check_header(header)
    cells = F.transform(F.split("text", ","), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    rows = lines.withColumn("cells", cells)

    def cell(name: str):
        return F.get("cells", F.lit(columns.index(name))) if name in columns else F.lit(None).cast("string")

    def integer(name: str):
        pattern = r"^([+-]?\d+)" if lenient else r"^([+-]?\d+)$"
        return F.nullif(F.regexp_extract(cell(name), pattern, 1), F.lit("")).try_cast("long")

    amount = integer("amount_minor")
    day = cell("value_date").try_cast("timestamp")
    reason = (
        F.when(F.coalesce(cell("external_id"), F.lit("")) == "", REASONS[0])
        .when(amount.isNull() | (F.abs(amount) > SAFE), REASONS[1])
        .when(day.isNull(), REASONS[2])
        .when(F.coalesce(F.length(cell("currency")), F.lit(0)) != 3, REASONS[3])
    )
    raw = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(cell(c) for c in columns)))
    return rows.select(
        "line", *(c for c in ("file", "ord") if c in lines.columns), F.lit(kind).alias("kind"), cell("external_id").alias("external_id"), cell("reference").alias("reference"), amount.alias("amount_minor"), F.upper(cell("currency")).alias("currency"),
        F.coalesce(integer("fee_minor"), F.lit(0)).cast("long").alias("fee_minor"), F.coalesce(integer("tax_minor"), F.lit(0)).cast("long").alias("tax_minor"), cell("counterparty").alias("counterparty"),
        day.alias("occurred_at"), day.alias("value_date"), F.lit(None).cast("string").alias("truth_group_id"), raw.alias("raw"), reason.alias("reject_reason"),
    )


def parse_text(spark: SparkSession, text: str, kind: str, lenient: bool = False, compact_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` of one uploaded file. Limits are tested before parsing; rejected rows carry
    their physical line, or with ``compact_lines`` their number among the lines that are not blank."""
    if len(text.encode()) > MAX_BYTES:
        raise LedgerError("INGEST_TOO_LARGE", f"An upload may hold {MAX_BYTES} bytes; this one is larger.")
    lines = [(i + 1, x.removesuffix("\r")) for i, x in enumerate(text.split("\n")) if x.strip()]
    if not lines:
        raise LedgerError("INGEST_MALFORMED", "Nothing but blank lines was uploaded.")
    if len(lines) - 1 > MAX_ROWS:
        raise LedgerError("INGEST_TOO_LARGE", f"An upload may hold {MAX_ROWS} rows; this one has more.")
    check_header(lines[0][1])
    body = [(n + 2 if compact_lines else i, x) for n, (i, x) in enumerate(lines[1:])]
    parsed = parse_lines(spark.createDataFrame(body, "line long, text string"), lines[0][1], kind, lenient)
    return accepted(parsed), parsed.where("reject_reason is not null").select("line", F.col("reject_reason").alias("reason"))


def accepted(parsed: DataFrame) -> DataFrame:
    """Records of accepted lines. Their id names file and line, so that equal lines of several files are several records; their
    order is the line, or ``ord`` where there are several files."""
    rows = parsed.where("reject_reason is null").drop("reject_reason")
    several = "file" in rows.columns
    key = F.concat_ws("|", "kind", "external_id", *(["file"] if several else []), F.col("line").cast("string"))
    rows = rows.withColumn("id", F.concat(F.lit("rec_"), F.substring(F.sha2(key, 256), 1, 20)))
    return rows.drop("file", "line") if several else rows.withColumnRenamed("line", "ord")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, ord, text)`` of all files: the physical line within its file, and an order over all files by name.

    A file is read in as many splits as it needs. Lines are numbered within their split by place, and splits by the
    lines before them, of which there is one number each; so no file and no order is one task's.
    """
    text = spark.read.text(path).select(F.col("value").alias("text"), F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("split"), F.monotonically_increasing_id().alias("at"))
    text = materialize(text, "lines")  # places must not change between the two reads
    splits = text.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over((W.partitionBy(*by) if by else W.partitionBy()).orderBy("file", "split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", "first", before("file").alias("in_file"), before().alias("in_all"))
    own = F.col("at") - F.col("first") + 1
    return text.join(splits, ["file", "split"]).select("file", (F.col("in_file") + own).alias("line"), (F.col("in_all") + own).alias("ord"), "text")


def read_files(spark: SparkSession, path: str, header: str, kind: str, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """Folders of large files with one known header, read and parsed in parallel: accepted records, whose order and ids are unique over
    all files, and ``(file, line, reason)`` of the rest. A file that begins with another header is an error."""
    lines = numbered_lines(spark, path).where(F.trim("text") != "")
    firsts = lines.groupBy("file").agg(F.min(F.struct("line", "text")).alias("first"))
    known = ",".join(check_header(header))
    same = F.array_join(F.transform(F.split(F.lower("first.text"), ","), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), ",") == known
    other = firsts.where(~same).limit(1).collect()
    if other:
        raise LedgerError("INGEST_MALFORMED", f"{other[0].file} begins with another header.", found=other[0].first.text)
    body = lines.join(firsts.select("file", F.col("first.line").alias("head")), "file").where("line > head").drop("head")
    parsed = parse_lines(body, header, kind, lenient)
    return accepted(parsed), parsed.where("reject_reason is not null").select("file", "line", F.col("reject_reason").alias("reason"))
