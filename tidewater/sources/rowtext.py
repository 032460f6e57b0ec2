"""Row text: a line "# schema: name:TYPE,..." and then tab-separated rows.

Files are read as splittable text, once; each part that is written begins with the header, so a
directory of parts reads like one table. The first file's header gives the schema, and the
scan itself holds every other header against it. Values are not escaped in this format: writing a null,
a tab or a line end, the empty string as a row of its own, or a first value that looks like a
header, raises; so does reading a line that looks like a header but isn't one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "# schema: "
TYPES = {"INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType()}
_NAMES = {v: k for k, v in TYPES.items()}


def parse_header(line: str) -> T.StructType:
    if not line.startswith(MARK):
        raise ValueError(f"no schema line: {line[:80]!r}")
    fields = []
    for part in line[len(MARK) :].split(","):
        name, _, kind = part.rpartition(":")
        if kind.strip() not in TYPES or not name.strip():
            raise ValueError(f"not a column: {part!r}")
        fields.append(T.StructField(name.strip(), TYPES[kind.strip()]))
    return T.StructType(fields)


def header(schema: T.StructType) -> str:
    for f in schema.fields:
        if f.dataType not in _NAMES:
            raise ValueError(f"row text can't hold {f.dataType.simpleString()} ({f.name})")
    return MARK + ",".join(f"{f.name}:{_NAMES[f.dataType]}" for f in schema.fields)


def read(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of files or directories; a declared schema must have the types of the first file, and every file the same types."""
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    first = next((head[0][0] for path in sorted(lines.inputFiles()) if (head := spark.read.text(path).head(1))), "")
    found = parse_header(first)
    kinds = [_NAMES[f.dataType] for f in found.fields]
    if schema is not None and [f.dataType for f in schema.fields] != [f.dataType for f in found.fields]:
        raise ValueError(f"the declared schema isn't that of {first!r}")
    use = schema or found
    rows = lines.select("value", F.col("_metadata.file_block_start").alias("begin"))
    same = r"^# schema: [^,]+:\s*" + r"\s*,[^,]+:\s*".join(kinds) + r"\s*$"
    head = F.startswith("value", F.lit(MARK))
    wrong = ~((F.col("begin") == 0) & F.regexp_like("value", F.lit(same)))
    rows = rows.where(F.when(head & wrong, F.raise_error(F.concat(F.lit("not the header of this table: "), F.col("value"))).cast("boolean")).otherwise(~head))
    if len(use.fields) > 1:
        rows = rows.where("value <> ''")
    parts = F.split("value", "\t", -1)
    checked = F.when(F.size(parts) == len(use.fields), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))))
    return rows.select(checked.alias("p")).select(*(F.col("p")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(use.fields)))


def write(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """Writes parts in parallel, or one part; mode "append" adds parts."""
    first = header(df.schema)
    cells = []
    for k, f in enumerate(df.schema.fields):
        text = F.col(f"`{f.name}`").cast("string")
        bad = text.isNull() | F.regexp_like(text, F.lit(r"[\t\n\r]"))
        if len(df.columns) == 1:
            bad = bad | (text == "")
        if k == 0:
            bad = bad | F.startswith(text, F.lit(MARK))
        cells.append(F.when(bad, F.raise_error(F.lit(f"row text can't hold this value of {f.name}"))).otherwise(text))
    lines = df.select(F.concat_ws("\t", *cells).alias(first))
    lines = lines.coalesce(1) if single else lines
    options = {"header": True, "sep": "\u0001", "quote": "", "escape": "", "emptyValue": "", "comment": "\u0002", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.mode(mode).options(**options).csv(path)
