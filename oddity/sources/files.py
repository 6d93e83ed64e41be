"""File scans (S1-S3): CSV, XML records and zip archives, each ending in a
DataFrame with a stable ``row_id`` in file order.

Column types follow what a pandas reader would give: text columns whose
non-null values are all integers become long, all numbers become double,
everything else stays text (dates stay text until kinds are applied).
"""

from __future__ import annotations

import io
import itertools
import posixpath
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import NUMBER_TEXT_RE
from ..operators.order import dense_index

# --- fixed values: the text that pandas' CSV reader reads as missing --------
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null")
DATA_EXTENSIONS = (".csv", ".xml")
INT_TEXT_RE = r"^[+-]?\d+$"
BOOL_WORDS = ("True", "False", "TRUE", "FALSE", "true", "false")


class EmptyTableError(ValueError):
    pass


def na_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or df.columns
    return df.select(*[F.when(F.col(c).isin(*NA_TOKENS), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def infer_text_types(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Cast text columns to long / double / boolean when every non-null value fits (one aggregate)."""
    cols = [f.name for f in df.schema.fields if f.name != row_id and isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(c))
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(v.rlike(INT_TEXT_RE)).alias(f"i{i}"),
                 F.count_if(v.rlike(NUMBER_TEXT_RE) | F.lower(v).isin("inf", "-inf", "+inf")).alias(f"d{i}"),
                 F.count_if(v.isin(*BOOL_WORDS)).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    out = []
    for f in df.schema.fields:
        c = f.name
        if c not in cols:
            out.append(F.col(c))
            continue
        i = cols.index(c)
        n = r[f"n{i}"]
        v = F.trim(F.col(c))
        if n and r[f"i{i}"] == n:
            out.append(v.try_cast("long").alias(c))
        elif n and r[f"d{i}"] == n:
            out.append(v.try_cast("double").alias(c))
        elif n and r[f"b{i}"] == n:
            out.append(F.lower(v).try_cast("boolean").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# --------------------------------------------------------------------------- splits of text files
SPLIT = ["_file", "_start"]


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _start, line) of text files; ``_start`` is the offset of the split a line was read in."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                    F.col("value").alias("line")))


def _runs(batches):
    """(file, start, lines) of each Arrow batch, cut where the split changes; lines of a split follow each other."""
    for batch in batches:
        starts, lines = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        files = batch.column(0).dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1 if len(starts) else []
        for first, last in zip([0, *cuts], [*cuts, len(starts)], strict=True):
            if last > first:
                yield files.dictionary[codes[first]].as_py(), int(starts[first]), lines.slice(first, last - first)


def _states(lines: pa.Array, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of a split: whether a quoted value is open before and after each, and whether the line is blank."""
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
    after = (inside + np.cumsum(quotes)) % 2
    before = np.concatenate([[inside], after[:-1]])
    return before, after, pc.utf8_length(pc.utf8_trim_whitespace(lines)).to_numpy(zero_copy_only=False) == 0


def _summarise(batches):
    """One row a split: parity of its quotes, and the records starting in it if it begins outside or inside a quoted value."""
    now, totals = None, [0, 0, 0]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), *[pa.array([x], pa.int64()) for x in (now[1], *totals)]],
                                          names=["_file", "_start", "parity", "outside", "inside"])

    for file, start, lines in _runs(batches):
        if (file, start) != now:
            if now is not None:
                yield row()
            now, totals = (file, start), [0, 0, 0]
        before, after, blank = _states(lines, totals[0])
        totals[1] += int(((before == 0) & ~blank).sum())
        totals[2] += int(((before == 1) & ~blank).sum())
        totals[0] = int(after[-1])
    if now is not None:
        yield row()


def _plan_records(rows: list) -> tuple[dict, list[int], int]:
    """From the summaries of all splits: how each begins and ends, where the files' headers are, and the number of records.

    The first maps (file, start) to whether the split begins inside a quoted value, the records
    before it, and whether it ends inside one.
    """
    plan, headers, file, inside, n = {}, [], None, 0, 0
    for r in sorted(rows, key=lambda r: (r["_file"], r["_start"])):
        if r["_file"] != file:
            file, inside, headed = r["_file"], 0, False
        end = (inside + r["parity"]) % 2
        begun = r["inside"] if inside else r["outside"]
        plan[file, r["_start"]] = (inside, n, end)
        if begun and not headed:
            headers.append(n)
            headed = True
        n, inside = n + begun, end
    return plan, headers, n


def _joined(lines: pa.Array, ends: np.ndarray) -> pa.Array:
    """The lines between successive ends, each joined to one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines), "\n")


def _assemble(plan, pieces: bool):
    """Records of each split: whole ones (position, record), or with ``pieces`` what crosses its ends (position, start, seq, record)."""
    def emit(records, position, start=0, seq=0):
        columns = [pa.array(position, pa.int64())]
        if pieces:
            columns += [pa.array([start], pa.int64()), pa.array([seq], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, records.cast(pa.string())],
                                          names=["position", *(["start", "seq"] if pieces else []), "record"])

    def run(batches):
        now, held, n, seq = None, None, 0, 0
        for file, start, lines in itertools.chain(_runs(batches), [(None, 0, None)]):
            if (file, start) != now:
                if held is not None and pieces:  # the record that the last split ended in
                    yield emit(_joined(held, [0, len(held)]), [n - 1], now[1], seq)
                if file is None:
                    return
                now, held, seq = (file, start), None, 0
                inside, n, _ = plan.value[now]
                heading = inside == 1  # in a record that began in an earlier split
            before, after, blank = _states(lines, inside)
            inside, cut = int(after[-1]), 0
            if heading:
                heading = bool(after.all())
                cut = len(after) if heading else int(np.argmin(after)) + 1
                if pieces:
                    yield emit(_joined(lines.slice(0, cut), [0, cut]), [n - 1], start, seq)
                    seq += 1
            kept = np.arange(len(after)) >= cut
            kept &= (before == 1) | ~blank
            begins = ((before == 0) & ~blank)[kept]
            texts, first = lines.filter(pa.array(kept)), n
            if held is not None:
                texts, first = pa.concat_arrays([held, texts]), n - 1
                begins = np.concatenate([np.arange(len(held)) == 0, begins])
            n = first + int(begins.sum())
            ends = np.append(np.flatnonzero(begins), len(texts))
            whole = len(ends) - 1
            held = None
            if whole and inside:
                whole -= 1
                held = texts.slice(int(ends[whole]))
            if whole and not pieces:
                yield emit(_joined(texts, ends[:whole + 1]), np.arange(first, first + whole))
    return run


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[int], int]:
    """(position, record) of CSV files, read by splits though quoted values may hold line ends.

    A line end is in a quoted value if an odd number of quotes comes before it. A first pass counts
    the quotes of each split and the records that start in it in either case; running sums over
    the splits (a row each, on the driver) then say how every split begins and how many records
    come before it. Positions follow the order of paths and offsets. Records that cross the end of
    a split are put together from their pieces. Also returned: the files, the positions of their
    headers, and the number of records.
    """
    lines = _text_lines(spark, path)
    counts = lines.mapInArrow(_summarise, "_file string, _start long, parity long, outside long, inside long").collect()
    plan, headers, n = _plan_records(counts)
    shared = spark.sparkContext.broadcast(plan)
    records = lines.mapInArrow(_assemble(shared, False), "position long, record string")
    if any(inside or end for inside, _, end in plan.values()):
        pieces = lines.mapInArrow(_assemble(shared, True), "position long, start long, seq long, record string")
        joined = pieces.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "record"))).alias("p")).select(
            "position", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
        records = records.union(joined)
    records = records.withColumn("record", F.regexp_replace("record", "\\A\ufeff|\r\\z", ""))
    return records, sorted({f for f, _ in plan}), headers, n


def read_csv(spark: SparkSession, path: str, infer_types: bool = True, row_id: str = "row_id") -> DataFrame:
    """Header CSV, all values read as text, NA words to null, then pandas-like typing.

    Quoted values may hold line ends, and a file is still read by several tasks. ``row_id`` is the
    place in file order (files by path), worked out from counts per split, so nothing is copied.
    An empty table (no rows) is refused. Lines end in LF or CR LF.
    """
    records, files, headers, n = csv_records(spark, path)
    if n <= len(headers):
        raise EmptyTableError(f"no rows in {path}")
    options = {"quote": '"', "escape": '"', "sep": ","}
    names = spark.read.options(**options).option("header", True).option("multiLine", True).csv(files[0]).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    # rows lose the headers before them; the positions of the headers, one a file, are looked up in an ordered array
    heads = F.array(*[F.lit(h) for h in headers])
    passed = F.size(F.filter(heads, lambda h: h < F.col("position"))) if len(headers) > 1 else F.lit(1)
    rows = records.where(~F.array_contains(heads, F.col("position"))).select(
        (F.col("position") - passed).cast("long").alias(row_id), F.from_csv("record", schema, options).alias("_r"))
    df = na_to_null(rows.select(row_id, *[F.col("_r").getField(c).alias(c) for c in names]), names)
    return infer_text_types(df, row_id) if infer_types else df


def scan_index(scan: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``scan``, straight from files, with each row's place in file order (files by path), without a copy of it.

    Rows of a split follow each other, so a place is the number of rows of the splits before (a row
    each, counted in a first pass) plus the place since the split's first row.
    """
    tagged = scan.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                               "_mid": F.monotonically_increasing_id()})
    splits = tagged.groupBy(*SPLIT).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    before, n = [], 0
    for r in sorted(splits, key=lambda r: (r["_file"], r["_start"])):
        before.append((r["_file"], r["_start"], n - r["_first"]))
        n += r["_n"]
    shifts = scan.sparkSession.createDataFrame(before, "_file string, _start long, _shift long")
    return (tagged.join(F.broadcast(shifts), SPLIT).withColumn(row_id, F.col("_mid") + F.col("_shift"))
            .drop(*SPLIT, "_mid", "_shift"))


def _flatten(schema: T.StructType, prefix: str = "", path=None):
    """(column path, output name) for every leaf of a nested struct schema."""
    out = []
    for f in schema.fields:
        name = f.name
        full = f"{prefix}_{name}" if prefix else name
        p = (path or []) + [name]
        dt = f.dataType
        if isinstance(dt, T.ArrayType):
            dt = dt.elementType
            p = p[:-1] + [(name, "last")]
        if isinstance(dt, T.StructType):
            has_children = any(not c.name.startswith("@") and c.name != "_VALUE" for c in dt.fields)
            for sub in _flatten(dt, full, p):
                if sub[1] == f"{full}__VALUE":
                    # text of an element: named after the element; dropped when it has children
                    if has_children:
                        continue
                    sub = (sub[0], full)
                out.append(sub)
        else:
            out.append((p, full))
    return out


def _path_col(path):
    c = None
    for step in path:
        if isinstance(step, tuple):
            name, _ = step
            c = F.col(name) if c is None else c.getField(name)
            c = F.element_at(c, -1)
        else:
            c = F.col(step) if c is None else c.getField(step)
    return c


def read_xml(spark: SparkSession, path: str, row_tag: str = "record", row_id: str = "row_id") -> DataFrame:
    """Every ``row_tag`` element is one row; nested tags join with '_', attributes
    become ``<parent>_@name``, a repeated tag keeps its last value, namespaces are
    stripped, blank text is null. All leaf values stay text."""
    raw = (spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@")
           .option("valueTag", "_VALUE").option("ignoreNamespace", True)
           .option("inferSchema", False).load(path))
    leaves = _flatten(raw.schema)
    cols = []
    for p, name in leaves:
        v = F.trim(_path_col(p).cast("string"))
        cols.append(F.when(v == "", F.lit(None)).otherwise(v).alias(name))
    df = scan_index(raw, row_id).select(row_id, *cols)
    if df.isEmpty():
        raise EmptyTableError(f"no rows in {path}")
    return df


MEMBER_SCHEMA = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("line", T.LongType()), T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("columns", T.ArrayType(T.StringType()))])


#: Rows of a member that are held and handed on at once.
ARCHIVE_ROWS = 5000


def _is_data_member(name: str) -> bool:
    base = posixpath.basename(name)
    return (not name.startswith("__MACOSX") and "/__MACOSX/" not in name and not base.startswith(".")
            and base.lower().endswith(DATA_EXTENSIONS) and not name.endswith("/"))


def _archive_rows(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                for name in zf.namelist():
                    if not _is_data_member(name) or not name.lower().endswith(".csv"):
                        continue
                    line = 0
                    with zf.open(name) as text, pd.read_csv(text, dtype=str, keep_default_na=False,
                                                            chunksize=ARCHIVE_ROWS) as tables:
                        for table in tables:  # a part at a time: a member may be larger than a batch can be
                            cols = [str(c) for c in table.columns]
                            values = table.to_numpy(dtype=object).tolist()  # one list of texts per row
                            if not values:  # only a header; Arrow cannot tell an empty column's type
                                continue
                            yield pd.DataFrame({"archive": path, "member": name, "line": range(line, line + len(values)),
                                                "values": values, "columns": [cols] * len(values)})
                            line += len(values)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """S3: list the data members of zip archives (one task per archive)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)

    def members(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as zf:
                    names = [n for n in zf.namelist() if _is_data_member(n)]
                yield pd.DataFrame({"archive": [p] * len(names), "member": names})
    return files.select("path", "content").mapInPandas(members, "archive string, member string")


def read_archive(spark: SparkSession, path: str, member: str | None = None,
                 row_id: str = "row_id") -> DataFrame:
    """S3: rows of the CSV member of each archive (the only one, or ``member``).

    Archives are spread over tasks; each task parses its CSV payloads with the
    CSV reader, so quoted newlines survive. The result has the member's header
    columns, NA words as null, pandas-like types and a file-order ``row_id``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    rows = files.select("path", "content").mapInPandas(_archive_rows, MEMBER_SCHEMA)
    if member is not None:
        rows = rows.filter(F.col("member") == member)
    first = rows.select("columns").first()
    if first is None:
        raise EmptyTableError(f"no CSV rows in archives at {path}")
    cols = list(first["columns"])
    ordered = rows.orderBy("archive", "member", "line")
    # a member's value for column c sits at c's position in that member's header
    flat = ordered.select(*[F.try_element_at("values", F.array_position("columns", F.lit(c)).cast("int")).alias(c)
                            for c in cols])
    flat = na_to_null(flat)
    df = dense_index(flat, row_id)
    df = df.select(row_id, *cols)
    return infer_text_types(df, row_id)
