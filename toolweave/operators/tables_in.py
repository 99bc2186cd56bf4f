"""Tables inside files: delimited rows, discriminators, field coverage, sensor shape, JSON rows, tagged binary records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.frames import without
from ..functions.maps import first_of, last_of
from ..functions.text import coerce_text, non_blank_lines, present, strip
from .detect import delimiter_score


def read_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with line_no (from 1) and line: byte-order mark dropped, CRLF and CR as LF."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "^﻿", ""), "\r\n?", "\n")
    names = [c for c in docs.columns if c != text_col]
    return docs.select(*names, F.posexplode(F.split(text, "\n")).alias("__p", "line")).select(*names, (F.col("__p") + 1).alias("line_no"), "line")


# A cell starts with a quote (which doubled quotes within don't end) or has none at its start. Possessive: no stepping back.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"|$)'
RECORD_TAIL = r"(?:\n|$)"


def _csv_cells(record: Column, delimiter: Column) -> Column:
    """The cells of one record, unquoted and trimmed."""
    cell = F.concat(F.lit("[" ), delimiter, F.lit("]((?:" + QUOTED + "[^"), delimiter, F.lit("]*+)|[^"), delimiter, F.lit("]*+)"))
    raw = F.regexp_extract_all(F.concat(delimiter, record), cell, F.lit(1))
    inside = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'
    open_ = lambda c: F.concat(F.replace(F.regexp_extract(c, inside, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, inside, 2))
    return F.transform(raw, lambda c: strip(F.when(c.startswith('"'), open_(c)).otherwise(c)))


def csv_records(text: Column, delimiter: Column) -> Column:
    """The records of a delimited text: line breaks and delimiters within quotes don't end a cell."""
    plain = F.concat(F.lit("[^"), delimiter, F.lit("\n]*+"))
    cell = F.concat(F.lit("(?:" + QUOTED), plain, F.lit("|"), plain, F.lit(")"))
    return F.regexp_extract_all(text, F.concat(F.lit("("), cell, F.lit("(?:["), delimiter, F.lit("]"), cell, F.lit(")*+)" + RECORD_TAIL)), F.lit(1))


def read_csv_diag(files: DataFrame, text_col: str = "text", first_lines: int | None = None) -> DataFrame:
    """A row for each data row of each delimited file: row_no, fields (bag), n_cells, expected, malformed.

    Cells may be quoted: then they hold delimiters, line breaks and doubled quotes; a quote elsewhere is a character. Cells
    are trimmed and coerced, blank rows and rows without any value go, rows of another width than the header have null
    fields and malformed true. A header name that comes twice gives its last cell. first_lines limits the lines that the
    delimiter is judged by. The file is one row, so its rows need no shuffle; null and empty files give none.
    """
    kept = without(files, text_col, "row_no", "fields", "n_cells", "expected", "malformed")
    names = [f"`{c}`" for c in kept.columns]
    text = F.regexp_replace(F.regexp_replace(files[text_col], "^﻿", ""), "\r\n?", "\n")
    cut = files.select(*[files[c] for c in names], text.alias("__text")).withColumn("__d", delimiter_score(non_blank_lines(F.col("__text")), first_lines)["delimiter"])
    rows = F.filter(F.transform(csv_records(F.col("__text"), F.col("__d")), lambda r: _csv_cells(r, F.col("__d"))), lambda c: F.exists(c, lambda x: x != ""))
    cut = cut.select(*names, F.inline(F.array(F.struct(rows.alias("__rows")))))
    header = F.get("__rows", 0)
    last = F.transform(header, lambda h, i: ~F.array_contains(F.slice(header, i + 2, F.size(header)), h))
    cut = cut.select(*names, header.alias("__h"), last.alias("__last"), F.posexplode(F.slice("__rows", F.lit(2), F.greatest(F.size("__rows") - 1, F.lit(0)))).alias("__p", "__c"))
    fits = F.size("__c") == F.size("__h")
    only = lambda cells: F.filter(cells, lambda x, i: F.get("__last", i))
    made = F.when(fits, F.map_from_arrays(only(F.col("__h")), F.transform(only(F.col("__c")), lambda v: F.when(v != "", coerce_text(v)))))
    return cut.select(*names, (F.col("__p") + 2).alias("row_no"), made.alias("fields"), F.size("__c").alias("n_cells"), F.size("__h").alias("expected"), (~fits).alias("malformed"))


def where_equals(rows: DataFrame, field: str, value: str, bag: str = "fields") -> DataFrame:
    return rows.where(F.col(bag)[field] == value)


def common_fields(rows: DataFrame, by: str, bag: str = "fields", least: float = 0.5) -> DataFrame:
    """(by, field, n, rows): fields that at least this share of a group's rows have; a null value counts."""
    totals = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    seen = rows.select(by, F.explode(F.map_keys(bag)).alias("field")).groupBy(by, "field").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(totals, by).where(F.col("n") >= least * F.col("rows"))


def detect_discriminator(rows: DataFrame, by: str, bag: str = "fields") -> DataFrame:
    """(by, discriminator): the first candidate field that enough rows fill, with 2 to 10 different values."""
    pick = [F.col(bag)[f] for f in vocab.DISCRIMINATORS]
    counts = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(present(c)).alias(f"n_{f}") for f, c in zip(vocab.DISCRIMINATORS, pick)],
        *[F.count_distinct(F.when(present(c), c)).alias(f"d_{f}") for f, c in zip(vocab.DISCRIMINATORS, pick)],
    )
    enough = F.greatest(F.lit(3), F.floor(F.col("rows") / 2))
    found = F.coalesce(*[F.when((F.col(f"n_{f}") >= enough) & F.col(f"d_{f}").between(2, 10), f) for f in vocab.DISCRIMINATORS])
    return counts.select(by, found.alias("discriminator")).where("discriminator is not null")


def split_by_discriminator(rows: DataFrame, by: str, bag: str = "fields", most: int | None = None) -> DataFrame:
    """(by, record_type, field, rank, n): for each value of the discriminator a group "<value>_event" and its common
    fields, preferred ones first; `most` limits them."""
    met = rows.join(detect_discriminator(rows, by, bag), by)
    value = F.coalesce(*[F.when(F.col("discriminator") == f, F.col(bag)[f]) for f in vocab.DISCRIMINATORS])
    grouped = met.withColumn("__g", F.struct(F.col(by).alias("by"), F.concat(value, F.lit("_event")).alias("record_type"))).where(present(value))
    common = common_fields(grouped, "__g", bag)
    preferred = {f: k for k, f in enumerate(vocab.SPLIT_PREFERRED_HEAD + vocab.DISCRIMINATORS + vocab.SPLIT_PREFERRED_TAIL)}
    place = F.coalesce(*[F.when(F.col("field") == f, k) for f, k in preferred.items()], F.lit(len(preferred)))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy(place, "field"))
    made = common.withColumn("rank", rank).select(F.col("__g.by").alias(by), F.col("__g.record_type").alias("record_type"), "field", "rank", "n")
    return made if most is None else made.where(F.col("rank") <= most)


def sensor_csv_detect(rows: DataFrame, by: str, bag: str = "fields") -> DataFrame:
    """(by, is_sensor_table, columns): whether a table is sensor-shaped, and the columns to keep."""
    wanted = vocab.SENSOR_TABLE_COLUMNS + vocab.SENSOR_TABLE_OPTIONAL
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(present(F.col(bag)[c])).alias(f"n_{c}") for c in wanted])
    enough = F.greatest(F.lit(3.0), 0.7 * F.col("rows"))
    shaped = F.lit(True)
    for c in vocab.SENSOR_TABLE_REQUIRED + ["value"]:
        shaped = shaped & (F.col(f"n_{c}") >= enough)
    kept = F.array_compact(F.array(*[F.lit(c) for c in vocab.SENSOR_TABLE_COLUMNS], *[F.when(F.col(f"n_{c}") >= 0.5 * F.col("rows"), c) for c in vocab.SENSOR_TABLE_OPTIONAL]))
    return counts.select(by, shaped.alias("is_sensor_table"), F.when(shaped, kept).alias("columns"))


def generic_json_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with item_no (from 1) and item (JSON text): the items of a list, of an object's only list of objects, or
    the document itself. Invalid JSON gives no row."""
    v = F.try_parse_json(F.col(text_col))
    kind = F.schema_of_variant(v)
    top = F.json_object_keys(F.col(text_col))
    lists = F.filter(F.transform(top, lambda k: F.call_function("get_json_object", F.col(text_col), F.concat(F.lit("$['"), k, F.lit("']")))), lambda x: x.rlike(r"^\s*\[\s*\{"))
    listed = F.when(kind.startswith("ARRAY"), F.col(text_col)).when(F.size(lists) == 1, F.get(lists, 0))
    items = F.when(listed.isNotNull(), F.transform(F.from_json(listed, "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(F.to_json(v)))
    names = [c for c in docs.columns if c != text_col]
    return docs.where(v.isNotNull()).select(*names, F.posexplode(items).alias("__p", "item")).select(*names, (F.col("__p") + 1).alias("item_no"), "item")


def hex_text_to_bytes(text: Column) -> Column:
    """Bytes of a hex text: Intel HEX where half of the lines or more start with a colon (data up to the end record),
    else a plain dump of digits."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda x: x != "")
    records = F.filter(lines, lambda x: x.startswith(":"))
    end = F.array_position(F.transform(records, lambda x: F.substr(x, F.lit(8), F.lit(2))), "01")
    before = F.when(end > 0, F.slice(records, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(records)
    data = F.transform(F.filter(before, lambda x: F.substr(x, F.lit(8), F.lit(2)) == "00"),
                       lambda x: F.substr(x, F.lit(10), 2 * F.conv(F.substr(x, F.lit(2), F.lit(2)), 16, 10).cast("int")))
    intel = 2 * F.size(records) >= F.size(lines)
    return F.unhex(F.when(intel & (F.size(records) > 0), F.array_join(data, "")).otherwise(F.regexp_replace(text, "[^0-9A-Fa-f]", "")))


def binary_preview(content: Column, n: int = 64) -> Column:
    """struct(n_bytes, hex, text) of the first bytes; bytes that can't be printed are dots."""
    head = F.substring(content, 1, n)
    return F.struct(F.octet_length(content).alias("n_bytes"), F.lower(F.hex(head)).alias("hex"), F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\x20-\x7E]", ".").alias("text"))


def _pairs(payload: Column) -> Column:
    """The bag of k=v;k=v; of a repeated key the last counts, a part without = has a null value."""
    parts = F.filter(F.split(payload, ";"), lambda p: p != "")
    return last_of(F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(p.contains("="), F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("value"))))


def tlv_records(content: Column) -> Column:
    """Records of a tagged container as an array of struct(record_no, record_type, fields); null without the magic.

    Header: magic, version, flags, count (16-bit, low byte first). Record: type, length (16-bit), pairs k=v;k=v.
    A truncated record ends the list; of a key that a record repeats the last value counts.
    """
    digits = F.hex(content)
    number = lambda at, n: F.conv(F.substr(digits, 2 * at + 1, F.lit(2 * n)), 16, 10).cast("int")
    low_high = lambda at: number(at, 1) + 256 * number(at + 1, 1)
    size = F.octet_length(content)
    start = F.struct(F.lit(8).alias("at"), F.array().cast("array<struct<record_no:int,kind:int,payload:string>>").alias("found"))

    def step(acc: Column, k: Column) -> Column:
        at = acc["at"]
        length = F.when(at + 3 <= size, low_high(at + 1))
        whole = F.coalesce(at + 3 + length <= size, F.lit(False))
        payload = F.decode(F.unhex(F.substr(digits, 2 * (at + 3) + 1, 2 * length)), "UTF-8")
        one = F.struct(k.cast("int").alias("record_no"), number(at, 1).alias("kind"), payload.alias("payload"))
        return F.struct(F.when(whole, at + 3 + length).otherwise(size + 1).alias("at"), F.when(whole, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    count = F.when((size >= 8) & (F.substr(digits, F.lit(1), F.lit(8)) == F.lit(vocab.TLV_MAGIC.encode().hex().upper())), low_high(F.lit(6)))
    numbers = F.when(count > 0, F.sequence(F.lit(1), count)).when(count == 0, F.array().cast("array<int>"))
    found = F.aggregate(numbers, start, step, lambda acc: acc["found"])
    kinds = F.create_map(*[F.lit(x) for kv in vocab.TLV_TYPES.items() for x in kv])
    return F.transform(found, lambda r: F.struct(r["record_no"].alias("record_no"), F.coalesce(kinds[r["kind"]], F.lit("unknown")).alias("record_type"), _pairs(r["payload"]).alias("fields")))


def tlv_fill_in(record_type: Column, fields: Column) -> Column:
    """fields of a tagged record with absent standard names copied from its type's own keys, in order."""
    rules = [(kind, target, source) for kind, pairs in vocab.TLV_FILL_INS.items() for target, source in pairs]
    wanted = F.array(*[
        F.struct(F.lit(t).alias("key"), F.when((record_type == kind) & ~F.map_contains_key(fields, F.lit(t)), fields[s]).alias("value")) for kind, t, s in rules
    ])
    return F.map_concat(fields, first_of(F.filter(wanted, lambda e: e["value"].isNotNull())))
