"""Prose logs: chunks of text, and observations extracted from them (which enter as a table)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.maps import first_of, has_any, literal_map
from ..functions.text import strip


def chunk_text(docs: DataFrame, text_col: str = "text", most: int = vocab.CHUNK_CHARS) -> DataFrame:
    """docs with chunk_id (from 1) and chunk: paragraphs, long ones packed from whole sentences.

    A sentence longer than the limit stays whole. Texts without a word give no row.
    """
    blocks = F.filter(F.transform(F.split(F.col(text_col), r"\n\s*\n+"), strip), lambda x: x != "")

    def pack(block: Column) -> Column:
        parts = F.filter(F.transform(F.split(block, r"(?<=[.!?])\s+"), strip), lambda x: x != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def add(acc: Column, s: Column) -> Column:
            joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
            fits = (acc["open"] == "") | (F.length(acc["open"]) + 1 + F.length(s) <= most)
            return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(s).alias("open"))

        packed = F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
        return F.when(F.length(block) <= most, F.array(block)).otherwise(packed)

    names = [c for c in docs.columns if c != text_col]
    made = docs.select(*names, F.posexplode(F.flatten(F.transform(blocks, pack))).alias("__p", "chunk"))
    return made.select(*names, (F.col("__p") + 1).alias("chunk_id"), "chunk")


def rename_fields(data: Column) -> Column:
    """data under the standard names; of two keys that become one the first stays."""
    names = literal_map(vocab.OBSERVATION_RENAMES)
    return first_of(F.transform(F.map_entries(data), lambda e: F.struct(F.coalesce(names[e["key"]], e["key"]).alias("key"), e["value"].alias("value"))))


def validate_observations(observations: DataFrame) -> DataFrame:
    """Observations with a known coarse type, a confidence in [0, 1], evidence and data; adds final_type, renames
    fields, and turns those that lack every field of their type into uncertain ones without a final type."""
    coarse, confidence = F.col("coarse_type"), F.col("confidence").cast("double")
    ok = coarse.isin(*vocab.FINAL_OF_COARSE) & confidence.between(0.0, 1.0) & (strip(F.col("evidence_text")) != "") & (F.size("data") > 0)
    kept = observations.where(ok).withColumn("data", rename_fields(F.col("data")))
    final = literal_map({k: v for k, v in vocab.FINAL_OF_COARSE.items() if v})[coarse]
    enough = F.coalesce(*[F.when(final == t, has_any(F.col("data"), keys)) for t, keys in vocab.OBSERVATION_MINIMUMS.items()], F.lit(True))
    return kept.withColumns({
        "final_type": F.when(enough, final),
        "uncertain": F.coalesce("uncertain", F.lit(False)) | ~enough,
        "confidence": F.round(confidence, 3),
        "evidence_text": strip(F.col("evidence_text")),
    })


def keep_filter(observations: DataFrame) -> DataFrame:
    """Confident observations with enough to say."""
    n, coarse = F.size("data"), F.col("coarse_type")
    thin = F.forall(F.map_keys("data"), lambda k: k.isin("parameter", "action"))
    weak = (
        F.col("uncertain") & (n < 2)
        | (coarse == "generic_operational_observation") & (n < 2) & (F.col("confidence") < 0.95)
        | (coarse == "configuration_or_recipe") & thin
        | (F.coalesce("subtype", F.lit("")) == "log_header_metadata") & (n < 3)
    )
    return observations.where((F.col("confidence") >= 0.80) & (n > 0) & ~weak)


def dedupe_observations(observations: DataFrame, order: str, file_col: str = "file_id") -> DataFrame:
    """One of the rows with equal file, reference, type, subtype and data: the one of the smallest order."""
    rest = [c for c in observations.columns if c not in (file_col, "source_reference", "final_type", "subtype")]
    same = observations.withColumn("__d", F.to_json(F.array_sort(F.map_entries("data"))))
    first = same.groupBy(file_col, "source_reference", "final_type", "subtype", "__d").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(*[F.col(c) if c not in rest else F.col(f"r.{c}").alias(c) for c in observations.columns])


def finalize_type(observations: DataFrame) -> DataFrame:
    return observations.withColumn("final_type", F.coalesce("final_type", F.lit("generic_operational_observation")))


def promote_generic(observations: DataFrame) -> DataFrame:
    """Generic observations with a field of their coarse type's kind become that type; states and values are filled in."""
    data, generic = F.col("data"), F.col("final_type") == "generic_operational_observation"
    to = F.coalesce(*[F.when(generic & (F.col("coarse_type") == c) & has_any(data, keys), t) for c, (t, keys) in vocab.PROMOTIONS.items()])
    state = F.coalesce(*[data[k] for k in vocab.PROMOTED_STATE_SOURCES])
    value = F.coalesce(*[data[k] for k, _ in vocab.PROMOTED_VALUE_SOURCES])
    unit = F.coalesce(*[F.when(data[k].isNotNull(), F.lit(u)) for k, u in vocab.PROMOTED_VALUE_SOURCES if u])
    fills = F.array(*[
        F.struct(F.lit(k).alias("key"), F.when((to == t) & ~F.map_contains_key(data, F.lit(k)), v).alias("value"))
        for t, k, v in (("equipment_state", "curr_state", state), ("sensor_reading", "value", value), ("sensor_reading", "unit", unit), ("sensor_reading", "parameter", data["measurement_name"]))
    ])
    added = F.map_from_entries(F.filter(fills, lambda e: e["value"].isNotNull()))
    return observations.withColumns({"data": F.when(to.isNotNull(), F.map_concat(data, added)).otherwise(data), "final_type": F.coalesce(to, F.col("final_type"))})


def overlap(a: dict, b: dict, groups=vocab.MERGE_IDENTITIES) -> int:
    """In how many identity groups two observations name the same thing."""
    said = lambda d, keys: next((d[k] for k in keys if d.get(k) not in (None, "", "[]", "{}")), None)
    return sum(said(a, keys) is not None and said(a, keys) == said(b, keys) for keys in groups)


def joined_evidence(a: str | None, b: str | None) -> str:
    a, b = (a or "").strip(), (b or "").strip()
    return a if b in a else b if a in b else f"{a} | {b}"


def _take_in(host: dict, guest: dict) -> None:
    """The host keeps its own values and gains what only the guest says."""
    host["data"] = {**dict(guest["data"] or {}), **dict(host["data"] or {})}
    host["evidence_text"] = joined_evidence(host["evidence_text"], guest["evidence_text"])
    host["confidence"] = max(host["confidence"], guest["confidence"])


def _by_chunk(observations: DataFrame, keys: list[str], order: str, fold) -> DataFrame:
    """fold(rows in order) for each group, of what one chunk of one file gave. Groups come one after another in a stream of
    rows sorted by Spark; a task holds one group and the rows of one batch at a time. Null keys are a group."""

    def run(batches):
        import pyarrow as pa

        held, now, out, schema = [], None, [], None

        def made():
            columns = [pa.array([list(v.items()) if isinstance(v := r[f.name], dict) else v for r in out], f.type) for f in schema]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            schema = schema or batch.schema
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if held and key != now:
                    out += fold(held)
                    held = []
                now = key
                held.append(row)
            if len(out) >= batch.num_rows:
                yield made()
                out.clear()
        if held:
            out += fold(held)
        if out:
            yield made()

    return observations.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, observations.schema)


def merge_same_chunk(observations: DataFrame, order: str, reference: str = "source_reference", file_col: str = "file_id") -> DataFrame:
    """Within a file's chunk, coarse and final type, observations that share an identity become one: each joins the first one
    before it that it overlaps with. The order is a column, so reruns agree."""

    def fold(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for row in rows:
            host = next((k for k in kept if overlap(dict(k["data"] or {}), dict(row["data"] or {}))), None)
            if host is None:
                kept.append(row)
            else:
                _take_in(host, row)
                host["extra"] = {**dict(row["extra"] or {}), **dict(host["extra"] or {})}
        return kept

    return _by_chunk(observations, [file_col, reference, "coarse_type", "final_type"], order, fold)


# The final type that an observation of a coarse type may be absorbed by; generic ones fit all of them.
ABSORBED_BY = {k: v for k, v in vocab.FINAL_OF_COARSE.items() if v}


def _absorb(observations: DataFrame, order: str, file_col: str, reference: str, least: int, groups, generic_fits: bool, boost: int, leave_out: bool) -> DataFrame:
    def score(anchor: dict, row: dict) -> int:
        coarse = row["coarse_type"]
        family = ABSORBED_BY.get(coarse) == anchor["final_type"]
        if not family and not (generic_fits and coarse == "generic_operational_observation" and anchor["final_type"] in vocab.OBSERVATION_MINIMUMS):
            return -1
        shared = overlap(dict(anchor["data"] or {}), dict(row["data"] or {}), groups)
        return shared + 2 * family + boost * (shared >= 1)

    def fold(rows: list[dict]) -> list[dict]:
        concrete = [r for r in rows if r["final_type"]]
        rest = []
        for row in rows:
            if row["final_type"]:
                continue
            alone = leave_out and any(w in (row["subtype"] or "") for w in vocab.NEVER_ABSORBED)
            best = max(concrete, key=lambda a: score(a, row), default=None)  # the first of equals
            if alone or best is None or score(best, row) < least:
                rest.append(row)
                continue
            extra = dict(best["extra"] or {})
            taken = json.loads(extra.get("absorbed_observations") or "[]")
            taken.append({k: row[k] for k in ("coarse_type", "subtype", "confidence", "evidence_text")} | {"data": dict(row["data"] or {}), "uncertain": bool(row["uncertain"])})
            best["extra"] = {**extra, "absorbed_observations": json.dumps(taken)}
            _take_in(best, row)
        return concrete + rest

    return _by_chunk(observations, [file_col, reference], order, fold)


def absorb_generic(observations: DataFrame, order: str, reference: str = "source_reference", file_col: str = "file_id") -> DataFrame:
    """Observations without a final type go into the best fitting one of their file's chunk (score 3 or more)."""
    return _absorb(observations, order, file_col, reference, 3, vocab.MERGE_IDENTITIES, True, 1, True)


def condense(observations: DataFrame, order: str, reference: str = "source_reference", file_col: str = "file_id") -> DataFrame:
    """The same among finalized observations (score 2 or more); of what is left over only headers, summaries and strong
    statements stay."""
    generic = "generic_operational_observation"
    opened = observations.withColumn("final_type", F.when(F.col("final_type") != generic, F.col("final_type")))
    folded = finalize_type(_absorb(opened, order, file_col, reference, 2, vocab.CONDENSE_IDENTITIES, False, 0, False))
    n, c, sub = F.size("data"), F.col("confidence"), F.coalesce("subtype", F.lit(""))
    strong = (c >= 0.95) & (n >= 3) | (c >= 0.97) & (n >= 4) | sub.contains("header") | sub.contains("summary")
    return folded.where((F.col("final_type") != generic) | strong)
