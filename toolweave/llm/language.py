"""Language identification by Bayesian evidence fusion.

Text: a naive Bayes model over hashed 3-byte pieces of the letters of a text gives a log-likelihood for each language.
It is trained on labelled rows, about SAMPLE per language, chosen by a hash of the id (the bound is a parameter). A
fixed share of each model is even over all slots, so an unseen piece says the same under every language, however much
text the language was trained on.
Declared language: how often each declared value, cut to its primary tag, goes with each language, counted over all
rows. Every tag declared is a language with a model of its own.
Host and address suffix: how often each language occurs on a host, shrunk towards its suffix, shrunk towards all rows;
also counted over all rows. The log evidences are added and normalised.

A row is rejected (kept = false, language 'und') when its text has no letters, when its letters are closer to an even
distribution of pieces than to any known language, or when no language reaches LEAST of the posterior. Without any labelled row there
is no model: rows with letters are kept as 'und'. Null texts have no letters; a null or blank declared value is no evidence;
rows without a host share one. Repeated rows are judged alike and all count in the priors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import fingerprint, small_batches, table, utf8, written

SAMPLE = 1000
AT_ONCE = 200  # models held at a time
SLOTS = 1 << 16
UNIFORM = 0.1  # share of the even distribution over slots in each model
TEMPER = 0.25  # pieces overlap, so their evidence is not independent
FLOOR = -math.log(SLOTS)  # mean log-likelihood of a piece under the even distribution
LEAST = 0.5
PRIOR_ROWS = 20.0  # weight of the level above, in rows
CHUNK = 4 << 20

LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(data: bytes):
    """Slots of the 3-byte pieces of a text's letters (a piece has at most one space)."""
    import numpy as np

    x = np.frombuffer(b" " + b" ".join(data.translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(x) < 4:
        return np.empty(0, np.uint32)
    return (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def primary_tag(declared: Column) -> Column:
    """The language of a declared value: en for EN, en-US, en_us and en_US.UTF-8. Values of another form stay whole, in
    lower case (i-klingon); blank ones are null."""
    low = F.lower(F.regexp_replace(declared, r"^\s+|\s+$", ""))
    return F.nullif(F.regexp_replace(low, r"(?s)^([a-z]{2,8})[-_.@].*$", "$1"), F.lit(""))


def languages_of(docs: DataFrame, label_col: str) -> list[tuple[str, int]]:
    """All languages declared and their counts, by name."""
    found = docs.groupBy(primary_tag(F.col(label_col)).alias("l")).count().where("l is not null").collect()
    return sorted((r["l"], r["count"]) for r in found)


def train(docs: DataFrame, languages: list[tuple[str, int]], id_col: str, text_col: str, label_col: str, sample: int = SAMPLE):
    """Log-probabilities, languages by slots, of a sample of about `sample` rows of each language."""
    import numpy as np

    names = [n for n, _ in languages]
    share = F.element_at(F.create_map(*[F.lit(x) for n, c in languages for x in (n, min(1.0, sample / c))]), F.col("l"))
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    tagged = docs.select(primary_tag(F.col(label_col)).alias("l"), F.col(text_col).alias("t"), chance.alias("c"))
    rows = tagged.where(F.col("l").isin(names)).where(F.col("c") < share).select("l", "t")

    def count(batches):
        import pyarrow as pa

        sums = np.zeros((len(names), SLOTS), np.int64)
        at = {n: i for i, n in enumerate(names)}
        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if data:
                    sums[at[label]] += np.bincount(pieces(data), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["counts"])

    sums = np.zeros((len(names), SLOTS), np.int64)
    for row in rows.repartition(4).mapInArrow(count, "counts binary").collect():
        sums += np.frombuffer(row["counts"], np.int64).reshape(sums.shape)
    seen = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1)
    return np.log((1 - UNIFORM) * seen + UNIFORM / SLOTS).astype(np.float32)


def likelihoods(spark: SparkSession, model) -> "object":
    """A function of a text column: struct(pieces, lls), lls by language; the model is of fixed size (SLOTS a language)."""
    held = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("pieces", T.LongType()), T.StructField("lls", T.ArrayType(T.DoubleType()))])

    @F.arrow_udf(kind)
    def score(text):
        import numpy as np
        import pyarrow as pa

        model = held.value
        counts, sums = [], []
        for data in utf8(text):
            slots = pieces(data) if data else []
            counts.append(len(slots))
            total = np.zeros(len(model))
            for a in range(0, len(slots), CHUNK):
                part = slots[a : a + CHUNK]
                total += [row[part].sum(dtype=np.float64) for row in model]
            sums.append(total)
        flat = np.concatenate(sums) if sums else np.empty(0)
        offsets = np.arange(len(counts) + 1, dtype=np.int32) * len(model)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["pieces", "lls"])

    return score


def scored_by_all(base: DataFrame, docs: DataFrame, languages: list[tuple[str, int]], id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """base (text) with pieces and lls instead of the text. More than AT_ONCE languages are trained and scored in blocks,
    and texts are written once more between two blocks."""
    spark = base.sparkSession
    made = base.withColumn("lls", F.array().cast("array<double>"))
    for at in range(0, len(languages), AT_ONCE):
        if at:
            made = written(made.drop("pieces"), f"likelihoods_{at}")
        score = likelihoods(spark, train(docs, languages[at : at + AT_ONCE], id_col, text_col, label_col, sample))
        kept = [c for c in base.columns if c != "text" or at + AT_ONCE < len(languages)]
        made = made.withColumn("s", score("text")).select(*kept, F.col("s.pieces").alias("pieces"), F.concat("lls", "s.lls").alias("lls"))
    return made


def suffix_of(host: Column) -> Column:
    """The part of a host after its last dot, or empty."""
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def _counted(rows: DataFrame, key: str, size: int) -> DataFrame:
    """By key, an array of how many rows each language has."""
    return rows.groupBy(key).agg(F.array(*[F.count(F.when(F.col("guess") == k, 1)).cast("double") for k in range(size)]).alias(f"{key}_counts"))


def _shrunk(counts: Column, above: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda c, p: (c + PRIOR_ROWS * p) / (total + PRIOR_ROWS))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source",
             sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """(doc, print, language, confidence, text_language, declared, kept) for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    languages = languages_of(docs, declared_col)
    print_ = fingerprint(text_col).alias("print")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc"), print_, F.col(text_col).alias("text"),
        F.col(declared_col).alias("declared"), primary_tag(F.col(declared_col)).alias("tag"), F.lower(F.coalesce(F.col(host_col), F.lit(""))).alias("host"),
    )
    if not languages:
        letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return base.select("doc", "print", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"),
                           F.lit(None).cast("string").alias("text_language"), "declared", letters.alias("kept"))
    names = [n for n, _ in languages]
    size = len(names)
    known = F.array(*[F.lit(n) for n in names])
    scored = scored_by_all(base, docs, languages, id_col, text_col, declared_col, sample).withColumn("suffix", suffix_of(F.col("host")))
    scored = scored.withColumn("guess", F.when(F.col("pieces") > 0, F.array_position("lls", F.array_max("lls")).cast("int") - 1))
    scored = written(scored, "likelihoods")

    seen = scored.where("guess is not null")
    totals = dict(map(tuple, seen.groupBy("guess").count().collect()))  # a row a language at most
    counts = [float(totals.get(k, 0)) for k in range(size)]
    overall = F.array(*[F.lit((c + 1) / (sum(counts) + size)) for c in counts])
    by_language = F.array(*[F.lit(c) for c in counts])
    hosts = _counted(seen, "host", size).withColumn("suffix", suffix_of(F.col("host")))
    hosts = hosts.join(_counted(seen, "suffix", size), "suffix").select(
        "host", _shrunk(F.col("host_counts"), _shrunk(F.col("suffix_counts"), overall)).alias("host_prior")
    )
    declared = _counted(seen.where("tag is not null"), "tag", size)
    share = F.aggregate("tag_counts", F.lit(0.0), lambda a, x: a + x) / max(1.0, sum(counts))
    declared = declared.select(
        "tag", F.zip_with("tag_counts", by_language, lambda c, n: (c + PRIOR_ROWS * share) / (n + PRIOR_ROWS)).alias("declared_given")
    )
    met = scored.join(hosts, "host", "left").join(declared, "tag", "left")
    prior = F.coalesce("host_prior", overall)
    given = F.coalesce("declared_given", F.array(*[F.lit(1.0)] * size))
    logs = F.zip_with(F.zip_with(F.transform("lls", lambda x: x * TEMPER), prior, lambda x, p: x + F.log(p)), given, lambda x, p: x + F.log(p))
    fused = met.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    best = F.array_position("logs", F.col("top")).cast("int")
    confidence = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    mean = F.array_max("lls") / F.col("pieces")
    kept = F.coalesce((F.col("pieces") > 0) & (mean >= FLOOR) & (confidence >= least), F.lit(False))
    return fused.select(
        "doc", "print", F.when(kept, F.element_at(known, best)).otherwise("und").alias("language"),
        F.round(F.when(F.col("pieces") > 0, confidence).otherwise(0.0), 6).alias("confidence"),
        F.element_at(known, F.col("guess") + 1).alias("text_language"), "declared", kept.alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "language", "confidence", "text_language", "declared", "kept")
