"""Exact Jaccard self-join of documents on word shingles, by a grouped prefix join.

A document's set is its distinct word shingles, held as 64-bit hashes (two of n different shingles agree with a
chance of about n^2 / 2^65 in a pair of texts). Documents with one set form a class; classes whose prefix and size
agree form a group. Groups meet on the tokens of their prefixes, pairs of groups pass the size and position filters,
and then members are expanded and verified on their whole texts.

Order. The prefix filter holds under any order of tokens; here frequent tokens come last, the rest by hash. To find
them, the tokens that may enter a prefix are counted over all documents, and all tokens of texts that turn out to
consist of frequent ones (near copies in large groups); the list that is broadcast holds at most
HOT_TOKENS of the most frequent (8 bytes each). A shorter list would cost time, not results.

Whole links without all pairs. What the caller gets are components, so a pair inside one component needs no check.
Round 1 links every member with its group's first class, group pairs that meet on infrequent tokens with each other,
and groups that meet on a frequent token with three of them: the one where the token comes first in order (a text that
has no rare tokens, so the least edited copy) and two by hash. Round 2 verifies all pairs left that met and lie in
different components. Links found then complete the components: a pair that was never verified is either too far apart
or already connected. Large groups of near copies cost a few pairs per member.

Filters. Sizes: 100 min >= percent max. Position: of two sets of n and m tokens that first share one at places i and j,
at most min(n - i, m - j) tokens are shared. Count: tokens after a prefix number ceil(percent n / 100) - 1, so of the
tokens needed some must be shared inside the prefixes; frequent ones, which are not counted, get the benefit of doubt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import LOWER, UPPER, fingerprint, small_batches, space_words, table, utf8, without, written
from toolweave.llm.components import components

HOT_COUNT = 48  # a token of more documents is frequent
HOT_TOKENS = 4_000_000
BROADCAST_BYTES = 32 << 20
PART_TEXT = 256 << 20  # text whose tokens one part counts
PART_TOKENS = 4 << 20  # prefix tokens that meet in one part
HUBS = 3
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
OUTPUTS = ("n_shingles", "class_doc", "component_id")


def shingle_hashes(data: bytes | None, words: int):
    """Sorted distinct uint64 hashes of a text's shingles; a text of fewer words is one shingle, of none has none."""
    import numpy as np
    import xxhash

    tokens = space_words(data.translate(LOWER_TABLE)) if data else []
    if not tokens:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def prefix_length(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1 if n else 0  # n - ceil(percent n / 100) + 1


def _count_tokens(words: int, percent: int, parts: int, hot=None):
    """Sends the tokens that may enter a prefix, with their counts in the batch, as one packed row for each part.

    With hot, the frequent tokens found so far: sends all tokens of the texts that have more of those among the tokens
    that may enter than a prefix leaves room for, since their prefixes reach further.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            zones = []
            for data in utf8(batch.column(0)):
                h = shingle_hashes(data, words)
                zone = h[: 2 * prefix_length(len(h), percent)]
                if hot is None:
                    zones.append(zone)
                elif 2 * _among(zone, hot.value).sum() > len(zone):
                    zones.append(h)
            tokens, counts = np.unique(np.concatenate(zones or [np.empty(0, np.uint64)]), return_counts=True)
            part = tokens % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            tokens, counts, part = tokens[order], counts[order].astype(np.uint32), part[order]
            edges = np.flatnonzero(np.diff(part)) + 1
            bounds = list(zip([0, *edges.tolist()], [*edges.tolist(), len(tokens)])) if len(tokens) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[a]) for a, _ in bounds], pa.int64()),
                    pa.array([tokens[a:b].tobytes() for a, b in bounds], pa.binary()),
                    pa.array([counts[a:b].tobytes() if (counts[a:b] > 1).any() else None for a, b in bounds], pa.binary()),
                ],
                ["part", "tokens", "counts"],
            )

    return run


def _sum_tokens(least: int):
    """Tokens of more than `least` documents, part by part."""

    def summed(tokens: list, counts: list):
        import numpy as np

        t = np.concatenate(tokens)
        c = np.concatenate(counts)
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        return t[first], np.add.reduceat(c, first)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens, counts, size, whole = [], [], 0, 0
        for batch in batches:
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tokens.append(np.frombuffer(t, np.uint64))
                counts.append(np.frombuffer(c, np.uint32).astype(np.int64) if c else np.ones(len(tokens[-1]), np.int64))
                size += len(tokens[-1])
                if size > 2 * whole + 1_000_000:  # sum up what has come, so that a repeated token takes room once
                    t, c = summed(tokens, counts)
                    tokens, counts, size, whole = [t], [c], len(t), len(t)
        if tokens:
            t, c = summed(tokens, counts)
            often = c > least
            yield pa.RecordBatch.from_arrays([pa.array(t[often].view(np.int64)), pa.array(c[often])], ["token", "count"])

    return run


def _among(tokens, often):
    """Which tokens are in a sorted array."""
    import numpy as np

    if not len(often):
        return np.zeros(len(tokens), bool)
    return often[np.minimum(np.searchsorted(often, tokens), len(often) - 1)] == tokens


def hot_tokens(docs: DataFrame, text_col: str, words: int, percent: int, least: int = HOT_COUNT, most: int = HOT_TOKENS):
    """The frequent tokens, as a sorted uint64 array of at most `most`."""
    import numpy as np

    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(_parts(docs.sparkSession), -(-size // PART_TEXT))
    texts, found = docs.select(F.col(text_col).alias("text")), np.empty(0, np.uint64)
    for again in (False, True):
        hot = docs.sparkSession.sparkContext.broadcast(found) if again else None
        sent = texts.mapInArrow(_count_tokens(words, percent, parts, hot), "part long, tokens binary, counts binary")
        often = sent.repartition(parts, "part").mapInArrow(_sum_tokens(least), "token long, count long")
        more = often.orderBy(F.desc("count"), "token").limit(most - len(found)).select("token").toArrow()
        found = np.union1d(found, more.column(0).to_numpy().view(np.uint64))
        if not len(found) or len(found) >= most:
            break
    return found


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SET = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("pkey", T.BinaryType()),
        T.StructField("prefix", T.ArrayType(T.LongType(), False)),
    ]
)


def _sets(words: int, percent: int, hot):
    """Size, digest, prefix (frequent tokens last) and digest of prefix and size of each text's set."""

    @F.arrow_udf(SET)
    def sets(text):
        import numpy as np
        import pyarrow as pa
        import xxhash

        often = hot.value
        sizes, digests, keys, prefixes = [], [], [], []
        for data in utf8(text):
            h = shingle_hashes(data, words)
            n = len(h)
            is_hot = _among(h, often)
            ordered = np.concatenate([h[~is_hot], h[is_hot]]) if is_hot.any() else h
            prefix = ordered[: prefix_length(n, percent)]
            sizes.append(n)
            digests.append(xxhash.xxh3_128_digest(h.tobytes()) if n else None)
            keys.append(xxhash.xxh3_128_digest(prefix.tobytes() + n.to_bytes(8, "little")) if n else None)
            prefixes.append(prefix.view(np.int64))
        values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
        offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
            ["n", "digest", "pkey", "prefix"],
        )

    return sets


# Packed postings (blob), postings of frequent tokens (token, a: group, x: size, y: place), or pairs of groups
# (a, b, x: tokens shared, y: tokens needed).
POST = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "token", "a", "b", "x", "y")] + [T.StructField("blob", T.BinaryType())])


def _post_rows(count: int, **columns):
    import pyarrow as pa

    made = [pa.array(columns[f.name], pa.binary() if f.name == "blob" else pa.int64()) if f.name in columns else pa.nulls(count, pa.binary() if f.name == "blob" else pa.int64()) for f in POST]
    return pa.RecordBatch.from_arrays(made, names=POST.fieldNames())


def _post(parts: int, hot):
    """Sends each group's prefix tokens: frequent ones as rows (token, a: group), the rest packed by part."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        often, zip_ = hot.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            tokens = lists.flatten().to_numpy().view(np.uint64)
            groups = np.repeat(batch.column(0).to_numpy(), lengths)
            sizes = np.repeat(batch.column(1).to_numpy(), lengths)
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            is_hot = _among(tokens, often)
            if is_hot.any():
                t, g = tokens[is_hot].view(np.int64), groups[is_hot]
                yield _post_rows(len(t), part=(t ^ g) & 0x7FFFFFFF, token=t, a=g, x=sizes[is_hot], y=places[is_hot])
            tokens, groups, sizes, places = (x[~is_hot] for x in (tokens, groups, sizes, places))
            part = tokens % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            rows = [(int(part[o[0]]), zip_.compress(np.concatenate([tokens[o].view(np.int64), groups[o], sizes[o], places[o]]).astype(np.int64).tobytes()))
                    for o in np.split(order, edges) if len(o)]
            yield _post_rows(len(rows), part=[r[0] for r in rows], blob=[r[1] for r in rows])

    return run


def _meet(percent: int, most: int):
    """Pairs (a < b) of groups with the infrequent tokens of this part that they share; tokens of more than `most`
    groups go on as rows, like frequent ones."""

    def pairs(held: dict):
        import numpy as np

        keys = np.array(list(held), np.int64).reshape(-1, 2)
        values = np.array(list(held.values()), np.int64).reshape(-1, 2)
        return _post_rows(len(keys), a=keys[:, 0], b=keys[:, 1], x=values[:, 0], y=values[:, 1])

    def run(batches):
        import numpy as np
        import zstandard

        held = []
        unzip = zstandard.ZstdDecompressor()
        blob_at = POST.fieldNames().index("blob")
        for batch in batches:
            one = batch.filter(batch.column(blob_at).is_null())
            if one.num_rows:
                yield one
            for blob in batch.column(blob_at).drop_null().to_pylist():
                held.append(np.frombuffer(unzip.decompress(blob), np.int64).reshape(4, -1))
        if not held:
            return
        tokens, groups, sizes, places = np.concatenate(held, axis=1)
        held = None
        order = np.lexsort((groups, tokens))
        tokens = tokens[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        length = np.diff(np.r_[first, len(tokens)])
        met: dict = {}
        for at, k in zip(first[length > 1].tolist(), length[length > 1].tolist()):
            here = order[at : at + k]
            g, n = groups[here], sizes[here]
            if k > most:
                yield _post_rows(k, token=tokens[at : at + k], a=g, x=n, y=places[here])
                continue
            i, j = np.triu_indices(k, 1)
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            fits = 100 * small >= percent * large
            if fits.any():
                small, large = small[fits], large[fits]
                needed = -(-percent * (small + large) // (100 + percent)) - -(-percent * large // 100) + 1
                for a, b, c in zip(g[i[fits]].tolist(), g[j[fits]].tolist(), needed.tolist()):
                    if (a, b) in met:
                        met[a, b][0] += 1
                    else:
                        met[a, b] = [1, c]
                if len(met) >= 500_000:
                    yield pairs(met)
                    met = {}
        yield pairs(met)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (u, v) of classes, those that link. texts: (cid, text)."""

    @F.arrow_udf(T.BooleanType())
    def links(a, b):
        import numpy as np
        import pyarrow as pa

        out, last, x = [], None, None
        for s, t in zip(utf8(a), utf8(b)):
            if s != last:
                last, x = s, shingle_hashes(s, words)
            y = shingle_hashes(t, words)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    left = texts.select(F.col("cid").alias("u"), F.col("text").alias("__s"))
    right = texts.select(F.col("cid").alias("v"), F.col("text").alias("__t"))
    return pairs.join(left, "u").join(right, "v").where(links("__s", "__t")).select("u", "v")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """A row (doc, print, n_shingles, class_doc, component_id, root) for each row of docs.

    print is a fingerprint of the text, class_doc the smallest id with the same set, component_id the smallest id
    reachable by links. Null, empty and blank texts have no shingles and are linked with nothing: their component is
    their own id. Repeated rows stay. A null id is never the smallest; a component without any id has a null
    component_id. root numbers the components, also those that ids don't tell apart; null without shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hot = spark.sparkContext.broadcast(hot_tokens(docs, text_col, words, percent))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), fingerprint(text_col).alias("print"), F.col(text_col).alias("text"))
    sets = keyed.withColumn("s", _sets(words, percent, hot)("text")).select("doc", "print", "s.*")
    sets = written(sets, "sets")

    classes = written(
        sets.where("n > 0").groupBy("digest").agg(
            F.min(F.struct("doc", "print")).alias("first"), F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("pkey").alias("pkey"), F.first("prefix").alias("prefix")
        ).withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    groups = written(classes.groupBy("pkey").agg(F.min("cid").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("members")), "groups")
    members = classes.select("cid", "pkey").join(groups.where("members > 1").select("pkey", "gid"), "pkey", "left")
    members = written(members.select("cid", F.coalesce("gid", "cid").alias("gid")), "members")

    tokens = groups.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(_parts(spark), -(-tokens // PART_TOKENS))
    posted = groups.select("gid", "n", "prefix").mapInArrow(_post(parts, hot), POST).repartition(parts, "part")
    met = written(posted.mapInArrow(_meet(percent, HOT_COUNT), POST).drop("part", "blob"), "met")
    often = met.where("b is null").select("token", F.col("a").alias("gid"), F.col("x").alias("n"), F.col("y").alias("place"))
    uncounted = often.groupBy("gid").agg(F.count("*").alias("often"))
    near = met.where("b is not null").groupBy("a", "b").agg(F.sum("x").alias("shared"), F.first("y").alias("needed"))
    near = near.join(uncounted.withColumnsRenamed({"gid": "a", "often": "oa"}), "a", "left").join(uncounted.withColumnsRenamed({"gid": "b", "often": "ob"}), "b", "left")
    near = written(near.where("shared + least(coalesce(oa, 0), coalesce(ob, 0)) >= needed").select("a", "b"), "pairs")
    # Groups that meet on frequent tokens, told apart by size and place alone.
    shapes = written(often.groupBy("token", "n", "place").agg(F.min("gid").alias("gid")), "shapes")
    fit = _fit(percent)
    hubs = often.groupBy("token").agg(
        F.min(F.struct("place", "n", "gid")).alias("h0"), *[F.min(F.struct(F.xxhash64("gid", F.lit(k)), "place", "n", "gid")).alias(f"h{k}") for k in range(1, HUBS)]
    )
    hub = F.explode(F.array(*[F.struct(F.col(f"h{k}.gid").alias("gid"), F.col(f"h{k}.n").alias("n"), F.col(f"h{k}.place").alias("place")) for k in range(HUBS)]))
    stars = often.join(hubs.select("token", hub.alias("hub")), "token").where(F.col("gid") != F.col("hub.gid"))
    stars = stars.where(fit("n", "place", "hub.n", "hub.place")).select("gid", F.col("hub.gid").alias("hub")).distinct()

    def ordered(a: str, b: str):
        return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")

    round1 = members.where("cid <> gid").select(*ordered("cid", "gid")).unionByName(near.select(*ordered("a", "b"))).unionByName(stars.select(*ordered("gid", "hub")))
    round1 = written(round1.distinct(), "round1")
    texts = lambda pairs: _texts(keyed, classes, pairs)
    links = written(_verified(round1, texts(round1), words, percent), "links1")
    labels = written(components(links), "labels")

    # Round 2: members of groups that met, or of one group, in different components.
    own = written(members.join(labels, members.cid == labels.node, "left").select("cid", "gid", F.coalesce("root", "cid").alias("label")), "labelled")
    marks = own.select("gid", "label").distinct()
    side = lambda x: marks.select(F.col("gid").alias(x), F.col("label").alias(f"l{x}"))
    inner = side("a").join(marks.select(F.col("gid").alias("b"), F.col("label").alias("lb")), F.col("a") == F.col("b")).where("la < lb")
    apart = near.join(side("a"), "a").join(side("b"), "b").where("la <> lb").select("a", "la", "b", "lb")
    other = shapes.select("token", F.col("n").alias("m"), F.col("place").alias("spot"))
    fits = shapes.join(other, "token").where(fit("n", "place", "m", "spot")).where("n < m or n = m and place <= spot").select("token", "n", "place", "m", "spot")
    by_token = often.join(marks, "gid")
    mixed = by_token.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
    by_token = written(by_token.join(mixed, "token").select("token", "n", "place", "gid", "label"), "mixed")
    one = by_token.select("token", "n", "place", F.col("gid").alias("a"), F.col("label").alias("la"))
    two = by_token.select("token", F.col("n").alias("m"), F.col("place").alias("spot"), F.col("gid").alias("b"), F.col("label").alias("lb"))
    shared = fits.join(one, ["token", "n", "place"]).join(two, ["token", "m", "spot"]).where("la <> lb")
    cross = apart.unionByName(inner.select("a", "la", "b", "lb")).unionByName(shared.select("a", "la", "b", "lb")).distinct()
    left = own.select(F.col("gid").alias("a"), F.col("label").alias("la"), F.col("cid").alias("ca"))
    right = own.select(F.col("gid").alias("b"), F.col("label").alias("lb"), F.col("cid").alias("cb"))
    round2 = cross.join(left, ["a", "la"]).join(right, ["b", "lb"]).select(*ordered("ca", "cb")).distinct()
    size = classes.select("cid", "n")
    round2 = round2.join(size.select(F.col("cid").alias("u"), F.col("n").alias("nu")), "u").join(size.select(F.col("cid").alias("v"), F.col("n").alias("nv")), "v")
    round2 = round2.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v")
    round2 = written(round2.join(round1, ["u", "v"], "left_anti"), "round2")
    roots = labels
    if round2.limit(1).count():
        more = written(_verified(round2, texts(round2), words, percent), "links2")
        if more.limit(1).count():
            roots = components(more.unionByName(labels.select(F.col("node").alias("u"), F.col("root").alias("v"))))

    placed = classes.select("cid", "digest", "doc").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    placed = placed.join(lowest, "root").select("digest", F.col("doc").alias("class_doc"), "component_id", "root")
    return sets.join(placed, "digest", "left").select(
        "doc", "print", F.col("n").alias("n_shingles"), F.coalesce("class_doc", "doc").alias("class_doc"), F.coalesce("component_id", "doc").alias("component_id"), "root"
    )


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """docs with n_shingles, class_doc and component_id; see linked(). Columns named like these are replaced."""
    docs = without(docs, *(n for n in OUTPUTS if n not in (id_col, text_col)))
    names = docs.columns
    once = linked(docs, id_col, text_col, words, percent).groupBy("doc", "print").agg(*[F.min(c).alias(c) for c in OUTPUTS])
    keyed = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__print": fingerprint(text_col)})
    met = keyed.join(once, keyed["__doc"].eqNullSafe(once["doc"]) & keyed["__print"].eqNullSafe(once["print"]), "left")
    return met.select(*[keyed[f"`{c}`"] for c in names], *[once[c] for c in OUTPUTS])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose text is the first of its component (smallest id, then fingerprint); repeated rows go.

    Rows without shingles all stay, once each. What goes is found first; it reaches the documents by broadcast up to
    BROADCAST_BYTES, else by a join on the id.
    """
    rows = written(linked(docs, id_col, text_col, words, percent), "linked")
    first = rows.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "print")).alias("first"))
    gone = rows.where("n_shingles > 0").join(first, "root").where(
        ~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("print") == F.col("first.print")))
    )
    gone = written(gone.select("doc", "print").distinct(), "gone")
    if gone.count() * 32 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    keyed = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__print": fingerprint(text_col)})
    kept = keyed.join(gone, keyed["__doc"].eqNullSafe(gone["doc"]) & keyed["__print"].eqNullSafe(gone["print"]), "left_anti")
    if rows.groupBy("doc", "print").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["__doc", "__print"])
    return kept.drop("__doc", "__print")


def _fit(percent: int):
    """The size and position filters as a condition on the names of sizes and places."""

    def fit(n: str, i: str, m: str, j: str):
        n, i, m, j = (F.col(x) for x in (n, i, m, j))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))

    return fit


def _texts(keyed: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, text) of the classes in pairs."""
    needed = pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid"))).distinct()
    needed = written(classes.join(needed, "cid").select("cid", "first.doc", "first.print"), "needed")
    if needed.count() * 48 <= BROADCAST_BYTES:
        needed = F.broadcast(needed)
    met = keyed.join(needed, keyed["doc"].eqNullSafe(needed["doc"]) & keyed["print"].eqNullSafe(needed["print"])).select("cid", "text")
    return met.dropDuplicates(["cid"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linked(docs).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
lowest AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(l.low, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest l ON l.x = w.doc_id
"""
