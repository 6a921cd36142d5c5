"""Document fingerprints: one-permutation MinHash, natively in the JVM.

Each five-word shingle is hashed once. The top bits of the hash choose one of ``BINS``
bins, and a bin keeps its smallest hash. Empty bins are filled by optimal densification:
bin ``b`` probes the bins ``hash(b, 1), hash(b, 2), ...`` until one is filled; after
``PROBES`` misses it takes the filled bin with the smallest ``hash(b, bin)``, which is the
rest of the same random order read at once. The probes depend on bin numbers alone, so two
documents with the same filled bins borrow alike. Of each bin four bits of
``hash(value, b)`` are kept, packed sixteen to a long. Two unrelated bins agree with
probability 1/16, which ``likeness`` takes out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.native import let, sha256_hex

BINS = 256
BIN_BITS = 8
KEPT_BITS = 4
PROBES = 16
SHINGLE = 5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """One hash a shingle; a text of fewer than ``k`` words is one shingle, an empty one none."""

    def of(words: Column) -> Column:
        every = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]),
        )
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(every)

    return let(_words(text), of)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")


def _minima(hashes: Column) -> Column:
    """The smallest hash of each filled bin. Bins are contiguous in signed order."""
    return let(
        F.sort_array(hashes),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(s, i - 1), 64 - BIN_BITS))),
    )


def _dense(minima: Column) -> Column:
    """``BINS`` values, null where a bin is empty, in signed order of bin numbers."""
    half = BINS // 2

    def place(x: Column) -> Column:
        return (F.shiftright(x, 64 - BIN_BITS) + half).cast("int")

    def spread(m: Column) -> Column:
        gaps = F.transform(
            m,
            lambda x, i: F.concat(
                F.array_repeat(F.lit(None).cast("bigint"), place(x) - F.when(i == 0, F.lit(-1)).otherwise(place(F.get(m, i - 1))) - 1),
                F.array(x),
            ),
        )
        return F.concat(F.flatten(gaps), F.array_repeat(F.lit(None).cast("bigint"), BINS - 1 - place(F.element_at(m, -1))))

    return spread(minima)


def _packed(minima: Column) -> Column:
    """Densify, keep ``KEPT_BITS`` bits of each bin and pack them; empty for no shingles."""
    per_long = 64 // KEPT_BITS

    def pack(m: Column, dense: Column) -> Column:
        def value(b: Column) -> Column:
            probes = [F.get(dense, (F.xxhash64(b, F.lit(t)) % F.lit(BINS) + BINS).cast("int") % BINS) for t in range(1, PROBES + 1)]
            last = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(b, F.shiftright(x, 64 - BIN_BITS), F.lit(0)).alias("h"), x.alias("x"))))
            return F.coalesce(F.get(dense, b), *probes, last["x"])

        low = F.lit((1 << KEPT_BITS) - 1).cast("bigint")
        bits = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.xxhash64(value(b), b).bitwiseAND(low))
        return let(
            bits,
            lambda v: F.transform(
                F.sequence(F.lit(0), F.lit(BINS // per_long - 1)),
                lambda g: F.aggregate(F.slice(v, g * per_long + 1, per_long), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, KEPT_BITS).bitwiseOR(x)),
            ),
        )

    return let(
        minima,
        lambda m: F.when(F.size(m) == 0, F.array().cast("array<bigint>")).otherwise(let(_dense(m), lambda d: pack(m, d))),
    )


def fingerprint(text: Column) -> Column:
    """Packed fingerprint (array of longs) of a text column; empty array for no words or null."""
    return _packed(_minima(_shingle_hashes(text)))


def fingerprint_hex(packed: Column) -> Column:
    """The packed fingerprint as lower-case hex, one digit a bin; an empty text has ``''``."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of agreeing bins, in [0, 1]: an estimate of shingle Jaccard.

    Two empty fingerprints are alike (1), an empty and a filled one not (0).
    """
    ones = F.lit(0x1111111111111111).cast("bigint")

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(ones))

    n = F.aggregate(F.zip_with(a, b, differing), F.lit(0).cast("int"), lambda s, x: s + x)
    chance = 1.0 / (1 << KEPT_BITS)
    share = (1.0 - n / F.lit(float(BINS)) - chance) / (1.0 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    )


def _bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds below ``doc_id``, found at two levels; null ids go to bucket -1."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[step - 1 :: step]
    fine = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    n_coarse = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in coarse]), lambda b: b < doc_id))
    found = let(n_coarse, lambda c: c * step + F.size(F.filter(F.slice(fine, c * step + 1, step), lambda b: b < doc_id)))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(found)


def _with_next(rows: DataFrame) -> DataFrame:
    """Adds ``next_text`` and ``next_fp``: of the following row in descending doc_id.

    Order: doc_id descending, nulls last, then text. Rows are dealt to buckets of ids by
    quantile, so that each bucket is one bounded stretch of the order; the first row of
    each bucket, a few small rows, closes the gap to the bucket before.
    """
    spark = rows.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = rows.select(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], 20 * n).alias("q")).first()["q"]
    bounds = sorted(set(cuts or []))
    dealt = rows.withColumn("bucket", _bucket_of(F.col("doc_id"), bounds) if bounds else F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    w = Window.partitionBy("bucket").orderBy(*order)
    led = dealt.withColumn("fp", fingerprint(F.col("text"))).withColumn("after", F.lead(F.struct("text", "fp")).over(w))

    top = dealt.groupBy("bucket").agg(F.max("doc_id").alias("top_id"))
    heads = (
        dealt.join(F.broadcast(top), (dealt["bucket"] == top["bucket"]) & dealt["doc_id"].eqNullSafe(top["top_id"]), "left_semi")
        .groupBy("bucket")
        .agg(F.min("text").alias("text"))
    )
    # The bucket that follows in descending order; the last one is followed by the first.
    seam = Window.orderBy(F.col("bucket").desc())
    whole = Window.partitionBy(F.lit(1))
    heads = heads.select(
        "bucket",
        F.coalesce(F.lead("text").over(seam), F.max_by("text", "bucket").over(whole)).alias("head_text"),
    ).withColumn("head_fp", fingerprint(F.col("head_text")))
    joined = led.join(heads, "bucket", "left")
    return joined.select(
        "doc_id",
        "text",
        "fp",
        F.coalesce(F.col("after.text"), F.col("head_text")).alias("next_text"),
        F.when(F.col("after").isNotNull(), F.col("after.fp")).otherwise(F.col("head_fp")).alias("next_fp"),
    )


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text (see the contract of ``op1``).

    Nulls count as empty texts; null doc_ids come last in the order; repeated ids are
    ordered by text. An empty table gives an empty result. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = F.length("text").cast("bigint")
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    made = _with_next(rows).withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited")))
    return made.select(
        "doc_id",
        n.alias("n_chars"),
        sha256_hex(F.col("edited")).alias("edited_sha256"),
        fingerprint_hex(F.col("fp")).alias("fingerprint"),
        fingerprint_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
