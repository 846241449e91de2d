"""Bit vectors of a fixed width as arrays of 64-bit words, and how alike they are.

All of it is built-in expressions, so comparisons stay in generated code.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.lineage import written


def words_of(width: int) -> int:
    if width <= 0:
        raise ValueError("the width is positive")
    return (width + 63) // 64


def pack(features: Iterable[int], width: int) -> list[int]:
    """The words of one vector, as signed 64-bit values; repeated features count once."""
    out = [0] * words_of(width)
    for f in features:
        if not 0 <= f < width:
            raise ValueError(f"feature {f} lies outside the width {width}")
        out[f >> 6] |= 1 << (f & 63)
    return [w - (1 << 64) if w >> 63 else w for w in out]


def bit_vectors(df: DataFrame, id_col: str, feature_col: str, width: int) -> DataFrame:
    """id, bits, n_bits: one vector for each id, from rows of (id, feature).

    A feature outside the width fails the query.  Rows with a null feature add
    nothing; an id with null features only has an empty vector.
    """
    n = words_of(width)
    f = F.col(feature_col)
    checked = F.when(f.isNull() | ((f >= 0) & (f < width)), f.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("a feature lies outside the width: "), f.cast("string"))).cast("long")
    )
    own = df.select(F.col(id_col).alias("id"), checked.alias("f"))
    word = F.floor(F.col("f") / 64).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(f, 64) as int))")
    each = [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(n)]
    packed = own.groupBy("id").agg(F.array(*each).alias("bits"))
    return packed.withColumn("n_bits", set_bits(F.col("bits")))


def set_bits(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


#: Words up to which a comparison is written out, which keeps it in generated code.
WRITTEN_OUT = 64


def _count(a: Column, b: Column, op: str, words: int | None = None) -> Column:
    if words is not None and words <= WRITTEN_OUT:
        each = [(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(words)]
        parts = [F.bit_count({"xor": x.bitwiseXOR(y), "and": x.bitwiseAND(y), "or": x.bitwiseOR(y)}[op]).cast("long") for x, y in each]
        return reduce(lambda n, m: n + m, parts)
    joined = F.zip_with(a, b, lambda x, y: {"xor": x.bitwiseXOR(y), "and": x.bitwiseAND(y), "or": x.bitwiseOR(y)}[op])
    return set_bits(joined)


def similarity(a: Column, b: Column, width: int) -> list[Column]:
    """difference, intersection, union, hamming_distance, hamming_similarity, jaccard, cosine.

    Two empty vectors are alike (1); an empty and another one have cosine 0.
    Vectors of different width fail the query.
    """
    n = words_of(width)
    same = (F.size(a) == n) & (F.size(b) == n)
    a = F.when(same, a).otherwise(F.raise_error(F.lit("the vectors differ in width")).cast("array<bigint>"))
    diff, inter, union = (_count(a, b, op, n) for op in ("xor", "and", "or"))
    na, nb = _count(a, a, "and", n), _count(b, b, "and", n)
    root = F.sqrt(na.cast("double") * nb.cast("double"))
    return [
        diff.alias("difference"),
        inter.alias("intersection"),
        union.alias("union"),
        (diff / F.lit(float(width))).alias("hamming_distance"),
        (1.0 - diff / F.lit(float(width))).alias("hamming_similarity"),
        F.when(union == 0, 1.0).otherwise(inter / union).alias("jaccard"),
        F.when(root > 0, inter / root).when((na == 0) & (nb == 0), 1.0).otherwise(0.0).alias("cosine"),
    ]


def compare_pairs(pairs: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """Scores of stated pairs (left, right) of ids; pairs with an unknown id are absent."""
    left = vectors.select(F.col("id").alias("left"), F.col("bits").alias("a"))
    right = vectors.select(F.col("id").alias("right"), F.col("bits").alias("b"))
    return pairs.join(left, "left").join(right, "right").select("left", "right", *similarity(F.col("a"), F.col("b"), width))


#: Ids of equal vectors that are together in a row.
TOGETHER = 1000


def similar_pairs(vectors: DataFrame, width: int, least_jaccard: float) -> DataFrame:
    """All pairs left < right with at least that Jaccard similarity.

    Vectors of a and b bits that are alike to a share t have at least
    o = t / (1 + t) * (a + b) bits in common.  Where o is two or more, the two
    rarest of these are among the rarest n - o + 2 bits of both (prefix filter),
    so candidates meet on pairs of such bits, of which there are many more than
    bits.  A candidate counts at the two rarest bits it shares, if the bits
    after them leave room for o, and is decided there on the bits it carries:
    nothing is shuffled for a candidate.  Sizes for which one bit is enough meet
    on a bit and the two sizes.  Equal vectors are joined once and get their
    ids back at the end.  Empty vectors are alike to each other.
    """
    if not 0 < least_jaccard <= 1:
        raise ValueError("the least similarity lies in (0, 1]")
    t = least_jaccard
    small = "smallint" if width <= 1 << 15 else "int"
    inside = lambda w, p: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(w, i) == 1), lambda i: (p * 64 + i).cast(small))
    none = F.array().cast(f"array<{small}>")
    base = written(vectors.select("id", F.flatten(F.transform("bits", lambda w, p: F.when(w == 0, none).otherwise(inside(w, p)))).alias("bits")), "bits")
    kinds = written(base.groupBy("bits").agg(F.min("id").alias("kind"), F.count("*").alias("copies")), "kinds")
    # The rank of each bit, rarest first, as one array: width entries.
    often = kinds.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("often"))
    rank = often.select("bit", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("often", "bit")).alias("rank"))
    every = vectors.sparkSession.range(width).join(rank, F.col("id") == F.col("bit"), "left").select("id", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"))
    ranks = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "rank"))), lambda x: x["rank"]).alias("ranks"))
    ranked = F.array_sort(F.transform("bits", lambda b: F.get("ranks", b.cast("int")).cast("int")))
    sets = written(kinds.filter(F.size("bits") > 0).crossJoin(F.broadcast(ranks)).select("kind", F.size("bits").alias("n"), ranked.alias("has")), "sets")  # one row

    def common(a: Column, b: Column) -> Column:
        return F.ceil(F.lit(t / (1 + t)) * (a + b) - 1e-9).cast("int")

    jaccard = (F.size("shared") / (F.col("na") + F.col("nb") - F.size("shared"))).alias("jaccard")
    # Pairs of bits.
    o = common(F.col("n"), F.ceil(F.lit(t) * F.col("n") - 1e-9))
    own = sets.filter("n > 1").withColumn("p", (F.col("n") - F.greatest(o, F.lit(2)) + 2).cast("int")).filter("p > 1")
    two = F.expr(f"flatten(transform(sequence(0, p - 2), i -> transform(sequence(i + 1, p - 1), j -> struct(j as at, cast(has[i] as bigint) * {width + 1} + has[j] as key))))")
    keyed = own.select("kind", "n", "has", F.explode(two).alias("k")).select("kind", "n", "has", "k.at", "k.key")
    a, b = keyed.toDF("ka", "na", "xa", "ia", "key"), keyed.toDF("kb", "nb", "xb", "ib", "key")
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1
    needed = common(F.col("na"), F.col("nb"))
    near = a.join(b, "key").filter("ka < kb").filter(F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9).filter((needed >= 2) & (room >= needed))
    met = near.withColumn("shared", F.array_intersect("xa", "xb"))  # in the order of ranks
    first = F.element_at("shared", 1).cast("long") * (width + 1) + F.element_at("shared", 2) == F.col("key")
    linked = met.filter(F.size("shared") >= 2).filter(first).select("ka", "kb", jaccard)
    # Sizes for which one bit is enough.
    most = int((1 + t) / t + 1e-9) - 1
    few = sets.filter(F.col("n") <= most).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(max(most, 1))))).filter(common(F.col("n"), F.col("m")) <= 1)
    few = few.select("kind", "n", "m", "has", F.explode("has").alias("bit"))
    lower = few.filter("n <= m").select(F.col("kind").alias("k1"), F.col("n").alias("na"), F.col("m").alias("nb"), F.col("has").alias("xa"), "bit")
    upper = few.filter("m <= n").select(F.col("kind").alias("k2"), F.col("m").alias("na"), F.col("n").alias("nb"), F.col("has").alias("xb"), "bit")
    ones = lower.join(upper, ["bit", "na", "nb"]).filter("na < nb or k1 < k2").withColumn("shared", F.array_intersect("xa", "xb")).filter(F.element_at("shared", 1) == F.col("bit"))
    linked = linked.union(ones.select("k1", "k2", jaccard)).filter(F.col("jaccard") >= t - 1e-12)
    same = kinds.filter("copies > 1").select(F.col("kind").alias("ka"), F.col("kind").alias("kb"), F.lit(1.0).alias("jaccard"))
    # Ids come back as lists of bounded size, so that nothing is shuffled for a pair of copies.
    member = base.join(kinds, "bits").select("id", "kind", "copies")
    piece = F.when(F.col("copies") <= TOGETHER, 0).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / TOGETHER)))
    lists = written(member.groupBy("kind", piece.alias("piece")).agg(F.collect_list("id").alias("ids")).select("kind", "ids"), "members")
    pairs = linked.union(same).join(lists.toDF("ka", "ps"), "ka").join(lists.toDF("kb", "qs"), "kb")
    pairs = pairs.select("ka", "kb", "qs", "jaccard", F.explode("ps").alias("p")).select("ka", "kb", "jaccard", "p", F.explode("qs").alias("q")).filter("p <> q and (ka <> kb or p < q)")
    return pairs.select(F.least("p", "q").alias("left"), F.greatest("p", "q").alias("right"), "jaccard")
