"""Operator 6: SimHash fingerprints and the search for all of them within a Hamming radius. DataFrame functions only.

Terms are 5-word shingles (a shorter text is one term). Every occurrence of a term adds its weight to the bits that its
hash sets; a bit of the fingerprint is 1 if the weights of its ones outweigh those of its zeros. Votes are counted 3 to
a long (lanes of 21 bits), after cutting texts into chunks whose weights fit a lane, so that one text needs 44 sums
for 128 bits. Search: up to a radius of 7, the fingerprint is cut into radius+1 blocks; each block permuted to the
front is a table's key; two fingerprints within the radius agree on at least one block. For a larger radius such
tables tell hardly anything apart (of 37 blocks of 3 bits, unrelated fingerprints share some block nearly always; of
8 blocks of 16 bits with up to 4 differing ones, 30 % do), so there the stated queries are compared with all
fingerprints, in blocks of bounded size: exact too.

The radius comes from the Jaccard similarity that a search is to find: of texts of equal length that share J of all
their shingles, the angle's cosine is 2J / (1 + J), and each bit differs with the angle's share of a half turn.
"""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalebed.llm.common import keep

WIDTH, LANE, CHUNK = 5, 21, 500_000
BLOCK_ROWS, RANGE_BYTES = 65_536, 24 << 20
_MASK = sum(1 << (LANE * k) for k in range(3))


def terms(text: Column, width: int = WIDTH) -> Column:
    """array<bigint>: the hash of each shingle of words (between spaces or line ends), in order; empty without words."""
    words = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), " ")  # one plain character: split without a regular expression
    hashes = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= width, _shingles(h, width)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))[0]


def _shingles(h: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(width)]))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, width: int = WIDTH) -> DataFrame:
    """keys and a fingerprint (32 hexadecimal digits) for each row of texts; keys must tell the rows apart."""
    t = texts.select(*keys, F.posexplode_outer(terms(F.col(text_col), width)).alias("at", "term"))
    sides = []
    for seed in (1, 2):
        h = F.xxhash64("term", F.lit(seed))
        sides += [(h, f"v{seed}_")]
    t = t.select(*keys, F.floor(F.coalesce("at", F.lit(0)) / CHUNK).cast("int").alias("chunk"), F.when(F.col("term").isNotNull(), 1).otherwise(0).alias("w"), *[F.when(F.col("term").isNotNull(), h).otherwise(0).alias(name) for h, name in sides])
    votes = [F.expr(f"sum(shiftrightunsigned({name}, {i}) & {_MASK})").alias(f"{name}{i}") for _, name in sides for i in range(LANE)]
    votes += [F.expr(f"sum(shiftrightunsigned({name}, 63))").alias(f"{name}63") for _, name in sides]
    by_chunk = t.groupBy(*keys, "chunk").agg(F.sum("w").alias("w"), *votes)
    lanes = [f"shiftrightunsigned({name}{bit % LANE}, {LANE * (bit // LANE)}) & {(1 << LANE) - 1}" if bit < 63 else f"{name}63" for _, name in sides for bit in range(64)]
    unpacked = by_chunk.select(*keys, "chunk", "w", F.expr(f"array({', '.join(lanes)})").alias("votes"))
    # Texts of one chunk, nearly all of them, are done; the others' chunks are added up.
    whole = unpacked.groupBy(*keys).agg(F.sum("w").alias("w"), F.collect_list("votes").alias("all"))  # chunks of one text: n_words / CHUNK rows
    votes = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.aggregate("all", F.array_repeat(F.lit(0).cast("bigint"), 128), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)))
    bits = whole.select(*keys, "w", votes.alias("votes"))
    word = lambda k: F.expr(" | ".join(f"if(2 * votes[{64 * k + i}] > w, {1 << i if i < 63 else f'shiftleft(1L, {i})'}L, 0L)".replace(")L,", "),") for i in range(64)))
    return bits.select(*keys, F.lower(F.concat(F.lpad(F.hex(word(0)), 16, "0"), F.lpad(F.hex(word(1)), 16, "0"))).alias("fingerprint"))


def halves(fp: Column) -> tuple[Column, Column]:
    """The two longs of a fingerprint of 32 hexadecimal digits."""
    one = lambda at: F.conv(F.substring(fp, at, 16), 16, -10).cast("bigint")
    return one(1), one(17)


def distance(a: Column, b: Column) -> Column:
    (a0, a1), (b0, b1) = halves(a), halves(b)
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the angle that the share of differing bits estimates, at least 0."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(math.pi / 128)))


def _compared(queries: DataFrame, held: DataFrame, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each block of queries meets each part of the held fingerprints; one block alone is broadcast, since its size is bounded."""
    (q0, q1), (f0, f1) = halves(F.col("q")), halves(F.col("f"))
    a = queries.distinct().select("q", q0.alias("q0"), q1.alias("q1"))
    b = held.distinct().select("f", f0.alias("f0"), f1.alias("f1"))
    d = F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("f1")))
    a = keep(a, "asked")
    blocks = max(1, -(-a.count() // block_rows))
    if blocks == 1:
        return b.join(F.broadcast(a), d <= radius).select("q", "f", d.alias("distance"))
    parts = max(1, -(-b.count() // (4 * block_rows)))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = a.select("*", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), each(parts, "part"))
    b = b.select("*", F.pmod(F.xxhash64("f"), F.lit(parts)).cast("int").alias("part"), each(blocks, "block"))
    return a.join(b, ["block", "part"]).where(d <= radius).select("q", "f", d.alias("distance"))


def within(queries: DataFrame, held: DataFrame, radius: int = 3) -> DataFrame:
    """(q, f, distance) for all pairs of distinct fingerprints (columns q and f) within the radius."""
    if radius > 7:
        return _compared(queries, held, radius)
    blocks, size = radius + 1, 32 // (radius + 1)
    table = lambda c: F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring(c, 1 + k * size, size).alias("block")) for k in range(blocks)]))
    a = queries.select("q", table(F.col("q")).alias("t")).select("q", "t.k", "t.block")
    b = held.select("f", table(F.col("f")).alias("t")).select("f", "t.k", "t.block")
    d = distance(F.col("q"), F.col("f"))
    return a.join(b, ["k", "block"]).select("q", "f", d.alias("distance")).where(F.col("distance") <= radius).distinct()


def radius_for(similarity: float = 0.75, recall: float = 0.999) -> int:
    """The least radius within which so large a share of pairs of that Jaccard similarity lies."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    total = 0.0
    for k in range(129):
        total += math.comb(128, k) * p**k * (1 - p) ** (128 - k)
        if total >= recall:
            return k
    return 128


def _edited(t: DataFrame, light: DataFrame, ranges: int) -> DataFrame:
    """(k, h, doc_id, n, xk, xh, text) of each different (k, h) of t, in the order of descending (k, h): x is the next one's key, text the edited text.

    The order is cut into ranges of about equal row counts (one (k, h) for each is all that the driver sees). A range's
    first document also goes to the range before it as a guest, so that texts move once.
    """
    ranges = light.repartitionByRange(ranges, F.desc("k"), F.desc("h")).groupBy(F.spark_partition_id().alias("pid")).agg(F.max(F.struct("k", "h")).alias("first"))
    firsts = sorted(((r["first"]["k"], r["first"]["h"]) for r in ranges.collect()), reverse=True) or [(0, 0)]  # at most a row for each range
    bk, bh = F.array(*[F.lit(k).cast("long") for k, _ in firsts]), F.array(*[F.lit(h).cast("long") for _, h in firsts])
    count, steps = len(firsts), [1 << i for i in reversed(range((len(firsts) - 1).bit_length()))]

    def halve(g: Column, step: Column) -> Column:
        to = g + step
        at = F.least(to, F.lit(count - 1))
        return F.when((to < count) & ((F.get(bk, at) > F.col("k")) | ((F.get(bk, at) == F.col("k")) & (F.get(bh, at) >= F.col("h")))), to).otherwise(g)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve) if steps else F.lit(0)
    dealt = t.withColumn("g", found)
    leads = (F.get(bk, F.col("g")) == F.col("k")) & (F.get(bh, F.col("g")) == F.col("h"))
    before = F.pmod(F.col("g") - 1, F.lit(count))
    guest = lambda g, flag: F.struct(g.alias("g"), F.lit(flag).alias("guest"))
    dealt = dealt.select("k", "h", "doc_id", "text", F.explode(F.when(leads, F.array(guest(F.col("g"), 0), guest(before, 1))).otherwise(F.array(guest(F.col("g"), 0)))).alias("to"))
    dealt = dealt.select("k", "h", "doc_id", "text", "to.g", "to.guest")
    w = Window.partitionBy("g").orderBy("guest", F.desc("k"), F.desc("h"))
    # Of repeated rows the last stays: what follows it is another document.
    chain = dealt.select("*", *[F.lead(c).over(w).alias(f"x{c}") for c in ("k", "h", "guest", "text")]).where("guest = 0 and not (xguest = 0 and xk = k and xh = h)")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    return chain.select("k", "h", "doc_id", n.alias("n"), "xk", "xh", F.concat(F.substring("text", F.lit(1), n - half), F.substring("xtext", F.lit(1), half)).alias("text"))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None, query_mod: int = 100) -> DataFrame:
    """One row per row of docs: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within, within_ids).

    Edited text and next document as the order by descending id (ties: by a hash of the text) gives them. Null texts
    are empty, and an empty text's fingerprint is all zeros. Rows that repeat id and text are one document with a row for
    each; null ids come last. A single document is its own next one. n_within: for ids divisible by query_mod, how many other documents' fingerprints lie within the radius;
    within_ids: the ids of those documents in order, nulls first; both are null for the rest. The radius is radius_for()
    unless it is given. Extra columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = [F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("h")]
    light = keep(src.select(*key, F.octet_length("text").alias("bytes")), "order")
    size = light.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    edited = keep(_edited(src.select(*key, "doc_id", "text"), light.select("k", "h"), ranges), "edited")
    repeats = keep(light.groupBy("k", "h").agg(F.count("*").cast("int").alias("times")).where("times > 1"), "repeats")
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the texts' shuffle files
    fp = keep(fingerprints(src.select(*key, "text"), ["k", "h"], "text"), "fp")
    efp = keep(fingerprints(edited, ["k", "h"], "text").withColumnRenamed("fingerprint", "edited_fingerprint"), "efp")
    e = edited.select("k", "h", "doc_id", "n", "xk", "xh", F.sha2("text", 256).alias("edited_sha256"))
    nxt = fp.select(F.col("k").alias("xk"), F.col("h").alias("xh"), F.col("fingerprint").alias("next_fp"))
    out = keep(e.join(fp, ["k", "h"]).join(efp, ["k", "h"]).join(nxt, ["xk", "xh"]), "prints")
    member = F.struct("doc_id")  # in a struct, since null ids are members too
    held = keep(out.groupBy("fingerprint").agg(F.collect_list(member).alias("members"), F.max(F.col("doc_id") % query_mod == 0).alias("asked")), "held")
    near = keep(within(held.where("asked").select(F.col("fingerprint").alias("q")), held.select(F.col("fingerprint").alias("f")), radius_for() if radius is None else radius), "near")
    near = near.join(held.select(F.col("fingerprint").alias("f"), "members"), "f").groupBy("q").agg(F.flatten(F.collect_list("members")).alias("all"))
    near = keep(near.select("q", F.sort_array(F.transform("all", lambda m: m["doc_id"])).alias("all")), "members")
    out = out.join(near.select(F.col("q").alias("fingerprint"), "all"), "fingerprint", "left")
    out = out.join(repeats, ["k", "h"], "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    own = F.array_position("all", F.col("doc_id")).cast("int")
    asked = lambda c: F.when(F.col("doc_id") % query_mod == 0, c)
    others = F.concat(F.slice("all", F.lit(1), own - 1), F.slice("all", own + 1, F.size("all")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"), asked(F.size("all").cast("long") - 1).alias("n_within"), asked(others).alias("within_ids"))
