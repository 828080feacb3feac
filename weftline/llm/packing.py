"""Problem 8: documents combined into containers of fixed capacity, best fit, with as little unused space as possible.

Sizes are whole tokens up to the capacity, so documents fall into at most `capacity` classes of interchangeable members.
The rounds of best fit run over these classes, from large to small: all documents of a class and all gaps are in order of
size, each document takes the successor of its size among the gaps, conflicts are resolved by rank, gaps are updated. One
round places a whole class; the outcome is that of best fit decreasing, one document at a time. Only the histogram
(one row a class) and the ranges of ranks it turns into leave the cluster's tables; documents are ranked in parallel and
find their container by their rank.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.leaks import spread
from weftline.session import Written, table

#: The tokenizer: a file of ranks and the pattern that cuts texts into words.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Capacities beyond this need classes of more than one token.
MAX_CAPACITY = 1 << 20
#: Limits that are packed for at most: a fixed table; more are an error.
MAX_LIMITS = 1_000
#: Documents of one class that are ranked in one task.
RANK_TOGETHER = 200_000


def tokenizer(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, tokens); null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return spread(docs.select("doc_id", "text")).mapInArrow(count, "doc_id bigint, tokens bigint")


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Sizes with the number of their items -> ranges (size, rank_from, rank_to, bin_from, per_bin), and the number of bins.

    The item of a range with rank r lies in bin bin_from + (r - rank_from) // per_bin. Sizes are in 1 .. capacity.
    """
    ranges: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # in order
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first, number)
    bins = 0

    def leave(first: int, number: int, gap: int) -> None:
        if number and gap:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, number))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, number = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            else:
                gap, first = capacity, bins
                number = -(-left // (capacity // size))
                bins += number
            each = gap // size
            full = min(number, left // each)
            if full:
                ranges.append((size, rank, rank + full * each, first, each))
                leave(first, full, gap - each * size)
                rank, left = rank + full * each, left - full * each
            used = full
            if left and used < number:
                ranges.append((size, rank, rank + left, first + used, left))
                leave(first + used, 1, gap - left * size)
                rank, left, used = rank + left, 0, used + 1
            leave(first + used, number - used, gap)
    return ranges, bins


def pack(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """sizes(doc_id, tokens), limits(pack_id, capacity_tokens) -> (pack_id, bin_id, doc_id, piece, first_token, tokens).

    Each document is once in the containers of each limit. One larger than the capacity is cut into pieces of the capacity
    and a rest; no other is cut. Documents without tokens, null ids and null or non-positive capacities have no row.
    """
    spark = sizes.sparkSession
    stated = limits.where("pack_id is not null and capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().limit(MAX_LIMITS + 1).collect()
    if len(stated) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits are no fixed table")
    caps = {r.pack_id: r.capacity_tokens for r in stated}
    if not caps:
        return sizes.sparkSession.createDataFrame([], "pack_id int, bin_id bigint, doc_id bigint, piece int, first_token bigint, tokens bigint")
    if any(c > MAX_CAPACITY for c in caps.values()):
        raise ValueError(f"capacity over {MAX_CAPACITY}")
    held = Written(sizes.where("doc_id is not null and tokens > 0").select("doc_id", "tokens")).df
    each = F.array(*[F.struct(F.lit(k).cast("int").alias("pack_id"), F.lit(c).cast("bigint").alias("cap")) for k, c in sorted(caps.items())])
    cut = held.select("doc_id", "tokens", F.inline(each)).select("pack_id", "cap", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), (F.floor((F.col("tokens") - 1) / F.col("cap"))).cast("int"))).alias("piece"))
    pieces = cut.select("pack_id", "doc_id", "piece", (F.col("piece") * F.col("cap")).cast("bigint").alias("first_token"), F.least(F.col("cap"), F.col("tokens") - F.col("piece") * F.col("cap")).cast("bigint").alias("size"))
    histogram: dict[int, dict[int, int]] = {}
    for r in pieces.groupBy("pack_id", "size").agg(F.count("*").alias("n")).collect():  # at most as many rows as the capacities' sum
        histogram.setdefault(r.pack_id, {})[r.size] = r.n
    rows, classes = [], []
    for pack_id, counts in sorted(histogram.items()):
        ranges, _ = best_fit(counts, caps[pack_id])
        rows += [(pack_id, *x) for x in ranges]
        classes += [(pack_id, s, -(-n // RANK_TOGETHER)) for s, n in counts.items()]
    placed = spark.createDataFrame(rows, "pack_id int, size bigint, rank_from bigint, rank_to bigint, bin_from bigint, per_bin bigint")
    shares = spark.createDataFrame(classes, "pack_id int, size bigint, shares bigint")
    # ranks within a class, counted in shares of bounded size
    shared = pieces.join(F.broadcast(shares), ["pack_id", "size"]).withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shares"))).drop("shares")
    per_share = shared.groupBy("pack_id", "size", "share").agg(F.count("*").alias("n"))
    before = per_share.withColumn("before", F.sum("n").over(Window.partitionBy("pack_id", "size").orderBy("share")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("pack_id", "size", "share").orderBy("doc_id", "piece")) - 1
    ranked = shared.withColumn("own", own).join(before, ["pack_id", "size", "share"]).withColumn("rank", F.col("own") + F.col("before"))
    # the ranges are few: each class's are cut where a gap size is used up, so there are about as many as classes and gaps
    home = ranked.join(F.broadcast(placed), ["pack_id", "size"]).where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    bin_id = F.col("bin_from") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_bin"))
    return home.select("pack_id", bin_id.cast("bigint").alias("bin_id"), "doc_id", "piece", "first_token", F.col("size").alias("tokens"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(token_counts(table(spark, sf, "documents")), table(spark, sf, "pack_limits"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of space used, for each limit."""
    bins = p8_pack(spark, sf).groupBy("pack_id", "bin_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    total = bins.groupBy("pack_id").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"))
    filled = F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6)
    return total.join(table(spark, sf, "pack_limits").select("pack_id", "capacity_tokens"), "pack_id").select("pack_id", "bins", "tokens", "pieces", filled.alias("filled"))


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill}
ORACLES: dict[str, str] = {}
