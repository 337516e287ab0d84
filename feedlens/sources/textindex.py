"""Substring search by an index of characters and their neighbours.

Texts are stored beside their keys in blocks, sorted by text, so that a block's
texts are alike. Of every block the index holds its different characters and
pairs of neighbours (grams), each as a row, sorted by gram. A term can only
be in a block that has all its grams. A search reads the rows of its terms' grams,
makes a bit mask of them for each block, and tests its AND and OR groups on the
masks; then it reads the blocks that are left and looks for the terms themselves. Blocks that pass
without a hit cost time and change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import text as T
from feedlens.operators.search import KeywordGroup, keyword_condition

#: Bits of a block's mask; further grams of a search aren't asked for.
BITS = 62


def blocks_of(rows: DataFrame, *, block_rows: int = 512, bucket: str | None = None) -> DataFrame:
    """Adds ``block`` to rows with a text, dealt and sorted by text, inside each ``bucket`` if there is one.

    The result has to be written before grams are taken from it: a block is a place in it.
    """
    own = [bucket] if bucket else []
    order = [*own, "text", *[c for c in rows.columns if c not in ("text", bucket)]]  # equal texts are dealt by their keys
    kinds = dict(rows.dtypes)
    dealt = rows.repartitionByRange(*[c for c in order if not kinds[c].startswith(("map", "array", "struct"))]).sortWithinPartitions(*own, "text")
    return dealt.withColumn("block", F.shiftright(F.monotonically_increasing_id(), (block_rows - 1).bit_length()))


def grams_of(texts: DataFrame, *, bucket: str | None = None, repeated: bool = False) -> DataFrame:
    """(gram, block), with the bucket if there is one: the different grams of each block's texts, in lower case as to ASCII letters.

    Where texts are ``repeated`` much, as short messages are, a block's equal ones are brought together first, at the cost of an exchange of the different ones.
    """
    own = [bucket] if bucket else []
    if repeated:
        texts = texts.select(*own, "block", "text").distinct()
    t = F.col("_t")
    cut = lambda s: F.regexp_extract_all(s, F.lit("(?s).."), F.lit(0))
    pairs = F.concat(cut(t), cut(F.substring(t, 2, 2**30)))  # those that begin at odd places and at even ones
    valid = texts.select(*own, "block", F.make_valid_utf8(F.coalesce(T.ascii_lower(F.col("text")), F.lit(""))).alias("_t"))  # a broken character swallows no other
    taken = valid.select(*own, "block", F.explode(F.concat(F.array_distinct(F.split(t, "")), F.array_distinct(pairs))).alias("gram"))
    return taken.where("gram <> ''").distinct()


def _grams(term: str) -> list[str]:
    term = T.fold(term)
    return list(dict.fromkeys(term[i : i + 2] for i in range(len(term) - 1))) or [term]


def gram_condition(groups: Sequence[KeywordGroup]) -> tuple[list[str], Column]:
    """The grams that a search asks for, and the condition on ``mask``, whose bit k is set where gram k is there.

    It holds for every block with a text that fits. An empty term, and one whose grams have no bit left, holds for all.
    """
    used = [g for g in groups if g.keywords]
    if not used:
        raise ValueError("at least one keyword is needed")
    grams = list(dict.fromkeys(x for g in used for w in g.keywords if w for x in _grams(w)))[:BITS]
    bits = {g: 1 << k for k, g in enumerate(grams)}

    def has(term: str) -> Column:
        wanted = sum(bits.get(g, 0) for g in (_grams(term) if term else []))
        return F.col("mask").bitwiseAND(wanted) == wanted

    return grams, T.any_of((T.all_of if g.logic == "AND" else T.any_of)(map(has, g.keywords)) for g in used)


def candidate_blocks(texts: DataFrame, grams: DataFrame, groups: Sequence[KeywordGroup], *, bucket: str | None = None) -> DataFrame:
    """(block), with the bucket if there is one, of the blocks that may hold a text that fits one of the groups."""
    own = [*([bucket] if bucket else []), "block"]
    asked, condition = gram_condition(groups)
    bit = F.create_map(*[F.lit(x) for k, g in enumerate(asked) for x in (g, 1 << k)])[F.col("gram")] if asked else F.lit(0)
    found = grams.where(F.col("gram").isin(asked)).groupBy(*own).agg(F.bit_or(bit.cast("long")).alias("mask"))
    if not asked or any(not w or not set(_grams(w)) & set(asked) for g in groups for w in g.keywords):
        # a term that no bit tells about: blocks without any bit count as well
        found = texts.select(*own).distinct().join(found, own, "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    return found.where(condition).select(*own)


def search_texts(texts: DataFrame, grams: DataFrame, groups: Sequence[KeywordGroup], *, bucket: str | None = None, most_listed: int = 4096) -> DataFrame:
    """The rows of ``texts`` whose text fits one of the groups: the rows that a scan with the same groups gives.

    Up to ``most_listed`` candidate blocks are named in the scan's own filter,
    which skips row groups and pages; more are joined.
    """
    own = [*([bucket] if bucket else []), "block"]
    blocks = candidate_blocks(texts, grams, groups, bucket=bucket)
    few = blocks.select("block").distinct().limit(most_listed + 1).collect()
    if len(few) <= most_listed:
        left = texts.where(F.col("block").isin([r.block for r in few])) if few else texts.where(F.lit(False))
    else:
        left = texts.join(blocks, own, "left_semi")
    return left.where(keyword_condition(groups))


def skipped_share(texts: DataFrame, grams: DataFrame, groups: Sequence[KeywordGroup], *, bucket: str | None = None) -> float:
    """The share of blocks that a search doesn't read."""
    own = [*([bucket] if bucket else []), "block"]
    (n,) = texts.select(*own).distinct().agg(F.count("*")).first()
    return 1 - candidate_blocks(texts, grams, groups, bucket=bucket).count() / n if n else 0.0
