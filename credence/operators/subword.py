"""Greedy longest-match sub-words, as joins of word spans with the vocabulary.

Only words that can still fit (``max_len - 2`` per document) are split, each different one
once: its spans of the lengths that pieces have are joined with the vocabulary, the longest
match at each position is kept, and a fold walks from match to match. The ids then join
the documents' words, as single tokens do in ``encode``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import encode

CONTINUATION = "##"
# Positions of a long word that travel together, so that cutting spans stays linear.
_BLOCK = 256


def subword_vocabulary(counts: DataFrame, n: int, min_count: int = 1) -> DataFrame:
    """``token, id``: the ``n`` most frequent words and every character of the words seen
    ``min_count`` times, each also as a continuation piece. Bounded by ``n`` and the
    alphabet. Both parts read the same aggregate, so Spark computes it once."""
    words = encode.vocabulary(counts, n).select("token")
    characters = counts.filter(F.col("count") >= min_count).select(
        F.explode(F.array_distinct(F.split("token", ""))).alias("token")
    )
    both = F.array(F.col("token"), F.concat(F.lit(CONTINUATION), F.col("token")))
    pieces = words.union(characters.distinct()).distinct().select(F.explode(both).alias("token")).distinct()
    rank = F.row_number().over(W.orderBy("token"))
    return pieces.select("token", (rank + (encode.FIRST_TOKEN_ID - 1)).cast("int").alias("id"))


def _spans(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``word, pos, len, piece``: the parts of a word that may be a piece.

    At each position the next two characters decide: the vocabulary tells, for each two that a
    piece begins with, the lengths of such pieces. So a position gives rows only for those few.
    """
    # A word begins with any token as it stands, and goes on with the continuations.
    inner = vocab.filter(F.col("token").startswith(CONTINUATION)).select(F.lit(True).alias("inner"), F.substr("token", F.lit(len(CONTINUATION) + 1)).alias("plain"))
    pieces = vocab.select(F.lit(False).alias("inner"), F.col("token").alias("plain")).union(inner).filter("plain <> ''")
    starts = pieces.groupBy("inner", F.substr("plain", F.lit(1), F.lit(2)).alias("two")).agg(F.collect_set(F.length("plain")).alias("lengths"))
    longest = vocab.agg(F.coalesce(F.max(F.length("token")), F.lit(0))).scalar()
    size = F.length("word")
    blocks = words.select("word", size.alias("size"), F.explode(F.sequence(F.lit(1), size, F.lit(_BLOCK))).alias("start")).filter("size > 0")
    blocks = blocks.withColumn("block", F.substr("word", F.col("start"), F.lit(_BLOCK) + longest))
    here = F.least(F.lit(_BLOCK), F.col("size") - F.col("start") + 1)
    at = blocks.select("*", F.explode(F.sequence(F.lit(1), here)).alias("offset")).withColumn(
        "pos", F.col("start") + F.col("offset") - 1
    ).withColumn("inner", F.col("pos") > 1)
    # Pieces of one character begin with that one alone.
    both = F.array_distinct(F.array(F.substr("block", F.col("offset"), F.lit(2)), F.substr("block", F.col("offset"), F.lit(1))))
    spans = at.select("*", F.explode(both).alias("two")).join(starts, ["inner", "two"])
    spans = spans.select("*", F.explode("lengths").alias("len")).filter(F.col("len") <= F.col("size") - F.col("pos") + 1)
    part = F.substr("block", F.col("offset"), F.col("len"))
    return spans.select("word", "pos", "len", F.when(F.col("inner"), F.concat(F.lit(CONTINUATION), part)).otherwise(part).alias("piece"))


def word_pieces(words: DataFrame, vocab: DataFrame, at_most: int) -> DataFrame:
    """``word, ids``: the first ``at_most`` piece ids of each different ``word``, longest match
    first; words of which some part has no piece are left out."""
    matched = _spans(words, vocab).join(vocab.select(F.col("token").alias("piece"), "id"), "piece")
    longest = matched.groupBy("word", "pos").agg(F.max(F.struct("len", "id")).alias("m"))
    steps = longest.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("pos", "m.len", "m.id"))).alias("steps"))
    none = F.array().cast("array<int>")

    def step(state, match):
        taken = state["next"] == match["pos"]
        ids = F.when(taken & (F.size(state["ids"]) < at_most), F.concat(state["ids"], F.array(match["id"]))).otherwise(state["ids"])
        following = F.when(taken, match["pos"] + match["len"]).otherwise(state["next"])
        return F.struct(following.alias("next"), ids.alias("ids"))

    walk = F.aggregate("steps", F.struct(F.lit(1).alias("next"), none.alias("ids")), step)
    return steps.select("word", walk.alias("walk")).filter(
        F.col("walk.next") == F.length("word") + 1
    ).select("word", F.col("walk.ids").alias("ids"))


def encode_subword(
    examples: DataFrame, vocab: DataFrame, max_len: int, id: str = "id", text_a: str = "text_a",
    keep: Sequence[str] = (), words: Callable[[str, int], Column] = text.first_tokens,
) -> DataFrame:
    """``encode_single`` with words split into the pieces of ``vocab`` first; a word that
    cannot be split is one unknown id. ``words`` gives the first words of a text:
    ``text.first_tokens``, or ``text.first_basic_tokens``, which sets punctuation apart."""
    budget = max_len - 2
    words = F.coalesce(words(text_a, budget), F.array().cast("array<string>"))
    lead = examples.select(id, *keep, F.posexplode_outer(words).alias("pos", "word"))
    pieces = word_pieces(lead.filter("word is not null").select("word").distinct(), vocab, budget)
    unknown = F.array(F.lit(encode.UNK))
    found = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("ids", unknown).alias("ids")))
    folded = lead.join(pieces, "word", "left").groupBy(id, *keep).agg(
        F.sort_array(F.collect_list(found)).alias("found")
    )
    ids = F.slice(F.flatten(F.transform("found", lambda x: x["ids"])), F.lit(1), F.lit(budget))
    n_a = F.size("ids")
    return folded.withColumn("ids", ids).select(id, *keep, *encode.assemble(F.col("ids"), n_a, F.lit(0), max_len))
