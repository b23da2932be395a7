"""Preference examples: a shared prompt, and what was chosen and rejected after it, with loss masks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.session import settle


class ChatTemplate(NamedTuple):
    """How a turn is written: ``before`` its role, ``after`` the role, and ``end`` after its text.

    Loss falls on the text of the roles in ``loss_roles`` and on the mark that ends it.
    """

    before: str = "<|"
    after: str = "|>\n"
    end: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)


def turn_text(role: Column, text: Column, template: ChatTemplate) -> Column:
    return F.concat(turn_head(role, template), F.coalesce(text, F.lit("")), F.lit(template.end))


def turn_head(role: Column, template: ChatTemplate) -> Column:
    return F.concat(F.lit(template.before), F.coalesce(role, F.lit("")), F.lit(template.after))


def _next_heads(outer: DataFrame | None, openings: DataFrame, length: int, outer_length: int) -> DataFrame:
    """``(name, after)`` for every prefix of ``length`` digits: the head of the next one in order.

    Prefixes are sorted within those of ``outer_length`` digits; the last of each goes on as ``outer`` tells.
    """
    name = F.substring("opening", 1, length)
    heads = openings.groupBy(name.alias("name")).agg(F.min(F.struct("opening", "head"))["head"].alias("head"))
    group = F.substring("name", 1, outer_length)
    heads = heads.withColumn("group", group).withColumn("after", F.lead("head").over(Window.partitionBy("group").orderBy("name")))
    if outer is None:
        return heads.select("name", "after")
    above = outer.select(F.col("name").alias("group"), F.col("after").alias("after_group"))
    return heads.join(above, "group").select("name", F.coalesce("after", "after_group").alias("after"))


def _neighbours(convs: DataFrame) -> DataFrame:
    """``next`` for every row of ``convs (conv, weight, opening, part)``: conv and weight of the one after it, by opening, part and id.

    Those of one opening are sorted in parts; only the first of each part, opening and prefix
    of the openings' checksums goes into the sorts that link these, the last of which has 256 rows.
    """
    head = F.struct("conv", "weight")
    after = F.lead(head).over(Window.partitionBy("opening", "part").orderBy("conv"))
    linked = convs.withColumn("next", after)
    parts = convs.groupBy("opening", "part").agg(F.min(head).alias("head"))
    parts = parts.withColumn("after_part", F.lead("head").over(Window.partitionBy("opening").orderBy("part")))
    openings = settle(parts.groupBy("opening").agg(F.min(F.struct("part", "head"))["head"].alias("head")), "openings")
    following = _next_heads(_next_heads(_next_heads(None, openings, 2, 0), openings, 4, 2), openings, 32, 4)
    later = parts.join(following.select(F.col("name").alias("opening"), F.col("after").alias("after_opening")), "opening")
    later = later.select("opening", "part", F.coalesce("after_part", "after_opening").alias("later"))
    lasts = linked.where("next IS NULL").join(later, ["opening", "part"]).select("conv", "weight", F.col("later").alias("next"))
    return linked.where("next IS NOT NULL").select("conv", "weight", "next").union(lasts.where("next IS NOT NULL"))


def pair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pairs ``(pair_id, chosen, rejected)`` that take in every conversation of ``turns``.

    Conversations are ordered by the checksum of their first turn, so that those that open alike stand
    together, and each is paired with the one after it: the one with more assistant text is chosen, on a
    tie the one with the smaller id. ``pair_id`` is the id of the first of the two. n conversations give n - 1
    pairs whatever their openings, so a very common opening makes no more pairs than rare ones. Ids are of any type that has an order; a
    null ``conv_id`` is no conversation.
    """
    conv, role, text = F.col(f"`{conv_col}`"), F.col(f"`{role_col}`"), F.col(f"`{text_col}`")
    first = F.min(F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")))
    weight = F.coalesce(F.sum(F.when(role == "assistant", F.length(text))), F.lit(0))
    opening = F.md5(F.concat_ws("|", F.coalesce("first.role", F.lit("")), F.coalesce("first.text", F.lit(""))))
    convs = turns.where(conv.isNotNull()).groupBy(conv.alias("conv")).agg(first.alias("first"), weight.alias("weight"))
    both = _neighbours(settle(convs.select("conv", "weight", opening.alias("opening"), F.pmod(F.xxhash64("conv"), F.lit(64)).alias("part")), "conversations"))
    first_wins = (F.col("weight") > F.col("next.weight")) | ((F.col("weight") == F.col("next.weight")) & (F.col("conv") < F.col("next.conv")))
    return both.select(
        F.col("conv").alias("pair_id"),
        F.when(first_wins, F.col("conv")).otherwise(F.col("next.conv")).alias("chosen"),
        F.when(first_wins, F.col("next.conv")).otherwise(F.col("conv")).alias("rejected"),
    )


def _talks(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(conv, turns)``: the roles and texts of each conversation in order."""
    columns = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    plain = turns.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()]).where("conv IS NOT NULL")
    if wanted is not None:
        plain = plain.join(wanted, "conv", "left_semi")
    listed = plain.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return listed.select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def forked_preferences(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: ChatTemplate = ChatTemplate(),
) -> DataFrame:
    """Preference examples from conversations alone: what was really said, against what was said elsewhere.

    A conversation forks at its last turn of a role with loss. Chosen is the conversation itself; rejected are its turns before the fork,
    followed by what another conversation says from its own fork on. That one is the next with such a turn, in the order of the ids' checksums, so
    openings and copies have no say in it. ``pair_id`` and ``chosen`` are the conversation's id, ``rejected`` that of the other. A conversation
    that does not fork after its first turn gives no example, nor does one whose two completions are the same; nor the last in order, that has no next.

    The columns are those of format_preferences, whose notes hold here too.
    """
    talks = _talks(turns, conv_col, turn_col, role_col, text_col)
    roles = ", ".join("'" + role.replace("'", "\\'") + "'" for role in template.loss_roles)
    fork = F.expr(f"coalesce(array_max(filter(sequence(1, greatest(1, size(turns))), i -> get(turns, i - 1).role IN ({roles}))), 0)")
    talks = settle(talks.withColumn("fork", fork).where("fork > 0"), "talks")
    order = F.md5(F.col("conv").cast("string").cast("binary"))
    convs = settle(talks.select("conv", F.lit(0).alias("weight"), order.alias("opening"), F.lit(0).alias("part")), "conversations")
    pairs = _neighbours(convs).select("conv", F.col("next.conv").alias("other"))
    others = talks.select(F.col("conv").alias("other"), F.slice("turns", F.col("fork"), F.size("turns")).alias("said"))
    forked = talks.where("fork > 1").join(pairs, "conv").join(others, "other")
    rejected = F.concat(F.slice("turns", F.lit(1), F.col("fork") - 1), "said")
    both = forked.select(F.col("conv").alias("pair_id"), F.col("conv").alias("chosen"), F.col("other").alias("rejected"), F.col("turns").alias("c"), rejected.alias("r"))
    return _formatted(both.where(~F.col("c").eqNullSafe(F.col("r"))), template)


def format_preferences(
    turns: DataFrame,
    pairs: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: ChatTemplate = ChatTemplate(),
) -> DataFrame:
    """One row for each pair: ``prompt``, ``prompt_turns`` and, for ``chosen`` and ``rejected``, text, turns and mask.

    The prompt is the longest run of turns, from the first on, whose roles and texts are the same in
    both conversations, written once. ``chosen_mask`` and ``rejected_mask`` list the character ranges
    ``(start, end)`` of their completion that bear loss; the prompt bears none. Built-in functions do everything.

    Turns are numbered by their order in a conversation, so gaps in ``turn`` do not matter and repeated rows are turns of their own, ordered by
    role and text. Null roles and texts are written as empty ones and equal only each other. A conversation of a pair that has no turns is
    empty. A conversation must fit a row, as its rendered text has to.
    """
    wanted = pairs.select(F.col("chosen").alias("conv")).union(pairs.select(F.col("rejected").alias("conv"))).distinct()
    talks = settle(_talks(turns, conv_col, turn_col, role_col, text_col, wanted), "talks")
    empty = F.expr("cast(array() AS array<struct<role: string, text: string>>)")
    both = (
        pairs.join(talks.withColumnsRenamed({"conv": "chosen", "turns": "c"}), "chosen", "left")
        .join(talks.withColumnsRenamed({"conv": "rejected", "turns": "r"}), "rejected", "left")
        .withColumns({"c": F.coalesce("c", empty), "r": F.coalesce("r", empty)})
    )
    return _formatted(both, template)


def _formatted(both: DataFrame, template: ChatTemplate) -> DataFrame:
    """Prompt, completions and masks of ``both (pair_id, chosen, rejected, c, r)``, the turns of two conversations."""
    # The first place where the two differ, or the end of the shorter one.
    shared = F.expr("least(size(c), size(r))")
    differ = F.expr("filter(sequence(1, greatest(1, least(size(c), size(r)))), i -> i <= least(size(c), size(r)) AND NOT (c[i - 1] <=> r[i - 1]))")
    both = both.withColumn("prompt_turns", F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, shared))

    def rendered(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda t: turn_text(t["role"], t["text"], template)), "")

    def tail(name: str) -> Column:
        return F.slice(F.col(name), F.col("prompt_turns") + 1, F.greatest(F.lit(0), F.size(name) - F.col("prompt_turns")))

    def mask(part: Column) -> Column:
        """Ranges of the texts with loss, by the running length of the turns before each."""
        bears = lambda t: F.coalesce(t["role"].isin(*template.loss_roles), F.lit(False))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<start: int, end: int>>)").alias("ranges"))

        def step(state: Column, t: Column) -> Column:
            head = F.length(turn_head(t["role"], template))
            whole = F.length(turn_text(t["role"], t["text"], template))
            own = F.array(F.struct((state["at"] + head).alias("start"), (state["at"] + whole).alias("end")))
            return F.struct((state["at"] + whole).alias("at"), F.when(bears(t), F.concat(state["ranges"], own)).otherwise(state["ranges"]).alias("ranges"))

        return F.aggregate(part, start, step, lambda state: state["ranges"])

    return both.select(
        "pair_id",
        "chosen",
        "rejected",
        "prompt_turns",
        rendered(F.slice("c", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        (F.size("c") - F.col("prompt_turns")).alias("chosen_turns"),
        rendered(tail("c")).alias("chosen_text"),
        mask(tail("c")).alias("chosen_mask"),
        (F.size("r") - F.col("prompt_turns")).alias("rejected_turns"),
        rendered(tail("r")).alias("rejected_text"),
        mask(tail("r")).alias("rejected_mask"),
    )
