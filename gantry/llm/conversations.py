"""Problem 6: rebuilding conversations from message rows.

Within a channel each message is scored against earlier messages as the one it replies to: by time,
by mentions of what the other said, by shared words. The likeliest parent makes a link; links form
trees. A stored conversation is kept if its messages make one tree, whose order then is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.operators.hierarchy import resolve_hierarchy
from gantry.operators.skew import distributed_rank, lookup
from gantry.session import Scratch

#: Messages of a channel that one task looks at for the nearest ones before.
BLOCK = 4096
#: Weights of the three scores, each between 0 and 1.
WEIGHTS = {"time": 1.0, "mention": 2.0, "words": 1.5}
#: Seconds in which the time score halves, and seconds beyond which a shared word says nothing.
HALF_LIFE, HORIZON = 300.0, 21_600

#: Spellings of the three roles.
_ROLES = {
    "user": ["user", "human", "usr", "customer", "person", "prompter"],
    "assistant": ["assistant", "ai", "bot", "model", "gpt", "agent", "asst", "chatbot"],
    "system": ["system", "sys", "developer"],
}
_CONTENT = "text string, tool_calls array<struct<id:string, name:string, arguments:string, result:string>>"


def clean_role(role: Column) -> Column:
    """user, assistant or system; null for anything else."""
    plain = F.lower(F.trim(F.regexp_replace(role, r"[\s:_-]+", " ")))
    out = F.when(F.lit(False), F.lit(None))
    for name, spellings in _ROLES.items():
        out = out.when(plain.isin(spellings), name)
    return out


def read_messages(messages: DataFrame) -> DataFrame:
    """message_id, conversation_id, role, text, calls, open_calls, at, turn_rank: distinct messages with their content read.

    content_json that is no JSON object is the bare text. calls counts tool calls, open_calls those
    without a result. Null contents have no text.
    """
    rows = messages.select("id", "conversation_id", "role", "content_json", "created_at").distinct()
    json = F.when(F.ltrim("content_json").startswith("{"), F.try_parse_json("content_json"))
    parsed = F.from_json("content_json", _CONTENT)
    is_json = json.isNotNull()
    calls = F.when(is_json, F.coalesce(parsed["tool_calls"], F.array().cast("array<struct<id:string, name:string, arguments:string, result:string>>"))).otherwise(F.array().cast("array<struct<id:string, name:string, arguments:string, result:string>>"))
    role = clean_role(F.col("role"))
    order = F.when(role == "system", 0).when(role == "user", 1).when(role == "assistant", 2).otherwise(3)
    return rows.select(
        F.col("id").alias("message_id"), "conversation_id", role.alias("role"), F.when(is_json, parsed["text"]).otherwise(F.col("content_json")).alias("text"),
        F.size(calls).alias("calls"), F.size(F.filter(calls, lambda c: c["result"].isNull())).alias("open_calls"),
        F.transform(calls, lambda c: c["id"]).alias("call_ids"), F.col("created_at").cast("timestamp").alias("at"), order.alias("turn_rank"),
    )


def _fitting(kind: str, cond: Column, facts: Column, window) -> Column:
    return F.last(F.when(F.col("at").isNotNull() & cond, facts), ignorenulls=True).over(window).alias(kind)


def _of_side(prefix: str = "") -> Column:
    """The candidate that fits a message's role: the other side or the system for user and assistant, else the system."""
    return F.when(F.col("role") == "user", F.col(prefix + "to_user")).when(F.col("role") == "assistant", F.col(prefix + "to_assistant")).otherwise(F.col(prefix + "to_other"))


def _befores(facts: Column, window) -> list[Column]:
    role = F.col("role")
    return [_fitting("to_user", role.isin("assistant", "system"), facts, window), _fitting("to_assistant", role.isin("user", "system"), facts, window), _fitting("to_other", role == "system", facts, window)]


def reply_links(messages: DataFrame, channel: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds rn (rank in the channel by time) and parent_rn, that of the likeliest message replied to.

    A message of the user or of the assistant replies to the other side, or to a system message;
    others only to a system message. Candidates are the nearest fitting message before, however
    long ago; the message that owns an id which the text mentions, however long ago; and for each
    of the message's words the nearest fitting message of the last HORIZON seconds that has it. A
    word counts for its candidate by the inverse root of the number of messages that have it at that
    time, as a share of all the message's words. So each message has no more candidates than words,
    and no pair of messages is formed; an earlier message can't win by a word that a later one has
    too. Without a candidate parent_rn is null. Messages without a time come last in their channel,
    have no parent and are none. Ties go to the nearer message.
    """
    scratch = Scratch(messages.sparkSession, "links")
    keyed = messages.filter(F.col(channel).isNotNull())
    ranked = scratch.write(distributed_rank(keyed, [channel], [F.col("at").asc_nulls_last(), F.col("turn_rank"), F.col("message_id")], "rn"))
    facts = F.struct("rn", "at")
    # the nearest before: within blocks of a channel, then what the blocks before left
    blocks = ranked.select(channel, "rn", "role", "at", F.floor((F.col("rn") - 1) / BLOCK).alias("block"))
    near = blocks.select("*", *_befores(facts, Window.partitionBy(channel, "block").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)))
    left = blocks.filter(F.col("at").isNotNull()).groupBy(channel, "block").agg(*[
        F.max(F.when(c, facts)).alias(k) for k, c in (("to_user", F.col("role").isin("assistant", "system")), ("to_assistant", F.col("role").isin("user", "system")), ("to_other", F.col("role") == "system"))
    ])
    earlier = Window.partitionBy(channel).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select(channel, "block", *[F.last(c, ignorenulls=True).over(earlier).alias("old_" + c) for c in ("to_user", "to_assistant", "to_other")])
    near = near.join(left, [channel, "block"], "left").select(channel, "rn", "at", F.coalesce(_of_side(), _of_side("old_")).alias("c"), F.lit(0.0).alias("w"), F.lit(0).alias("m"))
    # shared words: windows over the messages of one word in one stretch of time and the stretch before
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 3))
    told = ranked.filter(F.col("at").isNotNull()).select(channel, "rn", "role", "at", F.floor(F.col("at").cast("double") / HORIZON).cast("int").alias("stretch"), F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("word"))
    shown = told.withColumn("seen", F.explode(F.array(F.col("stretch"), F.col("stretch") + 1)))
    group = Window.partitionBy(channel, "word", "seen")
    rarity = 1 / F.sqrt(F.count(F.lit(1)).over(group))
    voted = shown.select("*", rarity.alias("w"), *_befores(facts, group.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("seen") == F.col("stretch"))
    c = _of_side()
    votes = voted.select(channel, "rn", "at", F.when(c["at"].cast("double") >= F.col("at").cast("double") - HORIZON, c).alias("c"), "w", F.lit(0).alias("m"))
    # mentions of ids, at any distance
    owned = ranked.filter(F.col("at").isNotNull()).select(channel, F.explode(F.array_union(F.array("message_id"), F.coalesce("call_ids", F.array().cast("array<string>")))).alias("name"), "role", facts.alias("c"))
    owned = owned.filter("name is not null").withColumn("token", F.xxhash64("name")).groupBy(channel, "token").agg(F.min_by(F.struct("role", "c"), "c").alias("o")).select(channel, "token", F.col("o.role").alias("o_role"), "o.c")
    tokens = F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}_-]+"))
    named = ranked.filter(F.col("at").isNotNull()).select(channel, "rn", "role", "at", F.explode(F.transform(tokens, lambda t: F.xxhash64(t))).alias("token"))
    fits = (F.col("o_role") == "system") | (F.col("role").isin("user", "assistant") & F.col("o_role").isin("user", "assistant") & (F.col("role") != F.col("o_role")))
    met = lookup(named, owned, [channel, "token"], "inner").filter(fits & (F.col("c.rn") < F.col("rn")))
    mentions = met.select(channel, "rn", "at", "c", F.lit(0.0).alias("w"), F.lit(1).alias("m"))
    every = near.unionByName(votes).unionByName(mentions).groupBy(channel, "rn", "c").agg(F.sum("w").alias("w"), F.max("m").alias("m"), F.first("at").alias("at"))
    share = F.col("w") / F.greatest(F.sum("w").over(Window.partitionBy(channel, "rn")), F.lit(1e-9))
    time = F.pow(F.lit(0.5), F.greatest(F.col("at").cast("double") - F.col("c.at").cast("double"), F.lit(0.0)) / HALF_LIFE)
    scored = every.withColumn("score", weights["time"] * time + weights["mention"] * F.col("m") + weights["words"] * share).filter("c is not null and at is not null")
    best = scored.groupBy(channel, "rn").agg(F.max_by("c", F.struct("score", "c.rn")).alias("c")).select(channel, "rn", F.col("c.rn").alias("parent_rn"))
    return ranked.join(best, [channel, "rn"], "left")


def with_parents(linked: DataFrame, channel: str) -> DataFrame:
    """Adds parent_id, the message_id of parent_rn, to the rows of reply_links."""
    names = linked.select(channel, F.col("rn").alias("parent_rn"), F.col("message_id").alias("parent_id"))
    return linked.join(names, [channel, "parent_rn"], "left")


def rebuild_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """conversation_id, turn_no, message_id, role, text: the messages of the kept conversations in order.

    Kept is a listed conversation whose reply links make one tree (links go back in time, so that is
    so if just one message has no parent), whose messages in the order of time are system messages,
    then user and assistant in turn, the assistant last, one pair at least, all have a time and say
    or call something, and whose tool calls all have results. Conversations of any length are ranked
    and checked by aggregates, never gathered.
    """
    linked = Scratch(messages.sparkSession, "turns").write(reply_links(read_messages(messages), "conversation_id"))
    speaks = F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) > 0
    role = F.col("role")
    sound = F.col("at").isNotNull() & role.isNotNull() & (speaks | ((role == "assistant") & (F.col("calls") > 0))) & (F.col("open_calls") == 0)
    system, odd = role == "system", F.col("rn") % 2 == 1
    facts = linked.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sound).alias("sound"), F.count_if(F.col("parent_rn").isNull()).alias("roots"), F.count_if(system).alias("systems"),
        F.max(F.when(system, F.col("rn"))).alias("last_system"), F.count_if(role == "user").alias("users"), F.count_if(role == "assistant").alias("assistants"),
        F.count_if((role == "user") & odd).alias("users_odd"), F.count_if((role == "assistant") & odd).alias("assistants_odd"),
    )
    listed = conversations.select(F.col("id").alias("conversation_id")).filter("conversation_id is not null").distinct()
    # as many users as assistants, each on places of one parity: they alternate
    in_turn = F.when(F.col("systems") % 2 == 0, (F.col("users_odd") == F.col("users")) & (F.col("assistants_odd") == 0)).otherwise((F.col("users_odd") == 0) & (F.col("assistants_odd") == F.col("assistants")))
    good = facts.filter((F.col("roots") == 1) & (F.col("sound") == F.col("n")) & (F.coalesce("last_system", F.lit(0)) == F.col("systems")) & (F.col("users") > 0) & (F.col("users") == F.col("assistants")) & in_turn)
    good = good.join(listed, "conversation_id", "left_semi").select("conversation_id")
    return linked.join(good, "conversation_id", "left_semi").select("conversation_id", F.col("rn").cast("int").alias("turn_no"), "message_id", "role", "text")


def channel_threads(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """message_id, repository_id, parent_id, root_id, depth: threads found in each repository's stream of messages.

    The stored conversation ids aren't used: the messages of a repository are one interleaved
    channel. Messages of unlisted conversations have no channel and are left out.
    """
    where = conversations.filter("id is not null").groupBy(F.col("id").alias("conversation_id")).agg(F.max("repository_id").alias("repository_id"))
    read = read_messages(messages).join(where, "conversation_id")
    linked = with_parents(Scratch(messages.sparkSession, "links").write(reply_links(read, "repository_id")), "repository_id")
    tree = resolve_hierarchy(linked.select(F.col("repository_id").alias("scope"), F.col("message_id").alias("child"), F.col("parent_id").alias("parent")))
    return linked.select("message_id", "repository_id", "conversation_id", "parent_id").join(tree.select(F.col("node").alias("message_id"), "root_id", "depth"), "message_id")
