"""Quotation linking in conversations: quoted passages joined to the messages they come from. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_lookup

#: A line of this form right before a quote names its writer and belongs to the quote.
ATTRIBUTION = r"^(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$"

_LINES = r"transform(split({t}, r'\r?\n'), x -> struct(length(regexp_replace(regexp_extract(x, r'^(?:[ \t]*>)+', 0), '[^>]', '')) AS level, regexp_replace(x, r'^(?:[ \t]*>)+[ \t]?', '') AS body))"
_NORMAL = "trim(regexp_replace(lower({x}), r'[^\\p{{L}}\\p{{N}}.!?]+', ' '))"
_SENTENCES = "filter(transform(split({x}, r'(?<=[.!?])\\s+'), s -> trim(s)), s -> rlike(s, r'[\\p{{L}}\\p{{N}}]'))"


def _sentences(text: str) -> str:
    return _SENTENCES.format(x=_NORMAL.format(x=text))


def parse_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """conv_id, turn, role, own (the text without quotes and their attributions), passages array<struct<level, text>>.

    A line's level is the number of > marks that it begins with. A passage is a run of lines of one level.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("conv_id", "turn", "role", F.expr(_LINES.format(t="t")).alias("lines"))
    starts = "filter(sequence(0, size(lines) - 1), i -> i = 0 OR lines[i].level <> lines[i - 1].level)"
    own = f"filter(lines, (x, i) -> x.level = 0 AND NOT (i + 1 < size(lines) AND lines[i + 1].level > 0 AND rlike(x.body, r'{ATTRIBUTION}')))"
    rows = rows.withColumn("starts", F.expr(starts)).withColumn("ends", F.expr("concat(slice(starts, 2, size(starts)), array(size(lines)))"))
    runs = "transform(zip_with(starts, ends, (a, b) -> struct(a AS a, b AS b)), r -> struct(lines[r.a].level AS level, array_join(transform(slice(lines, r.a + 1, r.b - r.a), x -> x.body), ' ') AS text))"
    return rows.select("conv_id", "turn", "role", F.expr(f"trim(array_join(transform({own}, x -> x.body), '\n'))").alias("own"), F.expr(f"filter({runs}, p -> p.level > 0)").alias("passages"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """One row for each message: conv_id, turn, role, own, n_passages, n_linked, parent_turn, root_turn, depth.

    Passages are hashed sentence by sentence, in lower case with all but letters, digits and sentence ends as one space,
    so that rewrapped quotes still match. A sentence's origin is the earliest message of the conversation with it in
    its own text; a passage comes from the earlier message that is the origin of most of its sentences (of equal
    ones, the latest). parent_turn: where the first linked passage of the lowest level comes from; null without one.
    root_turn and depth: the first message of the chain of parents, and its length. In the order of conv_id, root_turn
    and turn each message follows those it replies to: the conversation ordered by replies, without quotes.

    Origins are one row for each sentence, so that no pairs of messages are formed; frequent sentences and parents are
    dealt to salts. A null text is empty, null turns and conversations link to nothing (root_turn is the turn itself);
    a message that repeats gives a row each. An empty table gives no rows. Further columns are not read.
    """
    parsed = parse_quotes(messages, conv_col, turn_col, text_col, role_col)
    key = lambda *c: F.struct(*c)
    placed = parsed.filter("conv_id is not null and turn is not null")
    sentence = placed.select("conv_id", "turn", F.explode(F.expr(_sentences("own"))).alias("s"))
    quoted = placed.select("conv_id", "turn", F.posexplode("passages").alias("n", "p")).select("conv_id", "turn", "n", "p.level", F.explode(F.expr(_sentences("p.text"))).alias("s"))
    hashed = lambda df: df.withColumn("key", key("conv_id", F.md5("s").alias("h"))).drop("s")
    quoted = cut(hashed(quoted))
    links = None
    if quoted.limit(1).count():
        # the earliest turn of each sentence first: a sentence that is said over and over is one row before it is joined
        origins = hashed(sentence).groupBy("key").agg(F.min("turn").alias("origin")).join(quoted.select("key").distinct(), "key", "left_semi")
        met = spread_lookup(quoted, origins, "key", "turn").filter("origin < turn")
        votes = met.groupBy("conv_id", "turn", "n", "level", "origin").agg(F.count("*").alias("votes"))
        passages = votes.groupBy("conv_id", "turn", "n", "level").agg(F.max(F.struct("votes", "origin")).alias("best"))
        links = passages.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "n", F.col("best.origin").alias("origin"))).alias("first"), F.count("*").alias("n_linked"))
        links = cut(links.select("conv_id", "turn", F.col("first.origin").alias("parent_turn"), "n_linked"))
    if links is None or not links.limit(1).count():
        up = parsed.select("conv_id", "turn", F.lit(0).cast("long").alias("n_linked"), F.col("turn").alias("parent_turn"), F.col("turn").alias("root_turn"), F.lit(0).alias("depth")).limit(0)
    else:
        up = _roots(links)
    out = parsed.join(up, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "own", F.size("passages").cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
    )


def _roots(links: DataFrame) -> DataFrame:
    """links with root_turn and depth: each round doubles how far up a message's chain of parents is followed."""
    step = links.select("conv_id", "turn", "parent_turn", "n_linked", F.col("parent_turn").alias("up"), F.lit(1).alias("depth"))
    while True:
        further = step.select(F.struct("conv_id", "turn").alias("key"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        asked = step.withColumn("key", F.struct("conv_id", F.col("up").alias("turn")))
        met = spread_lookup(asked, further, "key", "turn", how="left")
        step = cut(met.select("conv_id", "turn", "parent_turn", "n_linked", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        if not step.filter("moved").limit(1).count():
            return step.select("conv_id", "turn", "n_linked", "parent_turn", F.col("up").alias("root_turn"), "depth")
        step = step.drop("moved")
